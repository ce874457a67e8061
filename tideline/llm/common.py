"""Shared helpers: the scratch folder, skew-safe joins, clash-free columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scratch import discard, scratch_dir, stored

__all__ = ["ascii_lower", "discard", "join_salted", "join_to_groups", "read", "scratch_dir", "stored", "values"]

#: Words are maximal runs of bytes outside these (space and \t \n \v \f \r).
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java or RE2 character class.
BLANK_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def values(column: pa.Array, step: int = 256) -> Iterator:
    """A column's values, of which only a few at a time are Python objects."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def join_to_groups(
    rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 10_000, total: int | None = None
) -> DataFrame:
    """Left join rows to their group's row, whatever the size of a group.

    A group with over 1/``share`` of all grouped rows is hot.  There are fewer
    than ``share`` of those, a proven bound, so they are broadcast and their
    rows never meet in one task.  All other groups take part in an ordinary
    shuffled join in which no key holds over 1/``share`` of the rows.
    ``groups`` has one row per key and the number of its rows in ``size``;
    ``total`` is the sum of that, if it is known.
    """
    asked = total is None
    total = (groups.agg(F.sum(size).alias("n")).first()["n"] or 0) if asked else total
    hot = groups.filter(F.col(size) * share > total)
    cold = groups.filter(F.col(size) * share <= total)
    if asked and cold.isEmpty():
        return rows.join(F.broadcast(hot), key, "left")
    values = [c for c in groups.columns if c != key]
    first = rows.join(F.broadcast(hot.select(key, *[F.col(c).alias(f"_hot_{c}") for c in values])), key, "left")
    # Rows of a hot group, and those without a key, match nothing in the
    # shuffled join: a part of its key that is drawn by their hash spreads them.
    settled = F.col(f"_hot_{size}").isNotNull() | F.col(key).isNull()
    spread = F.when(settled, F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(1024))).otherwise(F.lit(-1))
    first = first.withColumn("_part", spread)
    rest = cold.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_cold_{c}") for c in values]).withColumn("_at", F.lit(-1))
    both = first.join(rest, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_at")), "left")
    return both.select(*rows.columns, *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in values])


def join_salted(rows: DataFrame, side: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join with ``side``, which has a row per key of any width.

    The rows of a key with over 1/``share`` of all rows are dealt over as many
    salts as it has such shares, and its row of ``side`` is repeated for each:
    fewer than 2 * ``share`` copies in all, and no task holds much over one share.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") * share > max(total, share * share))
    hot = [(r[key], -(-r["_n"] * share // total)) for r in counts.collect()]  # fewer than ``share``
    if not hot:
        return rows.join(side, key)
    kind = rows.schema[key].dataType.simpleString()
    salts = F.broadcast(rows.sparkSession.createDataFrame(hot, f"{key} {kind}, _salts long"))
    many = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = rows.join(salts, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), many)).drop("_salts")
    copies = side.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
