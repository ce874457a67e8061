"""Rendezvous (highest random weight) hashing of records over shards.

Every shard draws a pseudo-random number from (key, shard); the record goes to
the shard with the best draw.  A shard that is added can only win records for
itself, one that is removed only loses its own: no other record moves.  With
weights the draw is -w / ln(u), so a shard's share follows its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stored


def uniform(bits: Column) -> Column:
    """A number between 0 and 1, neither included, from 52 bits."""
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)


def draw(keys: Sequence[Column], shard: int, weight: float = 1.0) -> Column:
    """The draw of one shard, as (score, shard); the greater struct wins."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 12)
    return F.struct((F.lit(-float(weight)) / F.log(uniform(bits))).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The winning draw over shards 0 .. len(weights)-1."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight over 0")
    draws = [draw(keys, shard, weight) for shard, weight in enumerate(weights)]
    return F.greatest(*draws) if len(draws) > 1 else draws[0]


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    weights: Sequence[float] | None = None,
    slot_buckets: int = 1024,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Assign each row to a shard and to a slot, gapless from 0, in that shard.

    Returns key, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot and
    grown_shard (the shard if there were one more, of weight 1).

    The slot is a rank that no single task computes: rows are ranked within
    (shard, bucket), and the sums of the buckets before are added.  There are
    shards * ``slot_buckets`` buckets, a bound that makes their counts safe to
    broadcast.  A bucket mixes in the input partition, so that a key that is
    repeated any number of times still spreads.

    Null text counts as empty.  Null keys are one key.  Repeated rows all get
    the shard of their key and slots of their own.  An empty table gives none.
    Other columns are ignored.
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight per shard")
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[key].alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous([docs[key]], weights).alias("best"),
        F.pmod(F.xxhash64(docs[key], F.spark_partition_id()), F.lit(slot_buckets)).cast("int").alias("bucket"),
    )
    rows = stored(
        rows.select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("best.shard").alias("shard"),
            F.greatest("best", draw([F.col("doc_id")], shards))["shard"].alias("grown_shard"),
            "bucket",
        )
    )
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(F.broadcast(starts), ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
