"""Ordered computations over logs without a task that holds a whole log.

A log (all rows of some keys) can be as long as the input, so a plain window
over it would sort it in one task.  Here each log is cut into chunks that follow
one another and whose size is bounded by a number of rows; windows run within a
chunk, and what the chunks before add comes from a table with a row for each
chunk.  Rows without a column ``chunk`` are logs of one chunk each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a chunk, about.
CHUNK_ROWS = 200_000


def chunk_by_count(rows: DataFrame, keys: Sequence[str], at: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk``, a number that grows with ``at``, if a log needs more than one.

    The longest log is counted first.  If it is longer than ``chunk_rows``, logs
    are counted by thin slices of ``at``, and slices are joined to chunks of
    about that many rows.  Only rows with one and the same ``at`` are never cut.
    """
    logs = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    most = logs.agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if (most["n"] or 0) <= chunk_rows:
        return rows
    width = max(1, (most["high"] - most["low"] + 1) * chunk_rows // (8 * most["n"]))
    sliced = rows.withColumn("_slice", F.floor(F.col(at) / width))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    sofar = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    chunks = counts.select(*keys, "_slice", F.floor(sofar / chunk_rows).alias("chunk"))
    return sliced.join(chunks, [*keys, "_slice"]).drop("_slice")


def _before(rows: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Per chunk: the sum of ``amount`` over all chunks before it."""
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "chunk").agg(F.sum(amount).alias("_amount"))
    return sums.select(*keys, "chunk", F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).cast("long").alias("_before"))


def number_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Contiguous numbers from 0 within each log, in ``order``."""
    if "chunk" not in rows.columns:
        own = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(name, (F.row_number().over(own) - 1).cast("long"))
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside))
    return (
        ranked.join(_before(rows, keys, F.lit(1)), [*keys, "chunk"])
        .withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long"))
        .drop("_before", "_rank")
    )


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """The sum of ``amount`` over the log up to and with each row."""
    if "chunk" not in rows.columns:
        own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(amount).over(own).cast("long"))
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_sum", F.sum(amount).over(inside))
    return (
        summed.join(_before(rows, keys, amount), [*keys, "chunk"])
        .withColumn(name, (F.col("_before") + F.col("_sum")).cast("long"))
        .drop("_before", "_sum")
    )
