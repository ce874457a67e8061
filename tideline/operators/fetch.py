"""Batches, segments, sparse index and reads over a log table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.packing import pack_greedy

LOG = ["topic", "partition"]
#: Fixed value: bytes of an index entry.
ENTRY_BYTES = 8


def pack_batches(log: DataFrame, capacity: int) -> DataFrame:
    """Add ``batch_base``, the first offset of a record's batch."""
    return pack_greedy(log, LOG, "offset", "nbytes", capacity, "batch_base")


def summarise_batches(packed: DataFrame) -> DataFrame:
    """One row per batch: base, record count, bytes and times."""
    return packed.groupBy(*LOG, "batch_base").agg(
        F.count("*").alias("batch_count"),
        F.sum("nbytes").alias("batch_bytes"),
        F.min("time_ms").alias("first_ms"),
        F.max("time_ms").alias("last_ms"),
        F.min("chunk").alias("chunk"),
    )


def batch_bodies(packed: DataFrame) -> DataFrame:
    """Batches with their records, as an array in offset order."""
    record = F.struct("offset", "key", "value", "time_ms")
    return packed.groupBy(*LOG, "batch_base").agg(F.array_sort(F.collect_list(record)).alias("records"))


def expand_batches(bodies: DataFrame) -> DataFrame:
    """Records again; the n-th of a batch has offset base + n."""
    return bodies.select(*LOG, "batch_base", F.posexplode("records").alias("n", "record")).select(
        *LOG, (F.col("batch_base") + F.col("n")).cast("long").alias("offset"), "record.key", "record.value", "record.time_ms"
    )


def roll_segments(batches: DataFrame, capacity: int) -> DataFrame:
    """Add ``segment_base``: a new segment when a batch would not fit."""
    return pack_greedy(batches, LOG, "batch_base", "batch_bytes", capacity, "segment_base")


def file_name(base: Column, suffix: str = ".log") -> Column:
    """A base offset in 20 digits."""
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(suffix))


def with_positions(segmented: DataFrame) -> DataFrame:
    """Add ``position``: bytes of the segment before a batch.  A segment is
    bounded by its capacity, so this window is too."""
    before = Window.partitionBy(*LOG, "segment_base").orderBy("batch_base").rowsBetween(Window.unboundedPreceding, -1)
    return segmented.withColumn("position", F.coalesce(F.sum("batch_bytes").over(before), F.lit(0)).cast("long"))


def summarise_segments(segmented: DataFrame) -> DataFrame:
    """One row per segment: next offset, batches, records and bytes."""
    return segmented.groupBy(*LOG, "segment_base").agg(
        F.max(F.col("batch_base") + F.col("batch_count")).alias("next_offset"),
        F.count("*").alias("batches"),
        F.sum("batch_count").alias("records"),
        F.sum("batch_bytes").alias("bytes"),
    )


def sparse_index(segmented: DataFrame, interval: int, recovering: bool = False) -> DataFrame:
    """Index entries (relative offset, position) of each segment.

    On append a batch is indexed if it is the first of its segment or if at
    least ``interval`` bytes end at it since the end of the last indexed one.
    On recovery the distance is counted from start to start instead.  The fold
    is over the batches of one segment, whose number its capacity bounds.
    """
    batch = F.struct("batch_base", "position", "batch_bytes")
    cells = with_positions(segmented).groupBy(*LOG, "segment_base").agg(F.array_sort(F.collect_list(batch)).alias("cells"))
    empty = F.expr("named_struct('mark', cast(null as bigint), 'found', cast(array() as array<struct<base:bigint,position:bigint>>))")

    def step(state: Column, cell: Column) -> Column:
        at = cell["position"] if recovering else cell["position"] + cell["batch_bytes"]
        hit = state["mark"].isNull() | (at - state["mark"] >= interval)
        entry = F.array(F.struct(cell["batch_base"].alias("base"), cell["position"].alias("position")))
        return F.struct(
            F.when(hit, at).otherwise(state["mark"]).alias("mark"),
            F.when(hit, F.concat(state["found"], entry)).otherwise(state["found"]).alias("found"),
        )

    found = F.explode(F.aggregate("cells", empty, step, lambda state: state["found"])).alias("entry")
    return cells.select(*LOG, "segment_base", found).select(
        *LOG,
        "segment_base",
        (F.col("entry.base") - F.col("segment_base")).alias("rel_offset"),
        F.col("entry.position").alias("position"),
    )


def within_capacity(entries: DataFrame, index_bytes: int) -> DataFrame:
    """Add ``fits``: whether an index of ``index_bytes`` has room for the entry,
    those of a segment being written in order."""
    place = F.row_number().over(Window.partitionBy(*LOG, "segment_base").orderBy("rel_offset"))
    return entries.withColumn("fits", place * ENTRY_BYTES <= index_bytes)


def lookup_interval(
    targets: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, low: str, high: str, width: int = 4096
) -> DataFrame:
    """Left join each target to the interval [low, high) that holds it.

    Intervals of a key must not overlap.  Both sides are dealt by the number
    of the ``width`` values they lie in, so the join is an equality: no target
    meets more intervals than start in, or span, its slice.
    """
    slices = F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))
    sliced = intervals.filter(F.col(low) < F.col(high)).withColumn("_slice", F.explode(slices))
    asked = targets.withColumn("_slice", F.floor(F.col(at) / width))
    inside = (F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))
    kept = [c for c in intervals.columns if c not in keys]
    right = sliced.select(*[F.col(k).alias(f"_{k}") for k in keys], "_slice", *kept)
    same = inside & (asked["_slice"] == right["_slice"])
    for k in keys:
        same = same & (asked[k] == right[f"_{k}"])
    return asked.join(right, same, "left").select(*targets.columns, *kept)


def fetch(targets: DataFrame, segmented: DataFrame) -> DataFrame:
    """Read from (topic, partition, target) with a budget of bytes.

    From the batch that holds the target whole batches are taken while the
    bytes so far are under ``byte_need``, within the segment.  One row per
    target and budget: found, first_base, batches, length and next_offset.
    A budget of 0 is found with length 0 and the hit's base as next offset.
    """
    ends = segmented.withColumn("batch_end", F.col("batch_base") + F.col("batch_count"))
    batches = ends.select(*LOG, "segment_base", "batch_base", "batch_end", "batch_bytes")
    hits = lookup_interval(
        targets, batches.select(*LOG, F.col("batch_base").alias("hit"), "batch_end", "segment_base"), LOG, "target", "hit", "batch_end"
    )
    following = batches.select(*LOG, "segment_base", "batch_base", F.col("batch_end").alias("end"), "batch_bytes")
    asked = [*targets.columns, "hit"]
    rows = hits.drop("batch_end").join(following, [*LOG, "segment_base"], "left").filter("hit is null or batch_base >= hit")
    before = Window.partitionBy(*asked).orderBy("batch_base").rowsBetween(Window.unboundedPreceding, -1)
    taken = rows.withColumn("sofar", F.coalesce(F.sum("batch_bytes").over(before), F.lit(0)))
    inside = F.col("sofar") < F.col("byte_need")
    return taken.groupBy(*asked).agg(
        F.count_if(inside & F.col("hit").isNotNull()).alias("batches"),
        F.coalesce(F.sum(F.when(inside, F.col("batch_bytes"))), F.lit(0)).cast("long").alias("length"),
        F.coalesce(F.max(F.when(inside, F.col("end"))), F.col("hit")).alias("next_offset"),
    ).select(
        *targets.columns,
        F.col("hit").isNotNull().alias("found"),
        F.col("hit").alias("first_base"),
        "batches",
        "length",
        "next_offset",
    )
