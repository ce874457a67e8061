"""Consumer groups: commits, compaction, assignment and liveness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = ["topic", "partition"]


def latest(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The last value of each key; aggregated on the map side first."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def assign_round_robin(members: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, partition, member): partition p goes to the p-mod-n-th member.

    Members are counted by name within each topic; topics that are unknown or
    have no partition are skipped.
    """
    by_name = Window.partitionBy("topic").orderBy("member")
    ranked = members.select(
        "topic", "member", (F.row_number().over(by_name) - 1).alias("place"), F.count("*").over(Window.partitionBy("topic")).alias("n")
    )
    parts = topics.filter("num_partitions > 0").select("topic", F.explode(F.expr("sequence(0L, num_partitions - 1)")).alias("partition"))
    sizes = ranked.select("topic", "n").distinct()
    placed = parts.join(sizes, "topic").withColumn("place", F.col("partition") % F.col("n"))
    return placed.join(ranked.drop("n"), ["topic", "place"]).select("topic", "partition", "member")


def gaps(rows: DataFrame, key: str, at: str, timeout_ms: int) -> DataFrame:
    """Add ``expired``: the time since the key's row before is at least the timeout."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    return rows.withColumn("expired", F.coalesce(F.col(at) - before >= timeout_ms, F.lit(False)))


def first_status(*cases: tuple[Column, str]) -> Column:
    """The name of the first case that holds, or NULL_ERROR, which is success."""
    found = None
    for holds, name in cases:
        found = F.when(holds, name) if found is None else found.when(holds, name)
    return found.otherwise("NULL_ERROR")
