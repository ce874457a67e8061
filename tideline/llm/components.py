"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tideline.llm.common import discard, join_to_groups, stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every neighbour over u is tied to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    tied = join_to_groups(both, least, "u", "n", total=2 * n)
    return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """u and its neighbours below are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    tied = join_to_groups(down, least, "u", "n", total=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return tied.unionByName(own).filter("u <> v").distinct()


def _state(edges: DataFrame) -> Row:
    """Two sums of a hash of the edges: equal sums, equal edges."""
    return edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("b"),
    ).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root), stored, for every node of ``edges`` (u, v); root is its least node.

    Each round is a few shuffles of narrow rows and is written to the shared
    folder, so that lost executors cost one round at most.  A hub, however many
    edges it has, meets them by broadcast.  The number of
    rounds grows with the logarithm of a component's width.  Self-loops and
    null ends tie nothing.
    """
    edges = stored(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct())
    before, now = None, _state(edges)
    for _ in range(MAX_ROUNDS):
        if now == before or not now["n"]:
            break
        # Neither step makes more edges than there were.
        last, edges = edges, stored(_small_star(_large_star(edges, now["n"]), now["n"]))
        discard(last)
        before, now = now, _state(edges)
    else:
        raise RuntimeError(f"components are still moving after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = stored(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
    discard(edges)
    return found
