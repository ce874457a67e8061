"""Greedy packing: fill a container while the next item fits, else open one.

Where a container starts depends on all containers before it, so this is a
fold, not a window.  A log is folded chunk by chunk in three passes.  First
each chunk is summarised: for every number of leading items that the container
left open before it can still take, how the chunk would end.  Then the
summaries, one small row each, are followed in order, which gives the state in
which each chunk begins.  Last, all chunks are folded at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tideline.functions.scratch import stored


def _next_starts(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, and for a container that starts at each item where the next starts."""
    ends = np.cumsum(sizes)
    following = np.searchsorted(ends, ends - sizes + capacity, side="right")
    return ends, np.maximum(following, np.arange(1, len(sizes) + 1))


def _summary(sizes: np.ndarray, ids: np.ndarray, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For 0, 1, 2 ... leading items taken: bytes needed, and the bytes and
    start of the container that is open at the end."""
    ends, following = _next_starts(sizes, capacity)
    n = len(sizes)
    last = np.arange(n)
    for at in range(n - 1, -1, -1):
        if following[at] < n:
            last[at] = last[following[at]]
    takes = min(int(np.searchsorted(ends, capacity, side="right")), n - 1)
    entry = np.arange(takes + 1)
    opened = last[entry]
    needed = np.concatenate(([0], ends[:takes]))
    return needed.tolist(), (ends[-1] - ends[opened] + sizes[opened]).tolist(), ids[opened].tolist()


def pack_greedy(
    rows: DataFrame, keys: Sequence[str], item: str, size: str, capacity: int, start: str
) -> DataFrame:
    """Add ``start``: the item at which a row's container begins.

    ``rows`` has ``keys``, ``chunk``, ``item`` (a number that grows along the
    log and over its chunks) and ``size``.  An item larger than ``capacity``
    has a container of its own.  Chunks must fit in a task's memory; logs need
    not.
    """
    rows = stored(rows)
    kind = {f.name: f.dataType for f in rows.schema.fields}
    key_fields = [T.StructField(k, kind[k]) for k in keys]
    longs = T.ArrayType(T.LongType())

    def summarise(group: pa.Table) -> pa.Table:
        group = group.sort_by(item)
        sizes, ids = group[size].to_numpy().astype(np.int64), group[item].to_numpy().astype(np.int64)
        needed, used, opened = _summary(sizes, ids, capacity)
        columns = {k: group[k].slice(0, 1) for k in (*keys, "chunk")}
        arrays = {name: pa.array([v], pa.list_(pa.int64())) for name, v in (("needed", needed), ("used", used), ("opened", opened))}
        return pa.table(columns | {"total": pa.array([int(sizes.sum())], pa.int64())} | arrays)

    summary_schema = T.StructType(
        [*key_fields, T.StructField("chunk", T.LongType()), T.StructField("total", T.LongType())]
        + [T.StructField(name, longs) for name in ("needed", "used", "opened")]
    )
    numbers = rows.select(*keys, "chunk", item, size)
    summaries = numbers.groupBy(*keys, "chunk").applyInArrow(summarise, summary_schema)

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, used, opened = None, 0, None
        for part in parts:
            entries = []
            for row in part.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != log:
                    log, used, opened = own, 0, None
                entries.append((used, opened))
                if opened is None:
                    used, opened = int(row.used[0]), int(row.opened[0])
                elif used + row.total <= capacity:
                    used += int(row.total)
                else:
                    taken = int(np.searchsorted(row.needed, capacity - used, side="right")) - 1
                    used, opened = int(row.used[max(taken, 0)]), int(row.opened[max(taken, 0)])
            yield part[[*keys, "chunk"]].assign(
                _used=[e[0] for e in entries], _opened=pd.array([e[1] for e in entries], dtype="Int64")
            )

    entry_schema = T.StructType(
        [*key_fields, T.StructField("chunk", T.LongType()), T.StructField("_used", T.LongType()), T.StructField("_opened", T.LongType())]
    )
    entries = summaries.repartition(*keys).sortWithinPartitions(*keys, "chunk").mapInPandas(follow, entry_schema)

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by(item)
        sizes, ids = group[size].to_numpy().astype(np.int64), group[item].to_numpy().astype(np.int64)
        ends, following = _next_starts(sizes, capacity)
        opened, used = group["_opened"][0].as_py(), group["_used"][0].as_py()
        first = 0 if opened is None else int(np.searchsorted(ends, capacity - used, side="right"))
        starts = np.zeros(len(ids), np.int64)
        starts[:first] = 0 if opened is None else opened
        at = first
        while at < len(ids):
            starts[at : following[at]] = ids[at]
            at = following[at]
        return group.drop_columns(["_used", "_opened"]).append_column(start, pa.array(starts))

    out_schema = T.StructType([*rows.schema.fields, T.StructField(start, T.LongType())])
    begun = rows.join(entries, [*keys, "chunk"]).select(*rows.columns, "_used", "_opened")
    return begun.groupBy(*keys, "chunk").applyInArrow(fold, out_schema)
