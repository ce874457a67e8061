"""Packing of token sequences: exact complements first, then best fit.

What is to be packed is known by its lengths alone, and a length is at most
the capacity.  So the plan is made from the counts of lengths, a table of a
size bounded by the capacity, and handles any number of equal cases at once:
"so many sequences hold a piece of 700, one of 300 and one of 24".  The pieces
themselves stay on the executors and look their place up by their rank among
the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stored, values
from tideline.llm.tokens import byte_ids


#: Pieces that one task ranks, about; buckets of them, a power of two, at most.
BUCKET_PIECES, MAX_BUCKETS = 200_000, 1 << 20


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences that hold pieces of these lengths, in this order."""

    lengths: tuple[int, ...]
    times: int


class ComplementIndex:
    """Which available lengths, alone, in pairs or in threes, have a given sum."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def _pair(self, total: int) -> tuple[int, int] | None:
        """The most even pair: short pieces are left for gaps that only they fill."""
        if total < 2:
            return None
        high = np.arange((total + 1) // 2, total)
        low = total - high
        found = (self.counts[high] > 0) & (self.counts[low] > 0) & ((high != low) | (self.counts[high] > 1))
        at = int(found.argmax())
        return (int(high[at]), int(low[at])) if found[at] else None

    def find(self, total: int) -> tuple[int, ...] | None:
        """One length that is ``total``, else a pair, else a triple with that sum."""
        if self.counts[total] > 0:
            return (total,)
        if pair := self._pair(total):
            return pair
        for high in np.flatnonzero(self.counts[: max(0, total - 1)])[::-1].tolist():
            self.counts[high] -= 1
            pair = self._pair(total - high)
            self.counts[high] += 1
            if pair:
                return (high, *pair)
        return None


def _times(lengths: tuple[int, ...], counts: np.ndarray) -> int:
    need = defaultdict(int)
    for length in lengths:
        need[length] += 1
    return min(int(counts[length]) // n for length, n in need.items())


def plan_packing(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up every count.

    Each sequence begins with the longest piece left.  If a single length, a
    pair or a triple exactly fills its gap, that is consumed, as often as
    availability allows.  If none does, the best-fitting piece (the longest
    that fits) joins and the smaller gap is looked up again, until it is filled
    or nothing fits.

    Every pattern uses up a length, or all but a remainder of it, so the plan's
    size follows the capacity, not the input.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit")
        counts[length] = n
    index, plan = ComplementIndex(counts), []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            lengths, gap = [longest], capacity - longest
            counts[longest] -= 1
            while gap:
                rest = index.find(gap)
                if rest is None:
                    fits = np.flatnonzero(counts[: gap + 1])
                    rest = (int(fits[-1]),) if fits.size else ()
                if not rest:
                    break
                for length in rest:
                    counts[length] -= 1
                lengths += rest
                gap -= sum(rest)
            for length in lengths:
                counts[length] += 1
            times = _times(tuple(lengths), counts)
            for length in lengths:
                counts[length] -= times
            plan.append(Pattern(tuple(lengths), times))
    return plan


def slots_of(plan: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern in plan:
        offset = 0
        for length in pattern.lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += pattern.times
            offset += length
        sequence += pattern.times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, salt."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_ids(tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(values(batch.column(1))):
                ids = coder.ids(text or "") + end
                total = len(ids) // 4
                at, n = 0, 0
                to = total % capacity or capacity
                while at < total:
                    row.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, to, n = to, to + capacity, n + 1
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *longs],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    # Drawn by place, not by content, so that repeated rows spread; it is stored with the piece.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(MAX_BUCKETS)).cast("int")
    return docs.mapInArrow(cut, schema).withColumn("salt", salt)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = 1024,
    bucket_pieces: int = BUCKET_PIECES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset per piece.

    A document is its ids and ``end_id``.  One longer than ``capacity`` is cut
    into pieces of it, the first of which may be shorter.  ``tokenizer`` is the
    path of a byte-level BPE file that every worker can read.

    A piece of full length is a sequence of its own, with a negative id.  All
    others are ranked among the pieces of their length, in buckets whose number
    follows the number of pieces, and look their place up by rank.

    Null text counts as empty: one piece that holds ``end_id``.  Very long texts
    are encoded whole.  Repeated rows are packed each; an empty table gives
    none; other columns are ignored.
    """
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    pieces = stored(tokenized_pieces(own, tokenizer, end_id, capacity))
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    histogram.pop(capacity, None)
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(plan_packing(histogram, capacity)))
    buckets = 16
    while buckets < MAX_BUCKETS and buckets * bucket_pieces < sum(histogram.values()):
        buckets *= 2

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity).select(
        *columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    # Rank among the pieces of a length: within the bucket, plus the buckets before.
    rest = pieces.filter(F.col("length") < capacity).select(*columns, (F.col("salt") % buckets).alias("bucket"))
    counts = rest.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        rest.withColumn("rank", F.row_number().over(inside) - 1)
        .join(starts, ["bucket", "length"])
        .select(*columns, (F.col("first") + F.col("rank")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        span = int(table[:, 1].max(initial=0)) + 1
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * span + np.minimum(rank, span - 1), side="right") - 1
            sequence = table[at, 2] + rank - table[at, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(table[at, 3])],
                [*batch.schema.names[:5], "sequence_id", "offset"],
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.unionByName(full)
