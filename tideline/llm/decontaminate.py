"""Benchmark decontamination: BM25 retrieval by block-max WAND, then overlap.

The test items are the indexed side; every passage of every training document
is a query.  An item's BM25 weights are divided by the score it gives itself,
so a score is the share of the item that a passage accounts for and one
threshold suits all items.  Retrieval returns all items above the threshold;
each is then verified word for word, its question and its answer apart.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored, values

#: BM25's usual constants.
K1, B = 1.2, 0.75
#: Postings of a block; share of an item's own score that retrieval asks for.
BLOCK, THRESHOLD = 8, 0.6
#: Words of a shingle, and the share of them that both parts must have.
WIDTH, OVERLAP = 5, 0.8
#: An item of fewer words is no evidence.
MIN_WORDS = 5
#: What sums of weights may be off by.
SLACK = 1e-9
#: Ranges of items, short ones first, for which a passage is bounded as a whole.
RANGES = 32
#: Bytes of items that one broadcast index may hold; more take further passes.
SLICE_BYTES = 8 << 20

#: ASCII letters, lower-cased, ASCII digits and bytes of other characters stay; the rest become blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def shingles(words: Sequence[bytes]) -> set[tuple[bytes, ...]]:
    """Distinct shingles of ``WIDTH`` words; the whole sequence if it is shorter."""
    if len(words) < WIDTH:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)}


@dataclass
class Item:
    """A test item: its words, of which the first ``cut`` are the question and
    the rest the answer; half of them, where no boundary is known.

    An item of under ``2 * WIDTH`` words without a boundary of its own is its
    question and its answer at once: it must stand as a whole, in one run.
    """

    item_id: int
    words: list[bytes]
    cut: int | None = None
    question: set = field(init=False)
    answer: set = field(init=False)

    def __post_init__(self) -> None:
        if self.cut is None and len(self.words) < 2 * WIDTH:
            self.question = self.answer = {tuple(self.words)}
            return
        cut = len(self.words) // 2 if self.cut is None else self.cut
        self.question, self.answer = shingles(self.words[:cut]), shingles(self.words[cut:])


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs to know of all items: their number and words, the words
    of the longest, and in how many items a word stands.  Slices of one
    benchmark share them, so that no result depends on the slicing."""

    items: int
    words: int
    longest: int
    spread: Mapping[bytes, int]

    @classmethod
    def of(cls, items: Sequence[Item]) -> Statistics:
        sizes = [len(item.words) for item in items]
        return cls(len(items), sum(sizes), max(sizes, default=0), Counter(word for item in items for word in set(item.words)))


@dataclass
class Postings:
    """Of one word: item numbers in order, impacts, and the largest by block."""

    items: list[int]
    impacts: list[float]
    peaks: list[float] = field(init=False)
    peak: float = field(init=False)

    def __post_init__(self) -> None:
        self.peaks = [max(self.impacts[i : i + BLOCK]) for i in range(0, len(self.impacts), BLOCK)]
        self.peak = max(self.peaks)


def items_of(rows: Sequence[tuple[int, str, str | None]]) -> list[Item]:
    """(item_id, text, answer or null) as items; those of under ``MIN_WORDS``
    words are no evidence and are left out."""
    found = []
    for item_id, text, answer in rows:
        words, rest = words_of(text), words_of(answer)
        if len(words) + len(rest) >= MIN_WORDS:
            found.append(Item(item_id, words + rest, len(words) if rest and words else None))
    return found


class Index:
    """BM25 inverted index with block maxima, over items of ``MIN_WORDS`` or more.

    ``items`` may be a slice of those that ``statistics`` are about.
    """

    def __init__(self, items: Sequence[Item], statistics: Statistics | None = None):
        # By length, as weights follow it: the items of a block get similar maxima.
        self.items = sorted(items, key=lambda i: len(i.words))
        known = statistics or Statistics.of(self.items)
        mean = known.words / max(1, known.items)
        found: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for number, item in enumerate(self.items):
            norm = K1 * (1 - B + B * len(item.words) / mean)
            weights = {}
            for word, n in Counter(item.words).items():
                spread = known.spread[word]
                weights[word] = math.log(1 + (known.items - spread + 0.5) / (spread + 0.5)) * n * (K1 + 1) / (n + norm)
            own = math.fsum(weights.values())
            for word, weight in weights.items():
                found[word].append((number, weight / own))
        self.vocabulary = {word: i for i, word in enumerate(found)}
        self.postings = [Postings(*map(list, zip(*p, strict=True))) for p in found.values()]
        # The last place is for words that no item has.
        self.peaks = np.array([p.peak for p in self.postings] + [0.0])
        self.range = max(1, -(-len(self.items) // RANGES))
        self.range_peaks = np.zeros((len(self.postings), -(-len(self.items) // self.range)), np.float32)
        for term, p in enumerate(self.postings):
            np.maximum.at(self.range_peaks[term], np.array(p.items) // self.range, np.array(p.impacts, np.float32))
        #: A passage is twice as long as the longest item and starts at each half.
        self.stride = max(1, known.longest)

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All (item number, score) with a score of ``threshold`` or more."""
        bounds = self.range_peaks[terms].sum(axis=0) + 1e-4
        found = []
        for part in np.flatnonzero(bounds >= threshold).tolist():
            own = terms[self.range_peaks[terms, part] > 0].tolist()
            found += self.wand(own, threshold, part * self.range, (part + 1) * self.range)
        return found

    def wand(self, terms: Sequence[int], threshold: float, first: int, end_item: int) -> list[tuple[int, float]]:
        """Block-max WAND over the items from ``first`` to before ``end_item``."""
        cursors = [[0, 0, p] for p in map(self.postings.__getitem__, terms)]
        # Bounds are sums in some order; a score is summed exactly, whatever the order.
        found, need = [], threshold - SLACK

        def advance(cursor: list, to: int) -> None:
            items = cursor[2].items
            cursor[1] = at = bisect_left(items, to, cursor[1])
            cursor[0] = items[at] if at < len(items) and items[at] < end_item else None

        for c in cursors:
            advance(c, first)
        cursors = [c for c in cursors if c[0] is not None]

        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[2].peak
                if bound >= need:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, end = 0.0, None
            for c in cursors[: pivot + 1]:
                items = c[2].items
                at = bisect_left(items, item, c[1])
                if at < len(items):
                    block = at // BLOCK
                    bound += c[2].peaks[block]
                    last = items[min(len(items), (block + 1) * BLOCK) - 1]
                    end = last if end is None else min(end, last)
            if bound >= need:
                if cursors[0][0] == item:
                    score = math.fsum(c[2].impacts[c[1]] for c in cursors[: pivot + 1])
                    if score >= threshold:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:
                # No item up to the nearest block end, or the next word's item, can reach it.
                to = end + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, item + 1)
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    advance(c, to)
            cursors = [c for c in cursors if c[0] is not None]
        return found

    def leaks(self, text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
        """(item_id, first word of the passage, score, question and answer overlap)
        for each item that is in the text, by its best passage."""
        if not text or not self.items:
            return []
        words = words_of(text)
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        before = np.concatenate(([0.0], np.cumsum(self.peaks[ids])))
        starts = np.arange(0, max(1, len(words)), self.stride)
        ends = np.minimum(starts + 2 * self.stride, len(words))
        best: dict[int, tuple] = {}
        for start in starts[before[ends] - before[starts] >= threshold - SLACK].tolist():
            terms = np.unique(ids[start : start + 2 * self.stride])
            terms = terms[terms >= 0]
            if self.peaks[terms].sum() < threshold - SLACK:
                continue
            for number, score in self.retrieve(terms, threshold):
                item = self.items[number]
                passage = shingles_of_all(words[start : start + 2 * self.stride], item)
                question, answer = (overlap(part, passage) for part in (item.question, item.answer))
                if min(question, answer) >= OVERLAP and (number not in best or best[number][2] < score):
                    best[number] = (item.item_id, start, score, question, answer)
        return list(best.values())


def shingles_of_all(words: Sequence[bytes], item: Item) -> set[tuple[bytes, ...]]:
    """The passage's shingles, of ``WIDTH`` words and of the lengths of parts that are one shingle."""
    lengths = {WIDTH} | {len(one) for part in (item.question, item.answer) if len(part) == 1 for one in part}
    return {tuple(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1)}


def overlap(part: set, passage: set) -> float:
    """Share of a part's shingles that the passage has; an empty part is all there."""
    return len(part & passage) / len(part) if part else 1.0


def _words(rows: DataFrame) -> DataFrame:
    """(n_words, words): the number of words of each item, and the distinct ones."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = items_of(list(zip(*[values(batch.column(c)) for c in ("item_id", "text", "answer")], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(i.words) for i in items], pa.int64()), pa.array([sorted(set(i.words)) for i in items], pa.list_(pa.binary()))],
                ["n_words", "words"],
            )

    return rows.mapInArrow(split, "n_words long, words array<binary>")


def indexes(benchmark: DataFrame, slice_bytes: int = SLICE_BYTES, answer: str | None = None) -> Iterator[Index]:
    """Indexes over all items, each small enough to broadcast.

    The items' size is summed first.  Up to ``slice_bytes`` there is one index;
    beyond, items are dealt by a hash to as many slices as are needed, and the
    documents are passed over once for each.  All slices share the statistics
    of the whole benchmark.
    """
    answers = benchmark[answer] if answer else F.lit(None)
    own = benchmark.select("item_id", "text", answers.cast("string").alias("answer")).filter("text is not null")
    size = F.octet_length("text") + F.coalesce(F.octet_length("answer"), F.lit(0)) + 16
    total = own.agg(F.sum(size).cast("long").alias("n")).first()["n"] or 0
    slices = max(1, -(-total // slice_bytes))

    def items(part: DataFrame) -> list[Item]:
        return items_of([tuple(r) for r in part.orderBy("item_id", "text", "answer").toLocalIterator()])

    if slices == 1:
        yield Index(items(own))
        return
    counted = stored(_words(own))
    sums = counted.agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.max("n_words").alias("longest")).first()
    spread = stored(counted.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    for i in range(slices):
        part = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)
        # The words of a slice are no larger than the slice.
        words = _words(part).select(F.explode("words").alias("word")).distinct().join(spread, "word")
        known = {bytes(r["word"]): r["n"] for r in words.toLocalIterator()}
        yield Index(items(part), Statistics(sums["n"], sums["words"] or 0, sums["longest"] or 0, known))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, answer: str | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """doc_id, item_id, passage_start, score, question_overlap, answer_overlap.

    One row for each document and item of which at least ``OVERLAP`` of the
    question's and of the answer's 5-word shingles stand in one passage.  Words
    are compared without case and punctuation.  All passages of all documents
    are queries; nothing is shuffled.  ``answer`` names a column of the
    benchmark that holds the answers, ``text`` being the questions; without it
    an item's halves stand for the two.

    An item of under ``MIN_WORDS`` words says too little to be a leak and
    matches nothing; one of under twice ``WIDTH`` must stand in one run.  Null or
    empty texts and items match nothing; very long texts are searched whole.
    Of equal scores the first passage counts.  Repeated rows and repeated items
    give repeated results, an empty table gives none, other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"], docs["text"])
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, passage_start long, score double, question_overlap double, answer_overlap double"
    found = None
    for index in indexes(benchmark, slice_bytes, answer):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own_index = shared.value
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(values(batch.column(1))):
                    for hit in own_index.leaks(text, threshold):
                        rows.append(i)
                        hits.append(hit)
                if hits:
                    item, start, *scores = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows)),
                            pa.array(item),
                            pa.array(start, pa.int64()),
                            *[pa.array(s, pa.float64()) for s in scores],
                        ],
                        ["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"],
                    )

        part = own.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, answer: str | None = None, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test item.

    A null or empty text holds none and stays, whatever its other columns.
    Repeated rows stay or go together; an empty table stays empty, and without
    items all rows stay.
    """
    kept = docs
    for index in indexes(benchmark, slice_bytes, answer):
        kept = kept.filter(_clean(docs.sparkSession.sparkContext.broadcast(index), threshold)(docs["text"]))
    return kept


def _clean(shared: Broadcast, threshold: float) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def is_clean(texts: pd.Series) -> pd.Series:
        index = shared.value
        return pd.Series([not index.leaks(text, threshold) for text in texts], dtype=bool)

    return is_clean
