"""Token ids, and token counts from per-worker caches of pre-tokens.

A sentencepiece model never joins what lies on two sides of certain blanks, so
a text can be cut there and each piece looked up.  Pieces of text repeat, so
most lookups end in a hash table; only the rest reach the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import values

#: Entries of one generation of a worker's cache; two generations are held.
CACHE_ENTRIES = 200_000
#: Longer texts are not sampled for the table of frequent pieces.
SAMPLE_TEXT_BYTES = 1 << 14
#: Longer pieces are not kept.
CACHE_KEY_CHARS = 64


class Cache(dict):
    """A hash table with two generations.

    What is asked for moves to the young one; when that is full it becomes the
    old one and the old one goes.  So memory has a bound and what is frequent
    stays.  ``fixed`` entries are always held.
    """

    def __init__(self, compute, fixed: dict | None = None, entries: int = CACHE_ENTRIES):
        super().__init__(fixed or {})
        self.compute, self.fixed, self.entries, self.old = compute, fixed or {}, entries, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.compute(key)
        if len(key) <= CACHE_KEY_CHARS:
            self[key] = value
        return value

    def settle(self) -> None:
        """Between texts: start a new generation if this one is full."""
        if len(self) > self.entries + len(self.fixed):
            self.old = dict(self)
            self.clear()
            self.update(self.fixed)


_PIECE = re.compile(" +[^ \n]*|\n[^ \n]*")


class PieceCounter:
    """Token counts of a sentencepiece BPE model.

    Its pieces hold a blank only at the start, so no merge crosses the border
    before a run of blanks that follows another character; none holds a line
    feed.  Both facts are read off the model, and without them texts stay whole.
    """

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        # The model's own tests: two blanks must stay two, and one in front is added.
        keeps = self.model.encode("a  a", out_type=str)[-2:] != self.model.encode("a a", out_type=str)[-2:]
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.cuts = (
            keeps
            and self.lone == 1
            and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        )
        self.cache = Cache(self.count_piece, frequent)

    def count_piece(self, piece: str) -> int:
        """Tokens of a piece: with a blank before it, unless a line starts it."""
        if not piece:
            return self.lone
        whole = len(self.model.encode(piece, num_threads=1))
        return whole - self.lone if piece[0] == "\n" else whole

    @staticmethod
    def pieces(text: str) -> list[str]:
        """What is counted apart: a word with the blanks before it but for one,
        a line feed with what follows it.  The model reads its own sign for a
        blank as a blank, and puts one before the text."""
        if "▁" in text:
            text = text.replace("▁", " ")
        if "  " not in text and text[:1] != " ":
            return text.replace("\n", " \n").split(" ")
        return [p[1:] if p[0] == " " else p for p in _PIECE.findall(" " + text)]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts:
            return len(self.model.encode(text, num_threads=1))
        n = sum(map(self.cache.__getitem__, self.pieces(text)))
        self.cache.settle()
        return n


class ByteIds:
    """Ids of a byte-level BPE of the tokenizers library, as little-endian
    unsigned 32-bit integers in a bytes object.

    The same vocabulary can be read as ranks, by which tiktoken encodes about
    nine times as fast.  Merging by ranks equals merging by the list of merges
    if ids follow the order of merges and each token's own string is encoded
    as that token; both are checked for the file at hand.  Its pattern and the
    pre-tokenizer's differ at most where the two libraries know different
    versions of Unicode, so only texts of long settled characters go that way,
    and none with the string of a special token.  All others, and all texts if
    the check fails, are encoded by tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.ranks = self._as_ranks(path)

    def _as_ranks(self, path: str):
        """An encoding by ranks, or None if it might differ."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        before = spec["pre_tokenizer"]
        plain = (
            spec["normalizer"] is None
            and before["type"] == "ByteLevel"
            and before["use_regex"]
            and not before["add_prefix_space"]
            and not spec["model"].get("ignore_merges")
        )
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        made = [vocabulary[a + b] for a, b in pairs]
        tokens = [t for t in vocabulary if t not in self.special]
        if not plain or made != sorted(set(made)) or len(tokens) - len(made) != 256 or made[0] != 256:
            return None
        if any([x.id for x in self.model.model.tokenize(t)] != [vocabulary[t]] for t in tokens):
            return None
        ranks = {bytes(map(_BYTE_OF.__getitem__, t)): vocabulary[t] for t in tokens}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks is None or any(s in text for s in self.special) or not is_settled(text):
            return self.encode(text)
        try:
            found = self.ranks.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # runs of about a million blanks exhaust its pattern's stack
            return self.encode(text)
        return found.astype("<u4", copy=False).tobytes()


#: Fixed value: the pre-tokenizer's pattern, as byte-level BPE defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes printable bytes of Latin-1 as themselves and the
    others, in order, as the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


_BYTE_OF = _byte_letters()
#: Latin, Greek, Cyrillic, general punctuation, currency, kana and the first block of Han.
_UNSETTLED = re.compile("[^\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5]")


def is_settled(text: str) -> bool:
    """Only characters whose class no version of Unicode has changed for long."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNSETTLED.search(text) is None
    return True


@lru_cache(maxsize=4)
def byte_ids(path: str) -> ByteIds:
    """One per worker and file, kept between tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteIds(path)


_COUNTERS: dict[str, PieceCounter] = {}


def piece_counter(path: str, table: str, frequent) -> PieceCounter:
    """One per worker and broadcast table, kept between tasks."""
    if table not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[table] = PieceCounter(path, frequent.value)
    return _COUNTERS[table]


def frequent_pieces(docs: DataFrame, path: str, sample_docs: int, entries: int) -> dict[str, int]:
    """The most frequent pieces of a sample of texts, with their token counts.

    The sample is at most ``sample_docs`` whole texts of at most
    ``SAMPLE_TEXT_BYTES``, so what comes to the driver has a bound.  It only
    decides what is looked up first; no result depends on it.
    """
    short = docs.select("text").filter(F.octet_length("text") <= SAMPLE_TEXT_BYTES)
    seen: Counter[str] = Counter()
    for row in short.limit(sample_docs).collect():
        seen.update(p for p in PieceCounter.pieces(row["text"]) if len(p) <= CACHE_KEY_CHARS)
    counter = PieceCounter(path)
    return {p: counter.count_piece(p) for p, _ in seen.most_common(entries)}


def count_tokens(
    docs: DataFrame,
    model: str,
    limit: int = 4096,
    sample_docs: int = 2_000,
    frequent: int = 1 << 16,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    Two tiers, both on the map side, and no shuffle: a broadcast hash table of
    the ``frequent`` most frequent pieces, and a cache in each worker for the
    rest.  Counts are those of the whole text, special strings being ordinary.

    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted
    each, an empty table gives none, other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    table = spark.sparkContext.broadcast(frequent_pieces(own, model, sample_docs, frequent))
    name = f"{model}#{id(table)}"
    kind = own.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model, name, table)
        for batch in batches:
            counts = [counter.count(t) if t else 0 for t in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    sized = own.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
