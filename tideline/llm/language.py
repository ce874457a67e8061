"""Language identification with bit-sliced Bloom filters of n-grams.

Each language has a Bloom filter of its frequent n-grams.  The filters share
their hash functions and are stored sliced: one word per position, in which
bit l is the bit of language l.  The AND of an n-gram's words is the mask of
all languages that contain it, so one probe asks every language.  A text's
n-grams are counted per mask, the masks' bits per language, and the share that
false positives add is taken off before the largest count decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import values

#: Bytes of an n-gram; n-grams a language's filter takes; languages of a set of filters at most.
NGRAM, FILTER_NGRAMS, MAX_LANGUAGES = 5, 5_000, 64
#: Labelled documents of a language that are learnt from, at most.
SAMPLE_DOCS = 2_000
PROBES = 4
UNKNOWN = "und"
#: A text is in no language if a smaller share of its n-grams is in the best
#: filter than this part of a low quantile of labelled documents' own shares.
SHARE_QUANTILE, SHARE_PART = 0.01, 0.5
#: Bytes of a text that are handled at once.
BLOCK = 1 << 22

#: ASCII letters, lower-cased, and all bytes of other characters stay; the rest become blanks.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def grams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, block by block, as 64-bit integers.

    Runs of what is not a letter are one blank, so that word ends count.
    """
    folded = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    for at in range(0, max(1, len(folded) - NGRAM + 1), BLOCK):
        data = np.frombuffer(folded[at : at + BLOCK + NGRAM - 1], np.uint8)
        if len(data) < NGRAM:
            return
        codes = data[: len(data) - NGRAM + 1].astype(np.uint64)
        for i in range(1, NGRAM):
            codes = (codes << np.uint64(8)) | data[i : len(data) - NGRAM + 1 + i]
        yield codes


def positions(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """Of each n-gram: ``PROBES`` positions in a filter of 2 ** ``bits`` words."""
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    first = (mixed >> np.uint64(32)).astype(np.uint32)
    step = mixed.astype(np.uint32) | np.uint32(1)
    return [(first + np.uint32(i) * step) >> np.uint32(32 - bits) for i in range(PROBES)]


@dataclass(frozen=True)
class Model:
    """The sliced filters, the languages by bit, and each filter's false positive rate.

    Languages beyond ``MAX_LANGUAGES`` are in further sets of filters, ``more``.
    """

    languages: tuple[str, ...]
    words: np.ndarray
    false_rate: np.ndarray
    min_share: float = 0.0
    more: tuple[Model, ...] = ()

    @property
    def all_languages(self) -> tuple[str, ...]:
        return sum((m.languages for m in self.more), self.languages)

    @property
    def bits(self) -> int:
        return len(self.words).bit_length() - 1

    def masks(self, codes: np.ndarray) -> np.ndarray:
        at = positions(codes, self.bits)
        found = self.words[at[0]]
        for p in at[1:]:
            found &= self.words[p]
        return found

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """n-grams in each language's filter, and of the text."""
        found, total = np.zeros(len(self.languages)), 0
        for codes in grams(text):
            masks = self.masks(codes)
            total += len(masks)
            for byte in range(-(-len(self.languages) // 8)):
                per_mask = np.bincount((masks >> np.uint64(8 * byte)).astype(np.uint8), minlength=256)
                here = found[8 * byte : 8 * byte + 8]
                here += (per_mask @ _BIT_TABLE)[: len(here)]
        return found, total

    def true_counts(self, text: str) -> tuple[np.ndarray, int]:
        """Counts of all languages, without what false positives add."""
        found, total = self.counts(text)
        true = np.clip((found - self.false_rate * total) / (1 - self.false_rate), 0, None)
        return np.concatenate([true, *(m.true_counts(text)[0] for m in self.more)]), total

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its score and its share of the n-grams, or ``und``, 0 and 0 without a letter."""
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        true, total = self.true_counts(text)
        best = int(true.argmax())
        rest = np.delete(true, best).max(initial=0.0)
        # Evidence against the runner-up, with one n-gram for each as a prior.
        return self.all_languages[best], float((true[best] + 1) / (true[best] + rest + 2)), float(true[best] / max(1, total))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its score, or ``und`` and 0 without a letter."""
        return self.judge(text)[:2]


_BIT_TABLE = (np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1


def build_filters(ngrams: dict[str, np.ndarray]) -> Model:
    """Filters of up to ``MAX_LANGUAGES`` languages, each over its n-grams."""
    languages = tuple(sorted(ngrams))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a mask has {MAX_LANGUAGES} bits")
    most = max((len(codes) for codes in ngrams.values()), default=0)
    bits = max(16, math.ceil(math.log2(max(1, 8 * most))))
    words = np.zeros(1 << bits, np.uint64)
    for bit, language in enumerate(languages):
        for at in positions(ngrams[language], bits):
            np.bitwise_or.at(words, at, np.uint64(1 << bit))
    fill = np.array([float(((words >> np.uint64(bit)) & np.uint64(1)).mean()) for bit in range(len(languages))])
    return Model(languages, words, fill**PROBES)


def build_all_filters(ngrams: dict[str, np.ndarray]) -> Model:
    """Filters of any number of languages, in sets of up to ``MAX_LANGUAGES``."""
    names = sorted(ngrams)
    sets = [names[at : at + MAX_LANGUAGES] for at in range(0, max(1, len(names)), MAX_LANGUAGES)]
    first, *more = [build_filters({name: ngrams[name] for name in part}) for part in sets]
    return replace(first, more=tuple(more))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, filter_ngrams: int = FILTER_NGRAMS) -> Model:
    """Filters from labelled documents (doc_id, text, lang).

    Of each language about ``sample_docs`` documents are taken, by a hash of
    their id; whole texts are read.  All labels are languages.  A filter takes
    the ``filter_ngrams`` n-grams that occur most, so that each 64 languages
    stay at 3 MB on the driver and their filters at 1 MB.
    """
    labelled = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return build_filters({})
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    shares = docs.sparkSession.createDataFrame(
        [(row["lang"], min(1.0, sample_docs / row["count"])) for row in sizes], "lang string, _share double"
    )
    wanted = labelled.join(F.broadcast(shares), "lang").filter(drawn < F.col("_share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(*map(values, batch.columns), strict=True):
                texts.setdefault(lang, []).extend(grams(text))
            for lang, codes in ((lang, codes) for lang, codes in texts.items() if codes):
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n, pa.int64())],
                    ["lang", "gram", "n"],
                )

    counted = (
        wanted.select("text", "lang")
        .mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= filter_ngrams)
    ngrams: dict[str, list[int]] = {row["lang"]: [] for row in sizes}
    for row in top.select("lang", "gram").toLocalIterator():
        ngrams[row["lang"]].append(row["gram"])
    ngrams = {lang: np.array(codes, np.int64).astype(np.uint64) for lang, codes in ngrams.items()}
    model = build_all_filters(ngrams)
    return replace(model, min_share=least_share(wanted, model))


def least_share(docs: DataFrame, model: Model) -> float:
    """``SHARE_PART`` of the ``SHARE_QUANTILE`` of the shares of n-grams that
    are in the filter of the document's own language; 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        bits = {language: bit for bit, language in enumerate(own.all_languages)}
        for batch in batches:
            found = []
            for text, lang in zip(*map(values, batch.columns), strict=True):
                true, total = own.true_counts(text)
                found += [float(true[bits[lang]] / total)] if total and any(map(str.isalpha, text)) else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["share"])

    measured = docs.select("text", "lang").mapInArrow(shares, "share double")
    low = measured.agg(F.percentile_approx("share", SHARE_QUANTILE, 10_000).alias("low")).first()["low"]
    return SHARE_PART * (low or 0.0)


def predict_languages(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id unless given), lang_pred and score per row.

    A null text, or one without a letter, gets ``und`` and 0.
    """
    spark = docs.sparkSession
    keep = keep or ["doc_id"]
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(text) for text in values(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*keep, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(docs["text"].alias("_text"), *[docs[c] for c in keep]).mapInArrow(
        predict, f"{schema}, lang_pred string, score double"
    )


def with_known_language(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in some language.

    Rejected are texts without a letter, those for which no language has more
    evidence than another (a score of ``min_score`` or less) and those of whose
    n-grams the language knows less than the model's ``min_share``: junk, or a
    language that was not learnt.

    Null and empty texts are rejected, very long ones are judged whole.
    Repeated rows stay or go together, an empty table stays empty, and a model
    that learnt nothing rejects all rows.  Only ``text`` is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def is_known(texts: pd.Series) -> pd.Series:
        own = shared.value
        found = [own.judge(text) for text in texts]
        return pd.Series(
            [language != UNKNOWN and score > min_score and share >= own.min_share for language, score, share in found], dtype=bool
        )

    return docs.filter(is_known(docs["text"]))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id is not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def for_learning(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(docs["doc_id"]) & docs["doc_id"].isNotNull())


def identify_languages(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    Learns from documents that are not held out; a null doc_id is neither held
    out nor learnt from.  Very long texts are learnt from and judged whole, in
    blocks.  Repeated rows get equal answers, an empty table none.
    """
    own = docs.select(docs["doc_id"], docs["text"], docs["lang"])
    model = learn(for_learning(own), sample_docs)
    return predict_languages(own, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
