"""Token counts and packing against the tokenizers themselves."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import fixtures
from tests.oracle import DATA
from tideline.llm import packing, queries, tokens

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", "a ", " a", "a  b", "a \nb", "a\n b", "\n", "\n\na", "a\n", "a\t b", "</s> <s>hi", "▁a ▁", "a▁b", "é\r\n x",
    "　x  y", "\U0001d4b3 z", "'s don't", "<|endoftext|> x", "1234 5678\n\n9", "a  b", "x \x1cy", "  z", "i̇ ǅ Σς",
]


@pytest.fixture(scope="module")
def piece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def counter():
    return tokens.PieceCounter(MODEL)


@pytest.fixture(scope="module")
def byte_ids():
    return tokens.ByteIds(JSON)


def expected_ids(byte_ids, text):
    return byte_ids.model.encode(text, add_special_tokens=False).ids


ALPHABET = st.lists(st.sampled_from([*"ab.,'1 \n\té▁\r", "  ", "</s>", "\u2003", "ſ", "日", " the"]), max_size=30).map("".join)


@cache
def one_counter():
    return tokens.PieceCounter(MODEL)


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_counts_equal_the_library(text):
    own = one_counter()
    assert own.count(text) == len(own.model.encode(text))


@settings(max_examples=400, deadline=None)
@given(ALPHABET)
def test_ids_equal_the_library(text):
    own = tokens.byte_ids(JSON)
    assert np.frombuffer(own.ids(text), "<u4").tolist() == expected_ids(own, text)


def test_odd_texts(counter, byte_ids, piece_model):
    assert counter.cuts and byte_ids.ranks is not None
    for text in ODD:
        assert counter.count(text) == len(piece_model.encode(text)), repr(text)
        assert np.frombuffer(byte_ids.ids(text), "<u4").tolist() == expected_ids(byte_ids, text), repr(text)


LONG = {"blanks": " ", "line feeds": "\n", "letters": "a", "indented code": "        x = 1\n", "signs": "▁"}


@pytest.mark.parametrize(("kind", "size"), [*((kind, 1_000_000) for kind in LONG), ("blanks", 4_000_000)])
def test_very_long_runs(counter, byte_ids, piece_model, kind, size):
    text = "start " + LONG[kind] * (size // len(LONG[kind])) + " end"
    assert byte_ids.ids(text) == byte_ids.encode(text)
    assert counter.count(text) == len(piece_model.encode(text))


def test_texts_with_runs_of_blanks_use_the_cache(piece_model):
    own = tokens.PieceCounter(MODEL)
    code = "\n".join("    " * (i % 3) + f"value{i % 5} = other{i % 7}  # note" for i in range(500))
    assert own.count(code) == len(piece_model.encode(code))
    assert 0 < len(own.cache) < 60


def test_every_settled_character_is_encoded_alike(byte_ids):
    for code in range(1, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        text = f"a{chr(code)}1 {chr(code)} b"
        if tokens.is_settled(text):
            assert np.frombuffer(byte_ids.ids(text), "<u4").tolist() == expected_ids(byte_ids, text), hex(code)


def test_a_full_cache_changes_no_count(piece_model):
    small = tokens.PieceCounter(MODEL, {"the": 1})
    small.cache.entries = 5
    for seed in range(20):
        text = fixtures.prose(seed, 50)
        assert small.count(text) == len(piece_model.encode(text))
        assert len(small.cache) <= 5 + 1 + 60


def test_count_tokens_on_odd_documents(spark, piece_model):
    docs = fixtures.documents(spark)
    found = Counter(map(tuple, tokens.count_tokens(docs, MODEL, limit=200).collect()))
    expected = Counter()
    for d in fixtures.rows():
        n = len(piece_model.encode(d[1] or ""))
        expected[d[0], len((d[1] or "").encode()), n, n > 200] += 1
    assert found == expected
    assert tokens.count_tokens(fixtures.empty(spark), MODEL).count() == 0


def test_token_query_equals_brute_force(spark, piece_model):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.queries()["op7_token_counts"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(piece_model.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 4096)


# --- packing


def assert_packed(rows, docs, byte_ids, capacity, end_id):
    """Every document whole, every piece right, every sequence gapless."""
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = Counter()
    for doc_id, text in docs:
        ids = np.array(expected_ids(byte_ids, text or "") + [end_id], "<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_odd_documents(spark, byte_ids):
    docs = fixtures.documents(spark)
    rows = packing.pack_documents(docs, JSON, end_id=2, capacity=64, bucket_pieces=7).collect()
    n = assert_packed(rows, [(d[0], d[1]) for d in fixtures.rows()], byte_ids, 64, 2)
    assert n <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.pack_documents(fixtures.empty(spark), JSON).count() == 0


def test_packing_query_equals_brute_force(spark, byte_ids):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert_packed(queries.queries()["op5_best_fit_packing"](spark, DATA).collect(), docs, byte_ids, 1024, 2)


def best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plans_use_every_piece_and_few_sequences(lengths):
    plan = packing.plan_packing(Counter(lengths), 40)
    used = Counter()
    for pattern in plan:
        assert sum(pattern.lengths) <= 40 and pattern.times > 0
        for length in pattern.lengths:
            used[length] += pattern.times
    assert used == Counter(lengths)
    n = sum(p.times for p in plan)
    assert n >= -(-sum(lengths) // 40)
    assert n <= 1.25 * best_fit(lengths, 40) + 1


def test_exact_complements_are_found():
    plan = packing.plan_packing({700: 5, 324: 2, 300: 3, 24: 3, 1024: 7}, 1024)
    assert sum(p.times for p in plan) == 12
    assert all(sum(p.lengths) == 1024 for p in plan)


def test_pairs_and_triples_fill_gaps():
    plan = packing.plan_packing({1000: 2, 20: 1, 4: 1, 10: 1, 8: 1, 6: 1}, 1024)
    assert sorted(p.lengths for p in plan) == [(1000, 10, 8, 6), (1000, 20, 4)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_plans_of_real_lengths_are_tight_and_use_pairs_and_triples(byte_ids, sf):
    lengths = Counter()
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"])["text"].to_pylist():
        n = len(byte_ids.ids(text or "")) // 4 + 1
        lengths[n % 1024 or 1024] += 1
        lengths[1024] += (n - 1) // 1024
    plan = packing.plan_packing(lengths, 1024)
    least = -(-sum(length * n for length, n in lengths.items()) // 1024)
    assert sum(p.times for p in plan) <= 1.01 * least
    exact = Counter()
    for p in plan:
        if sum(p.lengths) == 1024:
            exact[len(p.lengths)] += p.times
    assert exact[3] and exact[4]


def test_plan_size_follows_the_capacity_not_the_input():
    small = packing.plan_packing({n: 7 + n % 5 for n in range(1, 1025)}, 1024)
    large = packing.plan_packing({n: 10**9 * (7 + n % 5) for n in range(1, 1025)}, 1024)
    assert len(large) < 8 * 1024 and len(packing.slots_of(large)) < 64 * 1024
    assert len(large) <= 2 * len(small)


def test_bad_lengths_are_refused():
    with pytest.raises(ValueError):
        packing.plan_packing({1025: 1}, 1024)
