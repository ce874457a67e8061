"""Benchmark decontamination and licence scan against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import fixtures
from tests.oracle import DATA
from tideline.llm import decontaminate, license_scan, queries

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(300)]
ITEMS = [(i, " ".join(RNG.choice(VOCABULARY[: 40 + 26 * (i % 10)]) for _ in range(RNG.choice([3, 6, 12, 30, 60]))), None) for i in range(90)]


@pytest.fixture(scope="module")
def index():
    return decontaminate.Index(decontaminate.items_of(ITEMS))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 299), min_size=1, max_size=80), st.floats(0.05, 1.0))
def test_wand_finds_all_above_the_threshold(words, threshold):
    index = _index()
    terms = sorted({t for w in words if (t := index.vocabulary.get(f"w{w}".encode())) is not None})
    if not terms:
        return
    got = dict(index.retrieve(np.array(terms), threshold))
    scores: dict[int, float] = {}
    for t in terms:
        for item, impact in zip(index.postings[t].items, index.postings[t].impacts, strict=True):
            scores[item] = scores.get(item, 0) + impact
    sure = {i for i, s in scores.items() if s >= threshold + 1e-6}
    maybe = {i for i, s in scores.items() if s >= threshold - 1e-6}
    assert sure <= set(got) <= maybe
    assert all(abs(got[i] - scores[i]) < 1e-9 for i in got)


_CACHED: list = []


def _index():
    if not _CACHED:
        _CACHED.append(decontaminate.Index(decontaminate.items_of(ITEMS)))
    return _CACHED[0]


def test_every_planted_item_is_found(index):
    for item_id, text, _ in ITEMS:
        for before, after in ((0, 0), (1, 500), (57, 3), (333, 200)):
            page = fixtures.prose(item_id, before) + " " + text.upper().replace(" ", ",  ") + ". " + fixtures.prose(item_id + 1, after)
            assert (item_id in {hit[0] for hit in index.leaks(page)}) == (len(text.split()) >= decontaminate.MIN_WORDS), (item_id, before)


def test_parts_and_scattered_words_are_not_leaks(index):
    long = [(i, t) for i, t, _ in ITEMS if len(t.split()) >= 30]
    for item_id, text in long:
        words = text.split()
        assert item_id not in {h[0] for h in index.leaks(" ".join(words[: len(words) // 2]))}
        assert item_id not in {h[0] for h in index.leaks(" filler ".join(words))}
    assert index.leaks(None) == index.leaks("") == index.leaks(" . ") == []
    assert decontaminate.Index([]).leaks("w1 w2") == []


def test_short_items_are_no_evidence():
    short = [(1, "yes", None), (2, "the answer", None), (3, "what is the capital of france", None)]
    index = decontaminate.Index(decontaminate.items_of(short))
    assert [i.item_id for i in index.items] == [3]
    assert index.leaks("i said yes and the report gave the answer later") == []
    assert index.leaks("france has what is called the capital of it") == []
    assert [hit[0] for hit in index.leaks("so: What is the capital of France?")] == [3]


def test_a_boundary_of_ones_own():
    question = " ".join(f"q{i}" for i in range(30))
    index = decontaminate.Index(decontaminate.items_of([(1, question, "paris")]))
    assert [hit[0] for hit in index.leaks(f"{question} it is Paris")] == [1]
    assert index.leaks(f"{question} it is Rome") == []


def brute_leaks(text, items):
    """{item_id: (passage_start, score, question, answer)} by scoring every passage against every item."""
    words, out = decontaminate.words_of(text), {}
    known = decontaminate.Statistics.of(items)
    mean = known.words / known.items
    for item in items:
        counts = Counter(item.words)
        norm = 1.2 * (0.25 + 0.75 * len(item.words) / mean)
        weight = {w: math.log(1 + (known.items - known.spread[w] + 0.5) / (known.spread[w] + 0.5)) * n * 2.2 / (n + norm) for w, n in counts.items()}
        own = math.fsum(weight.values())
        for start in range(0, max(1, len(words)), known.longest):
            passage = words[start : start + 2 * known.longest]
            inside = set(passage)
            score = math.fsum(weight[w] / own for w in weight if w in inside)
            if score < decontaminate.THRESHOLD or (item.item_id in out and out[item.item_id][1] >= score):
                continue
            runs = {tuple(passage[i : i + n]) for n in range(1, 10) for i in range(len(passage) - n + 1)}
            parts = [len(part & runs) / len(part) for part in (item.question, item.answer)]
            if min(parts) >= 0.8:
                out[item.item_id] = (start, score, *parts)
    return out


def test_slices_change_nothing_to_the_last_digit(spark):
    rng = random.Random(5)
    items = [(1000 + i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([5, 8, 15, 40]))), None) for i in range(300)]
    texts = [f"{fixtures.prose(i, 30)} {items[i][1]} {fixtures.prose(i, 90)} {items[-i][1]}" for i in range(60)]
    for at in range(0, 60, 2):  # leaks of a part only, near the threshold
        texts[at] = " ".join(w for w in texts[at].split() if rng.random() > 0.04)
    docs = fixtures.documents(spark, [fixtures.row(i, t) for i, t in enumerate(texts)])
    table = spark.createDataFrame([i[:2] for i in items], "item_id long, text string")
    whole = Counter(map(tuple, decontaminate.find_leaks(docs, table).collect()))
    assert sum(whole.values()) > 60
    assert len(list(decontaminate.indexes(table, 12_000))) > 2
    assert Counter(map(tuple, decontaminate.find_leaks(docs, table, slice_bytes=12_000).collect())) == whole
    kept = {r["doc_id"] for r in decontaminate.without_leaks(docs, table, slice_bytes=12_000).collect()}
    assert kept == set(range(60)) - {r[0] for r in whole}
    expected = Counter((i, n, *hit) for i, t in enumerate(texts) for n, hit in brute_leaks(t, decontaminate.items_of(items)).items())
    assert whole == expected


def test_query_equals_scoring_everything(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()
    items = decontaminate.items_of([(r["item_id"], r["text"], None) for r in rows])
    expected = Counter((d["doc_id"], n, *hit) for d in docs for n, hit in brute_leaks(d["text"], items).items())
    assert expected
    assert Counter(map(tuple, queries.queries()["op3_benchmark_decontamination"](spark, DATA).collect())) == expected


def test_odd_documents(spark):
    table = [i[:2] for i in ITEMS]
    long = [i for i, t in table if len(t.split()) >= 12][:3]
    one, two, three = (table[i][1] for i in long)
    items = spark.createDataFrame([*table, (900, None), (901, ""), (902, "!!"), (903, one)], "item_id long, text string")
    texts = [one, "x " + two + " y", None, "", fixtures.prose(2, 300_000) + " " + three]
    rows = [fixtures.row(i, t) for i, t in enumerate(texts)] + [fixtures.row(None, one)] + fixtures.rows()
    docs = fixtures.documents(spark, rows)
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    assert {(0, long[0]), (0, 903), (1, long[1]), (4, long[2]), (None, long[0])} <= found
    clean = decontaminate.without_leaks(docs, items)
    assert clean.columns == docs.columns
    assert clean.count() == len(rows) - sum(1 for r in rows if any(h in found for h in [(r[0], i) for i in range(904)]) and r[1] in texts)
    assert decontaminate.find_leaks(fixtures.empty(spark), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0


def test_query_finds_what_stands_in_the_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    planted = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op3_benchmark_decontamination"](spark, DATA).collect()}
    assert planted <= found
    words = {d["doc_id"]: b" " + b" ".join(decontaminate.words_of(d["text"])) + b" " for d in docs}
    for doc_id, item_id in found - planted:
        text = next(i["text"] for i in items if i["item_id"] == item_id)
        assert b" " + b" ".join(decontaminate.words_of(text)) + b" " in words[doc_id]


def test_licenses(spark):
    mit = license_scan._MIT
    texts = [
        "Copyright (c) 2020 Someone\n\n" + mit,
        mit.upper().replace("\n", "   "),
        mit.replace("sublicense", "sublicence") + "\n// (c) Other, 2021\n",
        "prose\nReleased under the MIT licence!\nmore",
        "head\n\n" + mit + "\n\ntail",
        mit + " and more",
        None,
        "",
        "...",
    ]
    docs = fixtures.documents(spark, [fixtures.row(i, t) for i, t in enumerate(texts)])
    found = {(r["doc_id"], r["unit"], r["position"], r["license_id"]) for r in license_scan.scan_licenses(docs).collect()}
    assert {(0, "text", 0, "MIT"), (1, "text", 0, "MIT"), (2, "text", 0, "MIT"), (3, "line", 1, "MIT")} <= found
    assert not any(doc_id > 4 for doc_id, *_ in found)
    assert {u for d, u, *_ in found if d == 3} == {"line"}
    assert license_scan.scan_licenses(fixtures.empty(spark)).count() == 0
    assert license_scan.scan_licenses(fixtures.documents(spark)).count() == 0
