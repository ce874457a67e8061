"""Near-duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import fixtures
from tests.oracle import DATA
from tideline.llm import components, near_dedup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_set(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_force(docs, width, percent):
    """Counter of (doc_id, n_shingles, component_id, kept), from all pairs."""
    sets = [(i, plain_set(t, width)) for i, t in docs]
    distinct = sorted({s for _, s in sets if s}, key=len)
    parent = {s: s for s in distinct}

    def top(s):
        while parent[s] is not s:
            s = parent[s]
        return s

    for at, a in enumerate(distinct):
        for b in distinct[at + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                x, y = top(a), top(b)
                if x is not y:
                    parent[x] = y
    least = {}
    for i, s in sets:
        if s:
            root = top(s)
            if root not in least or (i is not None and (least[root] is None or i < least[root])):
                least[root] = i
    out = Counter()
    for i, s in sets:
        component = least[top(s)] if s else i
        out[i, len(s), component, i == component] += 1
    return out


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.85), (5, 0.8)])
def test_odd_documents(spark, width, threshold):
    rows = fixtures.rows()
    found = near_dedup.near_duplicates(fixtures.documents(spark), width, threshold).collect()
    assert Counter(map(tuple, found)) == brute_force([(r[0], r[1]) for r in rows], width, round(100 * threshold))
    assert near_dedup.near_duplicates(fixtures.empty(spark)).count() == 0


def variants(rng, n_families, members, edits):
    """Families of texts that drift apart: links are near the threshold and chained."""
    docs = []
    for family in range(n_families):
        words = [f"w{rng.randrange(4000)}" for _ in range(90)]
        for _ in range(members):
            own = list(words)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(9999)}"
            docs.append((len(docs) * 7 % 1009 + 1009 * family, " ".join(own)))
    return docs


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 8])
def test_chains_near_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SET_BLOCK", block)
    docs = variants(random.Random(5), 4, 70, 9)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = near_dedup.near_duplicates(df, 3, 0.85).collect()
    assert Counter(map(tuple, found)) == brute_force(docs, 3, 85)


def test_a_family_of_many_components(spark, monkeypatch):
    """20,000 texts that share most of their words, in 10,000 pairs of near copies."""
    rng, docs = random.Random(9), []
    shared = [f"s{i}" for i in range(60)]
    for pair in range(10_000):
        own = [f"p{pair}w{i}" for i in range(20)]
        for copy in range(2):
            docs.append((2 * pair + copy, " ".join([*shared, *own, *(["tail"] if copy else [])])))
    rng.shuffle(docs)
    shuffled = []
    deal = near_dedup.dealt

    def counted(members, blocks):
        rows = near_dedup.stored(deal(members, blocks))
        sizes = [r["count"] for r in members.groupBy("bucket").count().collect()]
        shuffled.append((rows.count(), sizes))
        return rows

    monkeypatch.setattr(near_dedup, "dealt", counted)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 3, 0.85).collect()}
    assert found == {i: i - i % 2 for i in range(20_000)}
    rows, sizes = shuffled[0]
    # Most texts meet in some bucket, each is shuffled once a block there, and none with its set.
    assert max(sizes) > 5_000
    assert rows <= sum(n * -(-n // near_dedup.BLOCK) for n in sizes) < sum(n * n for n in sizes) / 500
    # Those that look alike by chance meet once more, with their sets.
    for rows, sizes in shuffled[1:]:
        assert rows <= sum(n * -(-n // near_dedup.SET_BLOCK) for n in sizes) < sum(n * n for n in sizes) / 100


def test_query_equals_brute_force(spark):
    """At this size the tables hold near copies on both sides of the threshold."""
    sf_dir = DATA.replace("sf0.001", "sf0.01")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.queries()["op8_minhash_near_dedup"](spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept")
    assert Counter(map(tuple, found.collect())) == brute_force(docs, 3, 85)
    kept = near_dedup.without_near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _, stays in brute_force(docs, 5, 80) if stays}


def test_null_ids_and_ids_with_two_texts(spark):
    one, two, three = (fixtures.prose(i, 80) for i in range(3))
    rows = [(1, one), (None, one), (None, one), (5, two), (6, two), (6, three), (None, three[::-1]), (None, three[::-1]), (None, None), (None, "")]
    docs = fixtures.documents(spark, [fixtures.row(*r) for r in rows])
    kept = near_dedup.without_near_duplicates(docs).collect()
    want = [(1, one), (5, two), (6, three), (None, three[::-1]), (None, three[::-1]), (None, None), (None, "")]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(want)


def test_one_of_each_group_stays(spark):
    docs = fixtures.documents(spark)
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    for gone in (2, 3, 4, 9, 12):
        assert gone not in ids
    for stays in (1, 5, 6, 7, 8, 10, 11, None, -5):
        assert stays in ids
    assert near_dedup.without_near_duplicates(fixtures.empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abcAB \n\t\x0b\x0c\rßé", max_size=60), st.integers(1, 5))
def test_shingle_sets_have_the_right_size(text, width):
    assert len(near_dedup.shingle_set(text, width)) == len(plain_set(text, width))


def test_estimates_are_near_the_truth(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    rows = []
    for overlap in (0, 300, 700, 1000):
        a, b = np.sort(pool[:1000]), np.sort(pool[1000 - overlap : 2000 - overlap])
        rows.append((overlap / (2000 - overlap), near_dedup.signature(a).tolist(), near_dedup.signature(b).tolist()))
    df = spark.createDataFrame(rows, "truth double, a array<long>, b array<long>")
    for r in df.select("truth", near_dedup.estimate(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(r["truth"] - r["got"]) < 0.15
        assert r["truth"] not in (0.0, 1.0) or abs(r["truth"] - r["got"]) < 0.001


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1100)]
    edges = spark.createDataFrame(path + star + [(5, 5), (None, 7)], "u long, v long")
    found = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1100)}
    assert components.connected_components(edges.limit(0)).count() == 0
