"""The pipeline: stage by stage, and its parts against brute force."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm import fixtures, test_native, test_near_dedup, test_tokens
from tests.oracle import DATA
from tideline.llm import tokens


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_stages_narrow_down(spark, stages):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for kept in stages[:-1]:
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= before
        before = ids
    assert {r["doc_id"] for r in stages[-1].select("doc_id").collect()} == before


def test_stages_equal_brute_force(spark, stages):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    signals = {i: test_native.plain_signals(t) for i, t in docs}
    # So few labels license no cutoff: the base rules decide.
    kept = {i for i, (n, _, _, _, repeated) in signals.items() if n >= 50 and 100 * repeated <= 50 * n}
    assert {r["doc_id"] for r in stages[0].collect()} == kept
    known = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert {i for i, _ in known} == kept
    groups = test_near_dedup.brute_force(known, 5, 80)
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, _, _, stays in groups if stays}
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in stages[2].collect() if not any(text in r["text"] for text in items)}
    assert {r["doc_id"] for r in stages[3].collect()} == clean
    coder = tokens.ByteIds(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    last = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    test_tokens.assert_packed(stages[4].collect(), last, coder, corpus_pipeline.CAPACITY, corpus_pipeline.END_ID)


def test_run_gives_the_same_pieces(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, DATA).select(columns)
    assert Counter(map(tuple, run.collect())) == Counter(map(tuple, stages[-1].select(columns).collect()))


def test_stages_take_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", fixtures.documents(spark)), ("empty", fixtures.empty(spark))):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}{number}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{number}")
        if name == "empty":
            assert docs.count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
