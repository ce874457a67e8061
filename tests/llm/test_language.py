"""Language ID: held-out accuracy, and the filters against exact sets."""

from __future__ import annotations

import base64
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import fixtures
from tests.oracle import DATA
from tideline.llm import language, queries

CLEAN = DATA.replace("sf0.001", "sf0.01")


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{CLEAN}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.queries()["op9_language_id"](spark, CLEAN).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_grams(text):
    lower = text.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
    folded = b" " + b" ".join(re.findall(rb"[a-z\x80-\xff]+", lower)) + b" "
    return [folded[i : i + 5] for i in range(len(folded) - 4)]


def test_query_equals_exact_sets(spark):
    """Plain sets of n-grams in place of filters: answers differ only where two languages are close."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    seen = defaultdict(Counter)
    for d in docs:
        if d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5:
            seen[d["lang"]].update(plain_grams(d["text"]))
    known = {lang: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.FILTER_NGRAMS]} for lang, c in seen.items()}
    found = {r["doc_id"]: r["lang_pred"] for r in queries.queries()["op9_language_id"](spark, DATA).collect()}
    assert len(found) == len(docs)
    for d in docs:
        if not any(map(str.isalpha, d["text"] or "")):
            assert found[d["doc_id"]] == "und"
            continue
        hits = {lang: sum(g in own for g in plain_grams(d["text"])) for lang, own in known.items()}
        best = max(hits.values())
        # False positives add at most a few hits of a text's n-grams.
        assert hits[found[d["doc_id"]]] >= best - 1 - 0.005 * len(plain_grams(d["text"]))


def test_very_long_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learn(language.for_learning(docs))
    text = docs.filter("length(text) > 300").first()["text"]
    rows = [fixtures.row(1, text), fixtures.row(2, (text + " ") * (9_000_000 // len(text)))]
    assert len({r["lang_pred"] for r in language.predict_languages(fixtures.documents(spark, rows), model).collect()}) == 1
    assert language.with_known_language(fixtures.documents(spark, rows), model).count() == 2


def test_answers_ignore_lang_and_source(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learn(language.for_learning(docs))
    text = docs.first()["text"]
    rows = [fixtures.row(i, text, lang, source) for i, (lang, source) in enumerate([("en", "a"), (None, None), ("zz", "b")])]
    found = language.predict_languages(fixtures.documents(spark, rows), model).collect()
    assert len({(r["lang_pred"], r["score"]) for r in found}) == 1


def test_odd_documents(spark):
    docs = fixtures.documents(spark)
    rows = language.identify_languages(docs).collect()
    assert len(rows) == len(fixtures.rows())
    texts = {}
    for d in fixtures.rows():
        texts.setdefault(d[0], d[1])
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, texts[r["doc_id"]] or "")))
        assert r["lang_pred"] in ("und", "en", "de", "fr")
    assert language.identify_languages(fixtures.empty(spark)).count() == 0
    no_labels = fixtures.documents(spark, [fixtures.row(1, "text", None), fixtures.row(2, "more", None)])
    assert {r["lang_pred"] for r in language.identify_languages(no_labels).collect()} == {"und"}


def test_stage_keeps_columns_and_what_has_a_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learn(language.for_learning(docs))
    kept = language.with_known_language(docs, model)
    assert kept.columns == docs.columns
    assert kept.filter("length(text) > 300").count() == docs.filter("length(text) > 300").count()
    odd = language.with_known_language(fixtures.documents(spark), model)
    assert {5, 6, 7, 13}.isdisjoint({r["doc_id"] for r in odd.collect()})


def test_stage_rejects_junk_and_unlearnt_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learn(language.for_learning(docs))
    rng = random.Random(1)
    finnish = "Tämä on suomenkielinen teksti, jossa kerrotaan talosta ja metsästä, ja siitä miten ihmiset asuivat järven rannalla monta vuotta sitten."
    texts = [
        base64.b64encode(rng.randbytes(2000)).decode(),
        rng.randbytes(2000).hex(),
        " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(300)),
        finnish,
    ]
    assert all(model.predict(text)[1] > 0.5 for text in texts)
    known = docs.filter("length(text) > 300").first()["text"]
    rows = fixtures.documents(spark, [fixtures.row(i, text) for i, text in enumerate([*texts, known])])
    assert [r["doc_id"] for r in language.with_known_language(rows, model).collect()] == [len(texts)]


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = fixtures.prose(1, 400) + " Übermäßig naïve 12,34 日本"
    whole = np.concatenate(list(language.grams(text)))
    monkeypatch.setattr(language, "BLOCK", 64)
    assert np.array_equal(np.concatenate(list(language.grams(text))), whole)
    assert list(language.grams("")) == [] or sum(map(len, language.grams(""))) == 0


@pytest.mark.parametrize("n_languages", [1, 4, 64])
def test_masks_hold_all_languages_of_a_gram(n_languages):
    rng = np.random.default_rng(1)
    grams = {f"l{i:02}": rng.integers(0, 2**40, 3000, dtype=np.uint64) for i in range(n_languages)}
    model = language.build_filters(grams)
    for bit, name in enumerate(model.languages):
        assert ((model.masks(grams[name]) >> np.uint64(bit)) & np.uint64(1)).all()
    other = rng.integers(2**40, 2**41, 50_000, dtype=np.uint64)
    for bit in range(n_languages):
        rate = float(((model.masks(other) >> np.uint64(bit)) & np.uint64(1)).mean())
        assert abs(rate - model.false_rate[bit]) < 0.01


def test_too_many_languages_are_refused():
    with pytest.raises(ValueError):
        language.build_filters({str(i): np.zeros(1, np.uint64) for i in range(65)})


def test_every_language_takes_part(spark):
    rng = random.Random(2)
    words = {f"l{i:03}": ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(12)] for i in range(70)}
    rows = [(f"{name}-{j}", " ".join(rng.choices(own, k=60)), name) for name, own in words.items() for j in range(2)]
    rows += [(f"more-{name}", " ".join(rng.choices(words[name], k=60)), name) for name in list(words)[:64]]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = language.learn(docs)
    assert model.all_languages == tuple(sorted(words))
    found = language.predict_languages(docs, model, ["doc_id", "lang"])
    assert found.count() == len(rows) and found.filter("lang_pred <> lang").count() == 0
    assert language.with_known_language(docs, model).count() == len(rows)
