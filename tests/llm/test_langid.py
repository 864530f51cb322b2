"""Language ID: forward-backward against brute force, held-out accuracy, code switches, edges."""

import numpy as np
import pytest

from tessera.llm import langid

SF = "/root/testdata/sf0.01"


def plain_posteriors(scores, transitions):
    e, link = np.exp(scores), np.exp(transitions)
    a, b = np.zeros_like(e), np.ones_like(e)
    a[0] = e[0]
    for t in range(1, len(e)):
        a[t] = (a[t - 1] @ link) * e[t]
        a[t] /= a[t].sum()
    for t in range(len(e) - 2, -1, -1):
        b[t] = link @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = a * b
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [3, 7, 256])
def test_forward_backward(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rng = np.random.default_rng(block)
    lengths = np.array([1, 3, 7, 8, 30, 14, 2, 50])
    scores, transitions = rng.normal(size=(lengths.sum(), 4)), rng.normal(size=(4, 4))
    got, lo = langid.posteriors(scores, lengths, transitions), 0
    for n in lengths:
        assert np.allclose(got[lo:lo + n], plain_posteriors(scores[lo:lo + n], transitions))
        lo += n


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.train(langid.training_sample(docs))


def test_held_out_accuracy(docs, model):
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    rows = docs.select("doc_id", "lang", langid.held_out(docs.doc_id).alias("out")).collect()
    out = [r for r in rows if r.out]
    assert len(found) == len(rows) and len(out) > 200
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in out]) > 0.98
    assert all(0 <= r.score <= 1 for r in found.values())


def test_sample_leaves_held_out_rows_and_labels_alone(spark, docs):
    import zlib
    rows = [(i, f"word{'abc'[i % 3]} alpha", "de" if zlib.crc32(str(i).encode()) % 3 != 1 else "xx") for i in range(300)]
    sample = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_label=50)
    assert {label for _, label in sample} == {"de"} and len(sample) == 50


def test_words_of_switched_text(docs, model):
    texts = {r.lang: r.text for r in docs.filter("n_chars > 800 and n_chars < 3000").orderBy("doc_id").limit(60).collect()}
    parts = [" ".join(texts[k].split()[:60]) for k in ("de", "fr")]
    words = " ".join(parts).lower().split()
    scorer = langid._Scorer(model)
    numbers = scorer.numbers(words)
    p = langid.posteriors(scorer.table[numbers], np.array([len(words)]), model.transitions)
    told = [model.labels[k] for k in p.argmax(axis=1)]
    want = ["de"] * 60 + ["fr"] * 60
    assert np.mean([a == b for a, b in zip(told, want)]) > 0.9


def test_edges(spark, docs, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "der und die " * 300_000), (5, "die"), (5, "die"), (None, "und das")]
    frame = spark.createDataFrame([(i, t, 1.0, "z") for i, t in rows], "doc_id long, text string, score double, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(frame, model).collect()]
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert [g[1] for g in got if g[0] == 4] == ["de"] and len(got) == 7
    assert langid.predict(frame.limit(0), model).collect() == []


def test_no_label_at_all(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(frame).collect()] == [(1, False, "und", 0.0)] or \
           [tuple(r)[2:] for r in langid.identify(frame).collect()] == [("und", 0.0)]


def test_accepted_keeps_columns(spark, docs):
    kept = langid.accepted(docs, 0.4)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_confident_mixtures_are_accepted_and_their_words_labelled(spark, docs, model):
    texts = {r.lang: r.text for r in docs.filter("n_chars > 800 and n_chars < 3000").orderBy("doc_id").limit(60).collect()}
    order = sorted(texts)
    assert len(order) == 4
    mixed = " ".join(" ".join(texts[k].split()[:60]) for k in order)
    schema = "doc_id long, text string, lang string, spans int"
    frame = spark.createDataFrame([(1, mixed, None, 0), (2, "12 34 !!", None, 0), (3, None, None, 0), (None, "12 " + texts["de"], None, 0)], schema)
    got = {r.doc_id: r for r in langid.predict(frame, model, with_spans=True).collect()}
    assert got[1].score < 0.4 < 0.9 < got[1].certainty
    told = [s.lang for s in got[1].spans for _ in range(s.n_words)]
    assert np.mean([a == b for a, b in zip(told, [k for k in order for _ in range(60)])]) > 0.9
    for i, text in ((1, mixed), (None, "12 " + texts["de"])):
        at = 0
        for s in got[i].spans:
            assert s.first_word == at and s.n_words > 0
            at += s.n_words
        assert at == len(text.split())
    assert [(got[i].certainty, got[i].spans) for i in (2, 3)] == [(0.0, [])] * 2
    known = docs.select("doc_id", "text", "lang").withColumn("spans", langid.F.lit(0))
    kept = langid.accepted(known.unionByName(frame.withColumn("doc_id", langid.F.col("doc_id") - 1000)), 0.4)
    assert {r.doc_id for r in kept.filter("doc_id < 0").collect()} == {-999}


def test_no_spans_without_labels(spark):
    frame = spark.createDataFrame([(1, "abc def", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(frame, with_spans=True).collect()] == [("und", 0.0, 0.0, [])]
