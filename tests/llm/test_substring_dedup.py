"""Repeated substrings against a brute-force pass over all windows."""

import hashlib
import random

import pytest

from tessera.llm import substring_dedup as sd

SF = "/root/testdata/sf0.001"


def plain(rows, threshold):
    """(n_bytes, n_removed, n_spans, kept) of each (id, text)."""
    seen = {}
    texts = [(t or "").encode() for _, t in rows]
    for data in texts:
        for i in range(len(data) - threshold + 1):
            w = data[i:i + threshold]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - threshold + 1):
            if seen[data[i:i + threshold]] > 1:
                gone[i:i + threshold] = b"\1" * threshold
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(frame, **options):
    cut = sd.remove_repeats(frame, **options).collect()
    assert all(r.n_removed == sum(b - a for a, b in r.spans) and len(r.spans) == r.n_spans for r in cut)
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans,
                   hashlib.sha256(r.kept).hexdigest()) for r in cut)


def want(rows, threshold):
    return sorted((i if i is not None else -1, *p) for (i, _), p in zip(rows, plain(rows, threshold)))


@pytest.mark.parametrize("block, lot", [(1 << 15, 1 << 21), (500, 40)])
def test_documents(spark, monkeypatch, block, lot):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "COMBINE_ROWS", lot)             # 40: a task hands on many small lots
    monkeypatch.setattr(sd, "BUFFER_BYTES", 1 << 20 if lot > 40 else 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == want(rows, 200)
    assert sum(r[2] for r in got(docs)) > 0


@pytest.mark.parametrize("seed", range(3))
def test_random_splices(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choices("abcdé ", k=rng.randint(5, 300))) for _ in range(12)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 5))) + "".join(rng.choices("xy", k=rng.randint(0, 40)))
             * rng.randint(1, 4)) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(frame, lengths=(10, 20, 30, 36, 40), threshold=40) == want(rows, 40)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a" * 199), (4, "b" * 200), (5, "c" * 201), (6, "d" * 5000), (7, "xyz" * 400),
            (8, "e" * 10 + "q" * 200 + "é" * 100), (9, "q" * 200), (9, "q" * 200), (None, "é" * 100)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows],
                                  "doc_id long, text string, places string, doc_no int").repartition(3)
    assert got(frame) == want(rows, 200)
    assert got(frame.limit(0)) == []


def test_one_long_text(spark):
    rng = random.Random(1)
    passage = "".join(rng.choices("abcdefgh", k=700))
    text = "".join(rng.choices("abcdefgh", k=900_000)) + passage + "".join(rng.choices("abcdefgh", k=900_000)) + passage
    frame = spark.createDataFrame([(1, text), (2, passage[100:450])], "doc_id long, text string")
    assert [r[2] for r in got(frame)] == [1400, 350]
