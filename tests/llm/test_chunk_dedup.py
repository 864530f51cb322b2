"""Content-defined chunks against a plain sequential chunker, planted passages, edges."""

import random

import numpy as np
import pytest

from tessera.llm import chunk_dedup as cd

SF = "/root/testdata/sf0.01"


def plain_chunks(data):
    table = [int(x) for x in np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint32)]
    cuts, last = [], 0
    for i in range(len(data)):
        h = sum(table[data[i - j]] << j for j in range(min(cd.WINDOW, i + 1))) & 0xFFFFFFFF
        at = i + 1
        if at == len(data) or (at - last >= cd.MIN_CHUNK and h >> (32 - cd.CUT_BITS) == 0 and data[at] & 0xC0 != 0x80):
            while at - last > cd.MAX_CHUNK:
                last += cd.MAX_CHUNK
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                cuts.append(last)
            cuts.append(at)
            last = at
    return cuts


def plain_dedup(rows, min_run=cd.MIN_RUN):
    """(removed bytes, kept text) of each (id, text), first occurrence by id."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        begin, runs = 0, []
        for end in plain_chunks(data):
            piece = data[begin:end]
            if seen.setdefault(piece, (i, begin)) != (i, begin):
                if runs and runs[-1][1] == begin:
                    runs[-1][1] = end
                else:
                    runs.append([begin, end])
            begin = end
        runs = [r for r in runs if r[1] - r[0] >= min_run]
        kept, done = b"", 0
        for a, b in runs:
            kept, done = kept + data[done:a], b
        out[i] = (sum(b - a for a, b in runs), (kept + data[done:]).decode())
    return out


def got(frame):
    return {r.doc_id: (r.n_removed, r.kept_text) for r in cd.remove_duplicate_chunks(frame).collect()}


@pytest.mark.parametrize("lot", [1 << 21, 50])
def test_documents(spark, monkeypatch, lot):
    monkeypatch.setattr(cd, "COMBINE_ROWS", lot)
    monkeypatch.setattr(cd, "BUFFER_BYTES", 1 << 20 if lot > 50 else 1000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    assert got(docs) == plain_dedup([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(2))
def test_cuts(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abcdefé ü", k=rng.randint(1, 3000))).encode() for _ in range(8)] + [b"x" * 20_000, "é".encode() * 9000]
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    ends = cd.cut_points(np.frombuffer(b"".join(texts), np.uint8), starts).tolist()
    assert ends == [int(s) + c for s, t in zip(starts, texts) for c in plain_chunks(t)]


def test_planted_passages_and_clean_documents(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    passages = [text(55) for _ in range(50)]
    rows, planted = [], set()
    for i in range(400):
        body = [text(60), text(60)]
        if i % 2:
            body.insert(1, passages[i % 50])
            planted.add(i)
        rows.append((i, " ".join(body)))
    found = got(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    first = {min(i for i in planted if i % 50 == k) for k in range(50) if any(i % 50 == k for i in planted)}
    again = planted - first
    hit = {i for i, (n, _) in found.items() if n}
    assert hit <= again and len(hit) >= 0.97 * len(again)


def test_insertions_shift_nothing(spark):
    rng = random.Random(9)
    text = "".join(rng.choices("abcdefghij klm", k=5000))
    rows = [(1, text), (2, text[:1000] + "INSERTED" + text[1000:3000] + "x" + text[3000:])]
    found = got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found[1][0] == 0 and found[2][0] > 4500


def test_edges(spark):
    long = "a very long sentence that is repeated word for word in other places, and that goes on for more than a hundred bytes. "
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, long), (5, long), (6, long + "tail"), (None, "z" * 30_000), (None, "z" * 30_000)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, places string, ord int").repartition(4)
    out = [(r.doc_id, r.n_removed) for r in cd.remove_duplicate_chunks(frame).collect()]
    assert len(out) == 9 and dict(out)[4] == 0 and [n for i, n in out if i == 5] == [len(long)] * 2
    assert len({n for i, n in out if i is None}) == 1 and cd.remove_duplicate_chunks(frame.limit(0)).collect() == []
    named = spark.createDataFrame([("a", long), ("b", long), (None, None)], "doc_id string, text string")
    assert sorted(r.n_removed for r in cd.remove_duplicate_chunks(named).collect()) == [0, 0, len(long)]


@pytest.mark.parametrize("ident", [None, 7])
def test_many_documents_without_an_identifier_of_their_own(spark, ident):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    shared = text(60)
    clean = [text(120) for _ in range(1500)]
    marked = [text(40) + " " + shared + " " + text(40) for _ in range(1500)]
    rows = [(ident, t) for t in clean + marked + marked[:100]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = cd.remove_duplicate_chunks(frame)
    removed = {}
    for r in out.collect():
        removed.setdefault((r.kept_text, r.n_bytes), []).append(r.n_removed)
    assert sum(map(len, removed.values())) == len(rows)
    assert all(removed.get((t, len(t))) == [0] for t in clean)          # unique texts stay whole
    whole = [t for t in marked if (t, len(t)) in removed]
    assert 1 <= len(whole) <= 0.03 * len(marked)                        # the first, and passages whose cuts miss


def test_names_tell_null_documents_apart(spark):
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(3000)], "doc_id long, text string")
    assert cd._keyed(docs, "doc_id", "text").select("ord", "th").distinct().count() == 3000
