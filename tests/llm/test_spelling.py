"""Spelling variants against brute force over all pairs of a small table."""
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import spelling

SMALL = "/root/testdata/sf0.001"

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_length=6, min_count=5, ratio=5, noise=199):
    counts = Counter()
    for ident, text in rows:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if ident is None else ident}:{w}".encode())
            if h % noise == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        close = {w[:i] + w[i + 1:] for i in range(len(w))}
        close |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        close |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        near[w] = (close & set(words)) - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def result(docs, **options):
    found = spelling.spelling_variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(found) == len({r.word for r in found})
    return {tuple(r) for r in found}


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert result(docs) == want
    assert any(form for _, form, *_ in want)


def test_dense_words_against_brute_force(spark):
    """Words over few letters, many with runs, have many neighbours, also by equal edits at several places."""
    import random
    draw = random.Random(3)
    words = ["".join(draw.choice("aab") for _ in range(draw.randint(6, 9))) for _ in range(600)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(60)).capitalize()) for i in range(200)]
    assert result(frame(spark, rows)) == brute(rows)
    assert result(frame(spark, rows), min_count=2, ratio=2, noise=None) == brute(rows, min_count=2, ratio=2, noise=1 << 40)


@pytest.mark.parametrize("length, trie", [(8, 48), (13, 12), (60, 12)])
def test_every_edit_of_a_word(spark, monkeypatch, length, trie):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (6, trie))
    word = "".join("abcdefghijklmn"[(i * i + i // 3) % 14] for i in range(length))
    close = ({word[:i] + word[i + 1:] for i in range(length)} | {word[:i] + "z" + word[i:] for i in range(length + 1)}
             | {word[:i] + "z" + word[i + 1:] for i in range(length)})
    far = {"y" + word[:-1] + "z", word[1:] + "zz", word + "zz"}
    words = {w for w in close | far if len(w) >= 6} | {word}
    rows = [(n, w) for n, w in enumerate(words)]
    got = result(frame(spark, rows), min_count=1, noise=None)
    assert {r[0]: r[4] for r in got}[word] == len({w for w in close if len(w) >= 6})
    assert got == brute(rows, min_count=1, noise=1 << 40)


def test_chains_ties_and_letters(spark):
    counts = {"ärgerlich": 1, "ärgerlichs": 5, "ärgerlichst": 25, "ärgerlichste": 125,
              "wander": 2, "wonder": 10, "wunder": 10, "xwunder": 1, "÷abcde×": 5, "÷abcde": 5}
    text = " ".join(f"{w} " * n for w, n in counts.items()) + "Wander\u0130 \u0100wunderlich9 short"
    rows = [(1, text), (2, None), (3, ""), (None, "Wonder \U0001f600wonder")]
    want = brute(rows, min_count=1, noise=1 << 40)
    got = result(frame(spark, rows), min_count=1, noise=None)
    assert got == want
    forms = {w: (form, root) for w, form, root, *_ in got}
    assert forms["ärgerlich"] == ("ärgerlichs", "ärgerlichste")
    assert forms["xwunder"][0] == "wunder"


def test_edges(spark):
    assert result(frame(spark, [])) == set()
    assert result(frame(spark, [(None, None), (1, "")])) == set()
    long_text = "Repeat " * 300_000 + "repea\u00fft " * 5
    rows = [(7, long_text), (7, long_text)]
    assert result(frame(spark, rows)) == brute(rows)
    rows = [(i, "q" * 20_000 + " " + "q" * (19_999 + i % 3) + "z " + "q" * 10_000 + "x" + "q" * 9_999) for i in range(12)]
    got = result(frame(spark, rows), min_count=4, noise=None)
    assert sorted((len(w), n_near) for w, _, _, _, n_near, _ in got) == [(20_000, 1), (20_000, 2), (20_000, 3), (20_001, 3), (20_002, 1)]
    odd = spark.createDataFrame([(1, "abcdef " * 5, 1, "x", 2)], "doc_id long, text string, n long, word string, node int")
    assert {r[0] for r in result(odd)} >= {"abcdef"}


def test_hot_word_sends_a_row_a_task(spark):
    docs = spark.range(0, 4000, 1, 8).selectExpr("id AS doc_id", "concat(repeat('common ', 50), 'filler') AS text")
    counts = {r.word: r.n for r in spelling.word_counts(docs, noise=None).collect()}
    assert counts == {"common": 200_000, "filler": 4000}
