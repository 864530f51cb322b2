"""SimHash groups against all pairs, and the covering property of the anchors."""

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    import re
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(ids, fps, t=4):
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= t) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: low[find(i)] for i, d in enumerate(ids)}


def test_all_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    ids = [r.doc_id for r in rows]
    fps = [plain_fingerprint(r.text) for r in rows]
    groups = plain_groups(ids, fps)
    assert got == {d: (f"{f:016x}", groups[d]) for d, f in zip(ids, fps)}


@pytest.mark.parametrize("work, width", [(1 << 27, 1), (64, 1), (1 << 27, 2), (64, 2)])
def test_random_fingerprints_near_each_other(spark, monkeypatch, work, width):
    monkeypatch.setattr(simhash, "PAIR_WORK", work)          # 64: every anchor is dealt over many tasks
    rng = np.random.default_rng(3)
    fps = []
    for centre in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist() + [0, (1 << 64) - 1]:
        for _ in range(12):
            fps.append(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from tessera.llm.components import component_roots
    frame = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(4)
    roots = {r.node: r.root for r in component_roots(simhash.links(frame, width=width)).collect()}
    want = plain_groups(list(range(len(fps))), fps)
    got_groups, want_groups = {}, {}
    for i, s in enumerate(signed):
        got_groups.setdefault(roots.get(s, s), set()).add(i)
        want_groups.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, got_groups.values())) == sorted(map(sorted, want_groups.values()))


def test_anchor_code_covers_every_word():
    patterns, first = simhash._errors_by_syndrome(4)
    n3 = [(np.bitwise_count(patterns[first[s]:first[s + 1]]) <= 3).sum() for s in range(2048)]
    assert set(n3) == {1}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one Two"), (5, "ONE two"), (6, "one two three four"), (None, "one two"),
            (4, "one Two")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, fp string, h int")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs).collect())
    two = f"{plain_fingerprint('one two'):016x}"
    four = f"{plain_fingerprint('one two three four'):016x}"
    assert got == sorted([(1, "0" * 16, 1), (2, "0" * 16, 1), (3, "0" * 16, 1), (4, two, 4), (4, two, 4), (5, two, 4),
                          (-1, two, 4), (6, four, 6)])
    assert simhash.simhash_groups(docs.limit(0)).collect() == []
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6]


def test_very_long_text():
    text = ("alpha beta gamma delta " * 50_000).encode()
    assert simhash.text_fingerprint(text) == plain_fingerprint(text.decode()[:0] + "alpha beta gamma delta " * 50_000)


def test_one_row_of_every_group_with_null_and_repeated_identifiers(spark):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 40)) for _ in range(60)]
    rows = [(None, t) for t in texts[:20]]                   # as many groups under one null
    rows += [(7, t) for t in texts[20:40]]                   # and under one repeated identifier
    rows += [(100 + i, t) for i, t in enumerate(texts[40:])]
    rows += [(3, texts[20]), (7, texts[40]), (None, texts[41]), (None, None), (None, ""), (7, texts[21])]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, digest string, fp int").repartition(5)
    got = simhash.one_per_group(docs)
    assert got.columns == docs.columns
    kept = sorted((r.text or "", r.doc_id) for r in got.collect())
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    assert len({plain_fingerprint(t) for t in groups}) == len(groups) == 61
    want = sorted((t, min((i for i in ids if i is not None), default=None)) for t, ids in groups.items())
    assert kept == want
    # a row of a smaller identifier's group does not stand for its identifier's own group
    near = simhash.one_per_group(spark.createDataFrame([(1, texts[0]), (2, texts[0]), (2, texts[1])], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in near.collect()) == [(1, texts[0]), (2, texts[1])]
