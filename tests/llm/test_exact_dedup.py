"""Exact groups: brute force, hot texts dealt over ranges, edges."""

import hashlib
import re

from tessera.llm import exact_dedup as ed


def plain(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame, **options):
    return sorted((tuple(r) for r in ed.exact_groups(frame, **options).collect()), key=str)


def test_hot_texts_are_dealt(spark):
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i % 40}" if i % 3 == 1 else f"own\t{i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(frame, hot_share=0.005) == plain(rows) == got(frame, hot_share=1.0)


def test_edges(spark):
    rows = [(5, None), (3, ""), (4, " "), (9, "\t\n"), (1, "a b"), (2, "a \x0b\x0c b"), (7, "a\u00a0b"), (None, "a b"), (None, "x"),
            (8, "y"), (8, "y"), (6, "z " * 200_000), (10, "z  " * 200_000)]
    frame = spark.createDataFrame([(i, t, "clash", 1, "q") for i, t in rows],
                                  "doc_id long, text string, norm string, h int, text_sha256 string").repartition(4)
    assert got(frame) == plain(rows)
    kept = ed.unique_documents(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1 for r in kept.collect())) == [-1, 1, 3, 4, 6, 7, 8]
    assert got(frame.limit(0)) == [] and ed.unique_documents(frame.limit(0)).collect() == []


def test_sorted_aggregation_needs_no_further_shuffle(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert ed.exact_groups(frame).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
