"""Scans inside keys over range partitions and blocks: equal to plain Python,
and a key with most of the rows spreads over tasks."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tessera.operators import ngrams as N
from tessera.operators import ordinals as Od
from tessera.operators import words as Wd


def hot_rows(n=3000):
    rnd = random.Random(4)
    rows = [(None if k == 5 else k, p, rnd.choice([None, 0, 1, 2])) for p in range(n)
            for k in [rnd.choice([0, 0, 0, 0, 1, 2, 5])]]
    rnd.shuffle(rows)
    return rows


def by_key(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return {k: list(g) for k, g in groupby(ordered, key=lambda r: r[0])}


@pytest.mark.parametrize("parts", [1, 7])
def test_segmented_sums(spark, parts):
    rows = hot_rows()
    want = {}
    for some in by_key(rows).values():
        total = 0
        for _, p, v in some:
            total += v or 0
            want[p] = total
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "k int, p int, v int, rn string")
    out = Od.segmented_sums(frame, ["k"], ["p"], ["v"], parts)
    assert out.columns == ["k", "p", "v", "rn", "v_upto"]
    assert {r.p: r.v_upto for r in out.collect()} == want
    assert Od.segmented_sums(frame.limit(0), ["k"], ["p"], ["v"], parts).collect() == []


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_neighbours(spark, block):
    rows = hot_rows(700)
    want = {}
    for some in by_key(rows).values():
        for i, (_, p, _v) in enumerate(some):
            at = lambda j: (some[j][2], True) if 0 <= j < len(some) else (None, False)
            want[p] = (*at(i - 1), *at(i + 1), *at(i + 2))
    frame = spark.createDataFrame(rows, "k int, p int, v int")
    out = Od.with_neighbours(frame, ["k"], ["p"], "v", before=1, after=2, block=block, num_parts=5)
    assert {r.p: tuple(r)[3:] for r in out.collect()} == want
    assert Od.with_neighbours(frame.limit(0), ["k"], ["p"], "v", after=1).collect() == []


def test_a_hot_key_spreads_over_tasks(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 40).cast("int").alias("k"), F.col("id").alias("p"),
                                       F.lit(1).alias("v"))
    sums = Od.segmented_sums(frame, ["k"], ["p"], ["v"], 16)
    assert sums.where("k = 7").agg(F.max("v_upto")).head()[0] == frame.where("k = 7").count()
    staged = Od._staged(frame, ["k", "p"], 16)
    hot = staged.where("k = 7").groupBy("_part").count().collect()
    assert len(hot) >= 8 and max(r["count"] for r in hot) < 0.2 * 20_000
    near = Od.with_neighbours(frame, ["k"], ["p"], "v", after=1, block=500, num_parts=16)
    assert near.where("not has_after_1").count() == frame.select("k").distinct().count()


def test_one_long_candidate(spark):
    """E1, E2 and D8 on a text that fills several partitions and blocks."""
    rnd = random.Random(9)
    words = [rnd.choice(["a", "##b", "c", "[EOW]", "[3]"]) for _ in range(4000)]
    frame = spark.createDataFrame([(1, i, w, 0.5) for i, w in enumerate(words)], "k int, pos int, token string, prob double")
    merged, started = [], False
    for w in words:
        if "##" in w and merged:
            merged[-1] += w
        else:
            merged.append(w)
        started = started or "##" not in w
    got = Wd.merge_pieces(frame, ["k"]).orderBy("word_no").collect()
    assert started and len(got) == len(merged)
    plain = [r.word.replace("##", "") for r in got]
    assert plain == [w.replace("##", "") for w in merged]
    bigrams = N.word_gram_rows(frame, ["k"], 2, ("pos",), "token").groupBy("gram").count().collect()
    want = {}
    for a, b in zip(words, words[1:]):
        want[f"{a} {b}"] = want.get(f"{a} {b}", 0) + 1
    assert {r.gram: r["count"] for r in bigrams} == want
    glued = Wd.glue_week_tokens(frame.select("k", F.col("pos").alias("word_no"), F.col("token").alias("word"), "prob"), ["k"]).count()
    assert glued == len(words) - sum(a == "[EOW]" and b == "[3]" for a, b in zip(words, words[1:]))
