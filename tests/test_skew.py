"""A hot key with most of the rows, in many files: same results as plain Python,
and plans that cut to the keys before any lookup."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import lmprep as L
from tessera.operators import ngrams as N
from tessera.operators import ordinals as Od
from tessera.operators import scores as S
from tessera.operators.lookup import classes_of_words, lookup_words
from tessera.plans import evaluation as EV
from tessera.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """(rows, frame): 4,000 words of 40 customers in 25 files; customer 7 and word 'm1' have most of them."""
    rnd = random.Random(8)
    rows = [(7 if rnd.random() < 0.8 else rnd.randint(0, 39), i % 3, i, "m1" if rnd.random() < 0.6 else f"m{rnd.randint(0, 30)}", rnd.random())
            for i in range(4000)]
    path = str(tmp_path_factory.mktemp("hot") / "words")
    spark.createDataFrame(rows, "csno int, cand_no int, event_id int, word string, score double").repartition(25).write.parquet(path)
    frame = spark.read.parquet(path)
    assert len(frame.inputFiles()) == 25
    return rows, frame


def test_lookup_and_class_sets(spark, hot):
    rows, frame = hot
    classes = {f"m{i}": i % 4 for i in range(0, 31, 2)} | {"m1": 9}
    wc = spark.createDataFrame(list(classes.items()), "word string, class_id int")
    want = {}
    for c, _, _, w, _ in rows:
        want.setdefault(c, set()).update([classes[w]] if w in classes else [])
    got = {r.csno: r.classes for r in classes_of_words(frame, ["csno"], wc).collect()}
    assert got == {c: sorted(x) for c, x in want.items()}
    hits = lookup_words(frame.select("word"), wc).groupBy("matched").count().collect()
    assert {r.matched: r["count"] for r in hits} == Counter(w in classes for _, _, _, w, _ in rows)


def test_clipped_precision(hot):
    rows, frame = hot
    truth, cand = frame.where("cand_no = 0"), frame.where("cand_no > 0")
    got = {(r.csno, r.cand_no): (r.clipped, r.total) for r in N.clipped_precision(
        N.word_gram_rows(cand, ["csno", "cand_no"]), N.word_gram_rows(truth, ["csno"]), ["csno", "cand_no"], ["csno"]).collect()}
    count = lambda keep: {k: Counter(w for c, n, _, w, _ in rows if (c, n) == k) for k in {(c, n) for c, n, *_ in rows if keep(n)}}
    refs, cands = count(lambda n: n == 0), count(lambda n: n > 0)
    assert got == {k: (sum(min(x, refs.get((k[0], 0), Counter())[w]) for w, x in c.items()), sum(c.values())) for k, c in cands.items()}


def test_bigrams_of_a_hot_customer(hot):
    rows, frame = hot
    got = {(r.csno, r.gram): r.cnt for r in N.gram_counts(N.word_gram_rows(frame, ["csno"], 2, ("event_id",)), ["csno"]).collect()}
    want = Counter()
    for c in {r[0] for r in rows}:
        words = [r[3] for r in sorted(rows, key=lambda r: r[2]) if r[0] == c]
        want.update((c, f"{a} {b}") for a, b in zip(words, words[1:]))
    assert got == dict(want)


def test_top_k_ordinals_and_sample(hot):
    rows, frame = hot
    best = {(r.csno, r["rank"]): r.event_id for r in S.top_k(frame, "csno", "score", 3, "event_id").collect()}
    for c in (7, rows[0][0]):
        want = [r[2] for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[4], r[2]))[:3]]
        assert [best[c, k] for k in (1, 2, 3)] == want
    rn = {r.event_id: r.rn for r in Od.row_ordinals(frame.select("csno", "event_id"), ["csno", "event_id"]).collect()}
    assert [e for e, _ in sorted(rn.items(), key=lambda x: x[1])] == [r[2] for r in sorted(rows, key=lambda r: (r[0], r[2]))]
    assert L.sample_exact(frame, "csno", 0.4).count() == 1600


def test_remaining_keys_are_cut_before_the_lookup(spark):
    keys = fx.fx_truth_keys(spark, SF).limit(2)
    out = EV.fixture_eval_output(spark, SF, keys=keys)
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if "Relation" in line and "user_id" in line and "props" in line:          # every scan of the events' words
            above = [x for i, x in enumerate(plan[:k]) if depth(x) < depth(line)]
            assert any("LeftSemi" in x for x in above) or any("Limit" in x for x in above), "\n".join(plan)
    assert {r.csno for r in out.collect()} == {str(r.csno) for r in keys.collect()}
    assert out.where(F.col("part_dt") != EV.RUN_DATE).count() == 0
