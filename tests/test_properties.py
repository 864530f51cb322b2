
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import lmprep as L
from tessera.operators import metrics as M
from tessera.operators import ordinals as Od
from tessera.plans import fixtures as fx
from tessera.plans.evaluation import fixture_label_rows
from tessera.session import table

SF = "/root/testdata/sf0.001"


def test_ordinals_equal_window(spark):
    ev = table(spark, SF, "events").select("event_id")
    two = Od.row_ordinals(ev, ["event_id"], num_parts=5)
    win = ev.select("event_id", F.row_number().over(Window.orderBy("event_id")).alias("rn"))
    assert two.exceptAll(win.select("event_id", F.col("rn").cast("long"))).count() == 0
    assert two.count() == ev.count()


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, v int")
    got = {r.k: (r.v_before, r.v_total) for r in Od.prefix_sums(df, ["k"], ["v"], num_parts=4).collect()}
    run = 0
    for i in range(50):
        assert got[i] == (run, sum(j % 3 for j in range(50)))
        run += i % 3


def test_shard_sizes_sum_to_n(spark):
    for n, w in [(1, 4), (17, 4), (100, 7)]:
        df = spark.range(n).withColumnRenamed("id", "k")
        o = Od.row_ordinals(df, ["k"], total_col="n")
        assert o.select(Od.shard_of("rn", "n", w).alias("s")).count() == n


def test_ratios_in_unit_interval(spark):
    rep = M.class_report(fixture_label_rows(spark, SF)).collect()
    for r in rep:
        for m in ("precision", "recall", "f1", "accuracy"):
            assert 0.0 <= r[m] <= 1.0


def test_chunks_concatenate_to_input(spark):
    docs = table(spark, SF, "documents").select("doc_id", L.code_points("text").alias("ids"))
    ch = L.chunk_sequences(docs, ["doc_id"], "ids", 97)
    back = ch.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "input_ids"))),
                                                         lambda s: s["input_ids"])).alias("ids"))
    assert back.join(docs.where(F.size("ids") > 0), ["doc_id", "ids"], "left_anti").count() == 0
    assert docs.where(F.size("ids") > 0).join(back, ["doc_id", "ids"], "left_anti").count() == 0


def test_resume_twice_equals_once(spark, tmp_path):
    from tessera.streaming.incremental import resume_and_append
    keys = fx.fx_truth_keys(spark, SF)
    ev = lambda k: k.select("csno", F.lit(1).alias("x"))
    out = str(tmp_path / "o")
    resume_and_append(keys, out, ev, output_schema="csno bigint, x int")
    resume_and_append(keys, out, ev, output_schema="csno bigint, x int")
    assert spark.read.parquet(out).count() == keys.count()


def test_row_local_precision_equals_exploded(spark):
    from tessera.functions import overlap as O
    from tessera.operators import ngrams as N
    p = fx.fx_pair(spark, SF).select("csno", "cand_no", "cand", "answer")
    row = p.select("csno", "cand_no", (O.char_multiset_overlap("cand", "answer") /
                                       F.greatest(F.length("cand"), F.lit(1))).alias("a"))
    c = p.select("csno", "cand_no", N.chars("cand").alias("t"))
    r = p.select("csno", "cand_no", N.chars("answer").alias("t"))
    ex = N.modified_precision(c, r, ["csno", "cand_no"], "t", 1).select("csno", "cand_no", F.col("precision").alias("b"))
    bad = row.join(ex, ["csno", "cand_no"]).where(F.abs(F.col("a") - F.col("b")) > 1e-12)
    assert bad.count() == 0


def test_auc_against_pairs(spark):
    import random
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 20), rnd.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s int, y int")
    got = M.roc_auc(df, "s", "y", num_parts=4).first()["auc"]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12


def test_sample_exact_size_and_repeatable(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id")
    a = L.sample_exact(docs, "doc_id", 0.37, digits=2)
    b = L.sample_exact(docs, "doc_id", 0.37, digits=3)
    assert a.count() == int(docs.count() * 0.37)
    assert a.exceptAll(b).count() == 0


def test_sample_exact_with_repeated_and_null_keys(spark):
    rows = [(i % 3 if i % 10 else None, i // 20) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    for ratio in (0.1, 0.25, 0.5, 0.99):
        assert L.sample_exact(df, "k", ratio).count() == int(100 * ratio)
    same = spark.createDataFrame([(1, "a")] * 40, "k int, v string")
    assert L.sample_exact(same, "k", 0.3).count() == 12


def test_row_slice_over_ranges_and_nulls(spark):
    rows = [(None if i % 50 == 0 else i * 7 % 1009, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for start, stop in ((0, 10), (5, 30), (15, 800), (900, 2000), (1000, 1001)):
        got = [tuple(r) for r in Od.row_slice(df, ["k", "i"], start, stop).collect()]
        assert sorted(got, key=str) == sorted(order[start:stop], key=str)
