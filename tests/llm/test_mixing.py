"""Poisson mixing: the distribution, the shares, repeatability, edges."""

import math

import pytest

from pyspark.sql import functions as F

from tessera.llm import mixing as mx


@pytest.fixture
def no_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_cdf(spark):
    for rate in (0.01, 0.7, 3.0, 50.0, 900.0):
        cdf = spark.range(1).select(mx.poisson_cdf(F.lit(rate)).alias("c")).first().c
        total, term = 0.0, None
        for k, got in enumerate(cdf):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            assert abs(got - total) < 1e-9
        assert cdf[-1] > 1 - 1e-9 and len(cdf) == math.ceil(rate + 12 * math.sqrt(rate) + 40) + 1


def test_counts_follow_the_hash_and_shares_the_targets(spark):
    rows = [(i, f"s{i % 10 if i % 2 else 0}", "t") for i in range(20_000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    out = mx.mix_to_weights(frame, {"s0": 0.2, "s1": 0.5}, 0.3, epochs=1.5)
    got = out.select("doc_id", "source", "copy_no", "shuffle_key").collect()
    assert abs(len(got) / 30_000 - 1) < 0.03
    share = {s: sum(r.source == s for r in got) / len(got) for s in ("s0", "s1")}
    assert abs(share["s0"] - 0.2) < 0.02 and abs(share["s1"] - 0.5) < 0.02
    assert [r.shuffle_key for r in got] == sorted(r.shuffle_key for r in got)
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r.copy_no)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by_doc.values())
    again = mx.mix_to_weights(frame.repartition(3), {"s0": 0.2, "s1": 0.5}, 0.3, epochs=1.5)
    assert [tuple(r) for r in again.select("doc_id", "source", "copy_no", "shuffle_key").collect()] == [tuple(r) for r in got]


def test_edges(spark):
    rows = [(1, None, None), (None, "a", ""), (2, "a", "x"), (2, "a", "x"), (3, "", "y"), (4, "zero", "z" * 1_000_000)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, source string, text string, grp string, rate int")
    out = mx.mix_to_weights(frame, {"a": 1.0, "zero": 0.0, "absent": 5.0}, 1.0, epochs=4.0)
    got = out.collect()
    assert out.columns == [*frame.columns, "mix_rate", "copy_no", "shuffle_key"]
    assert all(r.source != "zero" for r in got) and {r.grp for r in got} <= {"c"}
    assert abs(sum(dict((r["grp"], r["rate"] * r["n_docs"]) for r in
                        mx.mixing_rates(frame, {"a": 1.0, "zero": 0.0, "absent": 5.0}, 1.0, 4.0).collect()).values()) - 24) < 1e-9
    assert len([r for r in got if r.doc_id == 2]) % 2 == 0
    assert mx.mix_to_weights(frame.limit(0), {"a": 1.0}, 1.0).collect() == []


def test_rows_without_identifier_draw_for_themselves(spark, no_coalescing):
    rows = [(None, f"s{i % 10}", f"text {i}") for i in range(2000)] + [(7, "s0", f"other {i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    out = mx.mix_to_weights(frame, {"s0": 0.3}, 0.7, epochs=2.0).withColumn("part", F.spark_partition_id())
    got = out.collect()
    copies = {}
    for r in got:
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    for ident in (None, 7):
        counts = [copies.get((i, t), 0) for i, _, t in rows if i == ident]
        assert min(counts) == 0 and len(set(counts)) >= 4
    assert len({r.shuffle_key for r in got}) == len(got)
    sizes = [sum(r.part == p for r in got) for p in {r.part for r in got}]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * len(got)


def test_equal_rows_spread_over_the_ranges(spark, no_coalescing):
    frame = spark.range(0, 4000, 1, 8).selectExpr("cast(null AS long) AS doc_id", "'s' AS source", "'' AS text")
    out = mx.mix_to_weights(frame, {"s": 1.0}, epochs=8.0).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("part").count().collect()]
    assert sum(sizes) % 4000 == 0 and (not sizes or len(sizes) >= 4)


def test_clashing_columns(spark):
    rows = [(i, "a", f"t{i}", float(i), i, i, "k", 3, 1, "o") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, cdf double, mix_rate int, copy_no int, "
                                        "shuffle_key string, doc_copy_no int, grp int, own string")
    out = mx.mix_to_weights(frame, {"a": 1.0}, epochs=3.0)
    assert out.columns == ["doc_id", "source", "text", "cdf", "doc_mix_rate", "doc_copy_no", "doc_shuffle_key", "doc_doc_copy_no",
                           "grp", "own", *mx.ADDED]
    for r in out.collect():
        assert (r.cdf, r.doc_mix_rate, r.doc_copy_no, r.doc_shuffle_key, r.doc_doc_copy_no, r.grp, r.own) == (r.doc_id, r.doc_id, r.doc_id, "k", 3, 1, "o")
    plain = mx.mix_to_weights(frame, {"a": 1.0}, epochs=3.0, with_draws=False)
    assert plain.columns == frame.columns and plain.count() == out.count()
