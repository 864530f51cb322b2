"""Appends that may be tried again, and the stream's keys evaluated once."""

import uuid

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks as SK
from tessera.streaming.incremental import read_output, run_available


def _counts(df):
    return {(r.run_id, r.day): r.n for r in df.groupBy("run_id", "day").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("is_path", [True, False])
def test_a_run_counts_once_and_only_when_committed(spark, tmp_path, is_path):
    target = str(tmp_path / "t") if is_path else f"runs_{uuid.uuid4().hex}"
    schema = "x long, day string"
    read = lambda: _counts(SK.committed_runs(spark, target, schema, is_path=is_path))
    assert read() == {}
    rows = spark.range(10).select(F.col("id").alias("x"), F.concat(F.lit("d"), F.col("id") % 2).alias("day"))
    try:
        for _ in range(2):
            SK.append_run(rows, target, "r-1", "day", is_path=is_path)
        SK.append_run(rows.where("day = 'd0'"), target, "r-2", "day", is_path=is_path)
        assert read() == {("r-1", "d0"): 5, ("r-1", "d1"): 5, ("r-2", "d0"): 5}
        SK.append_run(rows.where("x < 3 AND day = 'd1'"), target, "r-1", "day", is_path=is_path)   # a later try with fewer days
        assert read() == {("r-1", "d1"): 1, ("r-2", "d0"): 5}
        lost = rows.withColumn("run_id", F.lit("r-3"))
        if is_path:
            lost.write.mode("append").partitionBy("run_id", "day").parquet(target)
        else:
            lost.write.mode("append").partitionBy("run_id", "day").saveAsTable(target)
        assert read() == {("r-1", "d1"): 1, ("r-2", "d0"): 5}
        with pytest.raises(ValueError):
            SK.append_run(rows, target, "a/b", is_path=is_path)
    finally:
        if not is_path:
            spark.sql(f"DROP TABLE IF EXISTS {target}")
            spark.sql(f"DROP TABLE IF EXISTS {target}_commits")


def test_a_key_in_two_files_is_evaluated_once(spark, tmp_path):
    incoming, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "csno string, v long"

    def evaluate(keys):
        return keys.select(F.col("csno").cast("string").alias("csno"), (F.col("csno") * 2).alias("v"))

    def put(*keys):
        spark.createDataFrame([(k,) for k in keys], "csno long").coalesce(1).write.mode("append").parquet(incoming)
        run_available(spark, incoming, "csno long", out, ckpt, evaluate, schema)
        return sorted((int(r.csno), r.v, r.batch_id) for r in read_output(spark, out, schema).collect())
    assert put(1, 2, 2) == [(1, 2, 0), (2, 4, 0)]
    assert put(2, 3, 1) == [(1, 2, 0), (2, 4, 0), (3, 6, 1)]
    assert put(3, 3) == [(1, 2, 0), (2, 4, 0), (3, 6, 1)]
