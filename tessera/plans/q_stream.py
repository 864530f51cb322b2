"""Queries of the incremental evaluation (J1), batch and streaming forms: both
tracks of the evaluation for the keys that remain, appended by run date."""

from __future__ import annotations

import uuid


from tessera.plans import evaluation as EV
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register
from tessera.plans.q_access import _OUT_SQL, _flat_output
from tessera.session import scratch_path
from tessera.streaming.incremental import read_output, resume_and_append, run_available


def _evaluator(spark, d):
    """Keys -> output rows. Truth and candidates are cut to the keys before any
    lookup, so a resumed run or a micro-batch costs what its keys cost."""
    return lambda keys: EV.fixture_eval_output(spark, d, keys=keys)


def _arrivals(spark, d):
    keys = fx.fx_truth_keys(spark, d)
    done = fx.fx_done(spark, d)
    return keys.join(done, "csno", "left_semi"), keys.join(done, "csno", "left_anti")


@register("j1_resume_append_batch", _OUT_SQL)
def q_j1_batch(spark, d):
    out = scratch_path(spark, f"j1b-{uuid.uuid4().hex}")
    evaluate = _evaluator(spark, d)
    first, _ = _arrivals(spark, d)
    all_keys = fx.fx_truth_keys(spark, d)
    for keys in (first, all_keys, all_keys):     # a partial run, the resumed run, and one with nothing left to do
        resume_and_append(keys, out, evaluate, output_schema=EV.OUTPUT_SCHEMA, part_col="part_dt")
    return _flat_output(spark.read.schema(EV.OUTPUT_SCHEMA).parquet(out))


@register("j1_resume_append_stream", _OUT_SQL)
def q_j1_stream(spark, d):
    base = scratch_path(spark, f"j1s-{uuid.uuid4().hex}")
    incoming, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/ckpt"
    evaluate = _evaluator(spark, d)
    first, second = _arrivals(spark, d)
    first.write.parquet(incoming)
    run_available(spark, incoming, "csno bigint", out, ckpt, evaluate, EV.OUTPUT_SCHEMA)
    first.unionByName(second).write.mode("append").parquet(incoming)     # the first keys come again
    run_available(spark, incoming, "csno bigint", out, ckpt, evaluate, EV.OUTPUT_SCHEMA)
    run_available(spark, incoming, "csno bigint", out, ckpt, evaluate, EV.OUTPUT_SCHEMA)   # nothing new: no batch
    return _flat_output(read_output(spark, out, EV.OUTPUT_SCHEMA).drop("batch_id"))
