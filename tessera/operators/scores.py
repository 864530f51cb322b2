"""Scores of generated sequences: C4 (gather), E3 (log-softmax), E7
(length-normalised probability), F2 (top-k per key), F3 (argmax), K1 (user
scoring function over Arrow batches), K2 (metric hook)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrays import argmax


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def length_normalised_prob(score, prompt_len, new_tokens=None) -> Column:      # E7
    """exp(score / (L + [score < 0])) as coded; with ``new_tokens`` the
    denominator is L + new_tokens (the sum-over-steps option)."""
    s = _c(score)
    extra = (s < 0).cast("int") if new_tokens is None else _c(new_tokens)
    return F.exp(s / (_c(prompt_len) + extra))


def with_log_softmax(df: DataFrame, logits: str, out: str = "log_probs") -> DataFrame:   # E3, array form
    """Adds ``out`` = log-softmax of the array column ``logits``. The max and
    the log-sum-exp are computed once per row as columns, so the per-element
    lambda only subtracts (O(n) per row, not O(n^2))."""
    x = F.transform(F.col(logits), lambda v: v.cast("double"))
    t = df.withColumn("_x", x).withColumn("_m", F.array_max("_x"))
    t = t.withColumn("_lse", F.log(F.aggregate("_x", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_m")))))
    t = t.withColumn(out, F.transform("_x", lambda v: v - F.col("_m") - F.col("_lse")))
    return t.drop("_x", "_m", "_lse")


def log_softmax_long(scores: DataFrame, group: list[str], value: str = "score") -> DataFrame:  # E3, long form
    """x - max(x) - log(sum(exp(x - max))) over each (seq, step, beam)
    group; the group is one vocabulary row, bounded by the vocabulary size."""
    w = Window.partitionBy(*group)
    m = F.max(value).over(w)
    shifted = scores.withColumn("_x", F.col(value) - m)
    return shifted.withColumn(value, F.col("_x") - F.log(F.sum(F.exp("_x")).over(w))).drop("_x")


def gather_scores(seqs: DataFrame, scores: DataFrame, batch: str = "batch_id",
                  seq: str = "seq_id", beam: str | None = "beam",
                  long_form: bool = False, normalize_logits: bool = False) -> DataFrame:   # C4
    """Transition score of every chosen token.

    ``seqs``: (batch, seq, step, [beam], token_id). ``scores``: (beam, step,
    scores array indexed by token id), or with ``long_form`` (beam, step,
    token_id, score). No beam column: beam = the sequence row. With
    ``normalize_logits`` the scores are log-softmaxed over the vocabulary first
    (E3). Beams < 0 (finished early) give 0.0; steps at or beyond the longest
    beam of the batch are cut. The rows are dealt by batch once for both
    windows (bounded by batch x top_k x steps); finished rows get join keys of
    their own below every beam, so they spread and match nothing.
    """
    if beam is None:
        seqs = seqs.withColumn("beam", F.col(seq))
        beam = "beam"
    seqs = seqs.repartition(batch)
    live = F.sum((F.col(beam) >= 0).cast("int")).over(Window.partitionBy(batch, seq))
    s = seqs.withColumn("_live", live).withColumn("_maxlen", F.max("_live").over(Window.partitionBy(batch)))
    s = s.where(F.col("step") < F.col("_maxlen")).drop("_live", "_maxlen")
    names = s.columns
    own = -1 - F.pmod(F.xxhash64(seq, "step"), F.lit(1 << 40))
    s = s.withColumn("_at", F.when(F.col(beam) < 0, own).otherwise(F.col(beam)))
    scores = scores.withColumnRenamed("beam", "_at")
    if long_form:
        scores = log_softmax_long(scores, ["_at", "step"]) if normalize_logits else scores
        j = s.join(scores, ["_at", "step", "token_id"], "left")
        val = F.col("score")
    else:
        scores = with_log_softmax(scores, "scores", "scores") if normalize_logits else scores
        j = s.join(scores, ["_at", "step"], "left")
        val = F.get("scores", F.col("token_id"))
    return j.select(*names, F.when(F.col(beam) < 0, F.lit(0.0)).otherwise(val.cast("double"))
                    .alias("transition_score"))


def top_k(df: DataFrame, key: str | list[str], score: str, k: int, tie: str | list[str]) -> DataFrame:  # F2
    """The k best rows per key (score descending, ties by ``tie``). The
    ``row_number() <= k`` filter becomes a partial WindowGroupLimit before the
    shuffle, so a hot key ships at most k rows per map task."""
    keys = [key] if isinstance(key, str) else key
    ties = [tie] if isinstance(tie, str) else tie
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def predict_ids(logits, kind=None) -> Column:                                   # F3 / K2 preprocess
    """``logits.argmax(-1)``; of a tuple of outputs (``kind``: its struct type)
    the first one."""
    from pyspark.sql import types as T
    first = _c(logits)[kind.fieldNames()[0]] if isinstance(kind, T.StructType) else logits
    return argmax(first)


def score_batches(df: DataFrame, make_scorer: Callable[[], Callable], input_col: str,
                  out_schema: str, keep: list[str]) -> DataFrame:               # K1
    """Apply a user scoring function to Arrow batches.

    ``make_scorer`` runs once per task (load a model there); the returned
    callable maps a pandas Series of inputs to a pandas DataFrame of outputs
    of ``out_schema`` (without the ``keep`` columns, which are passed
    through).
    """
    cols = keep + [input_col]

    def run(batches):
        scorer = make_scorer()
        for pdf in batches:
            out = scorer(pdf[input_col])
            for k in reversed(keep):
                out.insert(0, k, pdf[k].values)
            yield out

    keep_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    return df.select(*cols).mapInPandas(run, f"{keep_schema}, {out_schema}")


def linear_scorer(weights) -> Callable[[], Callable]:
    """A fixed linear scorer: score = x . w (numpy over the whole batch)."""
    import numpy as np
    w = np.asarray(weights, dtype="float64")

    def make():
        import pandas as pd

        def score(s):
            x = np.stack(s.to_numpy()).astype("float64") if len(s) else np.zeros((0, len(w)))
            return pd.DataFrame({"score": x @ w})
        return score
    return make
