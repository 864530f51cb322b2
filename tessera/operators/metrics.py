"""Evaluation measures: D2-D7, D14, D16, E6.

Everything is a grouped aggregate with partial (map-side) aggregation; no
measure gathers a group's rows. Ratios use a zero guard (zero_division = 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import safe_ratio
from tessera.operators.ordinals import prefix_sums

MEASURES = ["precision", "recall", "accuracy", "f1"]
# Row labels of the printed metric frame (D16), fixed values.
MEASURE_LABELS = {"precision": "Precision", "recall": "Recall",
                  "accuracy": "Accuracy", "f1": "F1_score"}


def _ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (df.withColumn("precision", safe_ratio(tp, tp + fp))
              .withColumn("recall", safe_ratio(tp, tp + fn))
              .withColumn("f1", safe_ratio(2 * tp, 2 * tp + fp + fn))
              .withColumn("accuracy", safe_ratio(tp + tn, tp + fp + fn + tn)))


def confusion_by_class(df: DataFrame, true_col: str, pred_col: str, by: list[str] = ()) -> DataFrame:
    """tp/fp/fn/tn per class slot of two multi-hot columns (positive label 1)."""
    pairs = F.zip_with(true_col, pred_col, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    z = df.select(*by, F.posexplode(pairs).alias("class", "tp_"))
    t, p = F.col("tp_.t"), F.col("tp_.p")
    return (z.groupBy(*by, "class").agg(
        F.sum(t * p).alias("tp"), F.sum((1 - t) * p).alias("fp"),
        F.sum(t * (1 - p)).alias("fn"), F.sum((1 - t) * (1 - p)).alias("tn"))
        .withColumn("class", F.col("class").cast("int")))


def class_report(df: DataFrame, true_col: str = "y_true_ml", pred_col: str = "y_pred_ml") -> DataFrame:
    """D3: per class precision, recall, F1, accuracy over all rows."""
    return _ratios(confusion_by_class(df, true_col, pred_col))


def batch_macro_report(df: DataFrame, batch_col: str = "batch_id", true_col: str = "y_true_ml",
                       pred_col: str = "y_pred_ml") -> DataFrame:
    """D3 inside each batch, then the mean over batches per class."""
    per_batch = _ratios(confusion_by_class(df, true_col, pred_col, [batch_col]))
    return per_batch.groupBy("class").agg(
        F.count(F.lit(1)).alias("batches"), *[F.avg(m).alias(m) for m in MEASURES])


def metric_frame(report: DataFrame, class_num: int) -> DataFrame:
    """rows = the four measures, columns = class_0..class_<C>."""
    stack = ", ".join(f"'{MEASURE_LABELS[m]}', {m}" for m in MEASURES)
    long = report.selectExpr("class", f"stack({len(MEASURES)}, {stack}) as (measure, value)")
    wide = long.groupBy("measure").pivot("class", list(range(class_num + 1))).agg(F.first("value"))
    return wide.select("measure", *[F.col(str(c)).alias(f"class_{c}") for c in range(class_num + 1)])


def running_means(values: DataFrame, value_cols: list[str], by: list[str] = (), decimals: int = 4) -> DataFrame:
    """An accumulator per value over all rows, then its mean, rounded only
    at the end. ``n`` counts rows; the mean of nothing is NULL."""
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                   *[F.round(F.avg(c), decimals).alias(f"{c}_mean") for c in value_cols])


def _aligned(label: str, pred: str, shift: bool) -> Column:
    """Hits by label position; a position without a prediction is a miss."""
    n = F.size(label)
    k = F.greatest(n - 1, F.lit(0)) if shift else n
    lab, prd = F.slice(label, 2 if shift else 1, k), F.slice(pred, 1, k)
    return F.zip_with(lab, prd, lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))


def token_accuracy(df: DataFrame, label_col: str = "label", pred_col: str = "pred",
                   shift: bool = True, weight_col: str | None = None,
                   normalize: bool = True) -> DataFrame:
    """D5 (labels shifted by one), D6 (unshifted), D7 (count / weighted).

    Hits are summed row-locally with ``aggregate`` and then globally; the
    flattened position count is the denominator (sklearn's accuracy_score on
    flattened arrays). Weights are per position (``weight_col`` an array).
    """
    hits = _aligned(label_col, pred_col, shift)
    if weight_col is None:
        per_row = df.select(F.aggregate(hits, F.lit(0).cast("long"), lambda a, h: a + h).alias("h"),
                            F.size(hits).cast("long").alias("w"))
        agg = per_row.agg(F.sum("h").alias("hits"), F.sum("w").alias("positions"))
        value = F.col("hits") / F.col("positions") if normalize else F.col("hits").cast("double")
        return agg.select("hits", "positions", value.alias("accuracy"))
    k = F.size(hits)
    w = F.slice(F.slice(weight_col, 2, F.greatest(F.size(weight_col) - 1, F.lit(0))) if shift
                else F.col(weight_col), 1, k)
    hw = F.zip_with(hits, w, lambda h, x: h * x)
    per_row = df.select(F.aggregate(hw, F.lit(0.0), lambda a, x: a + x).alias("hw"),
                        F.aggregate(w, F.lit(0.0), lambda a, x: a + x).alias("ws"))
    agg = per_row.agg(F.sum("hw").alias("weighted_hits"), F.sum("ws").alias("weight"))
    value = F.col("weighted_hits") / F.col("weight") if normalize else F.col("weighted_hits")
    return agg.select("weighted_hits", "weight", value.alias("accuracy"))


def roc_auc(df: DataFrame, score_col: str, label_col: str, num_parts: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties averaged (Mann-Whitney form).

    Distinct scores are aggregated first (a hot score is one row), then the
    count of rows below each score comes from range-partitioned prefix sums,
    not from a global window.
    """
    g = (df.where(F.col(score_col).isNotNull() & F.col(label_col).isNotNull())
         .groupBy(F.col(score_col).alias("s"))
         .agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col(label_col).cast("long")).alias("pos")))
    cum = prefix_sums(g, ["s"], ["cnt"], num_parts)
    avg_rank = F.col("cnt_before") + (F.col("cnt") + 1) / 2.0
    agg = cum.agg(F.sum(F.col("pos") * avg_rank).alias("rank_sum"),
                  F.sum("pos").alias("n_pos"), F.sum("cnt").alias("n"))
    p, n = F.col("n_pos"), F.col("n") - F.col("n_pos")
    auc = (F.col("rank_sum") - p * (p + 1) / 2.0) / (p * n)
    return agg.select(p.cast("long").alias("n_pos"), n.cast("long").alias("n_neg"),
                      F.when((p > 0) & (n > 0), auc).alias("auc"))


def progress_log(values: DataFrame, value_col: str, shard_col: str, batch_col: str,
                 log_interval: int, decimals: int = 4, num_parts: int | None = None) -> DataFrame:
    """Running mean per shard after every ``log_interval``-th batch.

    Batches are summed, then grouped into blocks of ``log_interval`` batches;
    the running total at log point m is (block sums before m, via prefix sums
    that restart per shard) + the sums of batch m*k itself. No window holds a
    whole shard.
    """
    k = log_interval
    per_batch = values.groupBy(shard_col, batch_col).agg(
        F.sum(value_col).alias("s"), F.count(value_col).alias("c"))
    blocks = (per_batch.withColumn("block", F.floor(F.col(batch_col) / k))
              .groupBy(shard_col, "block").agg(F.sum("s").alias("bs"), F.sum("c").alias("bc")))
    cum = prefix_sums(blocks, [shard_col, "block"], ["bs", "bc"], num_parts)
    starts = F.broadcast(cum.groupBy(shard_col).agg(
        F.min_by("bs_before", "block").alias("s0"), F.min_by("bc_before", "block").alias("c0")))
    cum = cum.join(starts, shard_col).select(
        shard_col, "block", (F.col("bs_before") - F.col("s0")).alias("ps"),
        (F.col("bc_before") - F.col("c0")).alias("pc"))
    logs = per_batch.where(F.col(batch_col) % k == 0).withColumn("block", F.floor(F.col(batch_col) / k))
    out = logs.join(cum, [shard_col, "block"])
    mean = (F.col("ps") + F.col("s")) / (F.col("pc") + F.col("c"))
    return out.select(shard_col, batch_col, (F.col("pc") + F.col("c")).alias("n"),
                      F.round(mean, decimals).alias("running_mean"))
