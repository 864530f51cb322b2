"""

``candidates`` and ``truth`` frames -> class sets -> multi-hot rows, one per
customer; both tracks (labels, text) read the same candidate frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import multi_hot
from tessera.operators.lookup import classes_of_words, word_classes
from tessera.plans import fixtures as fx


def class_count(targets: DataFrame) -> int:
    """``class_num`` = highest class id of the (small, fixed) class table."""
    return int(targets.agg(F.max("class_id")).first()[0])


def label_rows(truth: DataFrame, cands: DataFrame, word_class: DataFrame, class_num: int,
               key: str = "csno") -> DataFrame:
    """One row per key with truth: ``y_true_ml`` and ``y_pred_ml`` (union of
    the classes of all the key's candidates; H17, H18, H19). Both inputs in
    long form: key, word."""
    t = classes_of_words(truth, [key], word_class)
    p = classes_of_words(cands, [key], word_class).withColumnRenamed("classes", "pclasses")
    rows = t.join(p, key, "left")
    return rows.select(key, F.col("classes").alias("y_true"), F.coalesce("pclasses", F.array().cast("array<int>")).alias("y_pred"),
                       multi_hot("classes", class_num).alias("y_true_ml"),
                       multi_hot("pclasses", class_num).alias("y_pred_ml"))


def fixture_label_rows(spark: SparkSession, d: str, keys: DataFrame | None = None) -> DataFrame:
    """Label rows of all customers with truth, or only of ``keys``: truth and
    candidates are cut to the keys before any lookup."""
    targets = fx.fx_target(spark, d)
    wc = word_classes(fx.fx_dict(spark, d), targets)
    return label_rows(only(fx.fx_truth_words(spark, d), keys), only(fx.fx_cand_words(spark, d), keys), wc, class_count(targets))


def only(frame: DataFrame, keys: DataFrame | None, key: str = "csno") -> DataFrame:
    return frame if keys is None else frame.join(keys.select(key).distinct(), key, "left_semi")


# Run date of the fixture jobs (B6: the date is an argument of the job).
RUN_DATE = "20240201"

OUTPUT_SCHEMA = "csno string, y_pred_ml array<int>, y_pred_txt array<string>, y_true_ml array<int>, y_true_txt string, part_dt string"
INPUT_SCHEMA = "csno bigint, X string, Y array<int>, Y_txt string"


def fixture_eval_input(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation input (csno, X prompt text, Y truth classes, Y_txt truth
    text): the prompt is the customer's week-1 words."""
    targets = fx.fx_target(spark, d)
    wc = word_classes(fx.fx_dict(spark, d), targets)
    t = fx.fx_truth(spark, d)
    y = classes_of_words(fx.fx_truth_words(spark, d), ["csno"], wc)
    x = fx.fx_cand(spark, d).where(F.col("cand_no") == 1).select("csno", F.array_join("words", " ").alias("X"))
    return (t.join(x, "csno", "left").join(y, "csno")
            .select("csno", F.coalesce("X", F.lit("")).alias("X"), F.col("classes").alias("Y"),
                    F.array_join("words", " ").alias("Y_txt")))


def fixture_eval_output(spark: SparkSession, d: str, run_date: str = RUN_DATE, keys: DataFrame | None = None) -> DataFrame:
    """The evaluation output rows (B10 column subset + B6 run date), typed by
    the declared output schema (A7); of all customers with truth, or of
    ``keys`` only."""
    from pyspark.sql import types as T
    from tessera.sources.tables import conform
    rows = fixture_label_rows(spark, d, keys)
    cands = fx.sequences(only(fx.fx_cand_words(spark, d), keys), ["csno", "cand_no"])
    texts = (cands.groupBy("csno")
             .agg(F.array_sort(F.collect_list(F.struct("cand_no", F.array_join("words", " ").alias("t")))).alias("_s"))
             .select("csno", F.transform("_s", lambda s: s["t"]).alias("y_pred_txt")))
    truth = fx.sequences(only(fx.fx_truth_words(spark, d), keys), ["csno"]).select(
        "csno", F.array_join("words", " ").alias("y_true_txt"))
    out = (rows.join(texts, "csno", "left").join(truth, "csno")
           .select("csno", "y_pred_ml", F.coalesce("y_pred_txt", F.array().cast("array<string>")).alias("y_pred_txt"),
                   "y_true_ml", "y_true_txt", F.lit(run_date).alias("part_dt")))
    return conform(out, T._parse_datatype_string(OUTPUT_SCHEMA))
