"""Queries of the label track: C1-C3, C5, D1-D4, D15, D16, E4-E6, H17-H20, H22, B7-B9."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.lookup import reduce_dictionary, word_classes
from tessera.plans import fixtures as fx
from tessera.plans.catalog import r6, register
from tessera.plans.evaluation import fixture_label_rows
from tessera.plans.oracle import with_fixtures

_REPORT_COLS = ["class", "tp", "fp", "fn", "tn"]
_RATIO_SQL = """
    round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2*tp + fp + fn = 0 THEN 0.0 ELSE 2*tp / (2*tp + fp + fn) END, 6) AS f1,
    round(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END, 6) AS accuracy"""


def class_report_query(spark, d):
    rep = M.class_report(fixture_label_rows(spark, d))
    return rep.select(*[F.col(c).cast("long") if c != "class" else F.col(c) for c in _REPORT_COLS],
                      *[r6(m).alias(m) for m in ("precision", "recall", "f1", "accuracy")])


register("d3_class_report", with_fixtures(["fx_confusion"], f"""
    SELECT class, tp, fp, fn, tn, {_RATIO_SQL} FROM fx_confusion"""))(class_report_query)


# ---------------------------------------------------------------- lookups
from tessera.operators.lookup import lookup_words  # noqa: E402
from tessera.operators.resume import skip_done  # noqa: E402
from tessera.operators.ordinals import batch_of, row_ordinals, shard_of  # noqa: E402
from tessera.plans.evaluation import class_count  # noqa: E402


@register("c1_resume_anti_join", with_fixtures(["fx_truth", "fx_done"], """
    SELECT csno FROM fx_truth t WHERE NOT EXISTS (SELECT 1 FROM fx_done d WHERE d.csno = t.csno)"""))
def q_c1(spark, d):
    return skip_done(fx.fx_truth_keys(spark, d), fx.fx_done(spark, d), "csno").select("csno")


@register("d1_distinct_keys", with_fixtures(["fx_done"], """
    SELECT DISTINCT csno FROM fx_done"""))
def q_d1(spark, d):
    return fx.fx_done(spark, d).distinct()


@register("h22_reduce_dictionary", with_fixtures(["fx_dict_one"], """
    SELECT word, category FROM fx_dict_one"""))
def q_h22(spark, d):
    return reduce_dictionary(fx.fx_dict(spark, d), fx.fx_target(spark, d))


@register("c2_word_lookup", with_fixtures(["fx_event", "fx_dict_one"], """
    SELECT replace(e.word, '#', '') AS word, d.category, CAST(d.word IS NOT NULL AS INTEGER) AS matched,
           count(*) AS n_events
    FROM fx_event e LEFT JOIN fx_dict_one d ON replace(e.word, '#', '') = d.word
    GROUP BY 1, 2, 3"""))
def q_c2(spark, d):
    dic = reduce_dictionary(fx.fx_dict(spark, d), fx.fx_target(spark, d))
    hit = lookup_words(fx.fx_event(spark, d).select("word"), dic)
    return hit.groupBy("word", "category", F.col("matched").cast("int").alias("matched")).agg(
        F.count(F.lit(1)).alias("n_events"))


@register("c3_class_lookup", with_fixtures(["fx_word_class", "fx_dict_one"], """
    SELECT w.word, d.category, w.class_id FROM fx_word_class w JOIN fx_dict_one d USING (word)"""))
def q_c3(spark, d):
    t = fx.fx_target(spark, d)
    wc = word_classes(fx.fx_dict(spark, d), t)
    red = reduce_dictionary(fx.fx_dict(spark, d), t)
    return wc.join(red, "word").select("word", "category", "class_id")


@register("h19_word_to_label", with_fixtures(["fx_cand", "fx_word_class"], """
    SELECT x.csno, x.cand_no,
           coalesce(array_to_string(list(DISTINCT wc.class_id ORDER BY wc.class_id)
                    FILTER (WHERE wc.class_id IS NOT NULL), ','), '') AS classes
    FROM (SELECT csno, cand_no, replace(unnest(words), '#', '') AS word FROM fx_cand) x
    LEFT JOIN fx_word_class wc USING (word) GROUP BY x.csno, x.cand_no"""))
def q_h19(spark, d):
    from tessera.operators.lookup import classes_of_words
    wc = word_classes(fx.fx_dict(spark, d), fx.fx_target(spark, d))
    cl = classes_of_words(fx.fx_cand_words(spark, d), ["csno", "cand_no"], wc)
    return cl.select("csno", "cand_no", F.array_join("classes", ",").alias("classes"))


@register("h17_multi_hot_truth", with_fixtures(["fx_eval"], """
    SELECT csno, array_to_string(y_true_ml, '') AS y_true_ml FROM fx_eval"""))
def q_h17(spark, d):
    return fixture_label_rows(spark, d).select("csno", F.array_join("y_true_ml", "").alias("y_true_ml"))


@register("h18_multi_hot_pred", with_fixtures(["fx_eval"], """
    SELECT csno, array_to_string(y_pred_ml, '') AS y_pred_ml FROM fx_eval"""))
def q_h18(spark, d):
    return fixture_label_rows(spark, d).select("csno", F.array_join("y_pred_ml", "").alias("y_pred_ml"))


# ---------------------------------------------------------------- ordinals
BATCH_SIZE = 2
WORLD_SIZE = 4
LOG_INTERVAL = 5


@register("e4_batch_ordinal", with_fixtures(["fx_truth"], f"""
    SELECT csno, row_number() OVER (ORDER BY csno) AS rn,
           (row_number() OVER (ORDER BY csno) - 1) // {BATCH_SIZE} AS batch_id
    FROM fx_truth"""))
def q_e4(spark, d):
    o = row_ordinals(fx.fx_truth_keys(spark, d), ["csno"])
    return o.select("csno", "rn", batch_of("rn", BATCH_SIZE).alias("batch_id"))


_SHARD_SQL = f"""
    SELECT csno, CAST(CASE WHEN n // {WORLD_SIZE} = 0 THEN {WORLD_SIZE - 1}
                      ELSE least((rn - 1) // (n // {WORLD_SIZE}), {WORLD_SIZE - 1}) END AS INTEGER) AS shard
    FROM (SELECT csno, row_number() OVER (ORDER BY csno) AS rn, count(*) OVER () AS n FROM fx_truth)"""


@register("e5_shard_ordinal", with_fixtures(["fx_truth"], _SHARD_SQL))
def q_e5(spark, d):
    o = row_ordinals(fx.fx_truth_keys(spark, d), ["csno"], total_col="n")
    return o.select("csno", shard_of("rn", "n", WORLD_SIZE).alias("shard"))


@register("b9_row_slice", """
    SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events)
    WHERE rn BETWEEN 101 AND 2100""")
def q_b9(spark, d):
    from tessera.operators.ordinals import row_slice
    from tessera.session import table
    return row_slice(table(spark, d, "events").select("event_id"), ["event_id"], 100, 2100)


# ---------------------------------------------------------------- macro forms
_BATCH_CONF = ("fx_batch_conf", f"""
    SELECT batch_id, c AS class,
           sum(y_true_ml[c+1] * y_pred_ml[c+1]) AS tp, sum((1 - y_true_ml[c+1]) * y_pred_ml[c+1]) AS fp,
           sum(y_true_ml[c+1] * (1 - y_pred_ml[c+1])) AS fn, sum((1 - y_true_ml[c+1]) * (1 - y_pred_ml[c+1])) AS tn
    FROM (SELECT *, (row_number() OVER (ORDER BY csno) - 1) // {BATCH_SIZE} AS batch_id,
                 unnest(range(0, len(y_true_ml))) AS c FROM fx_eval)
    GROUP BY batch_id, c""")
_BATCH_RATIOS = ("fx_batch_ratio", """
    SELECT class,
        CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
        CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
        CASE WHEN 2*tp + fp + fn = 0 THEN 0.0 ELSE 2*tp / (2*tp + fp + fn) END AS f1,
        CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END AS accuracy
    FROM fx_batch_conf""")


def _batch_report(spark, d):
    rows = row_ordinals(fixture_label_rows(spark, d), ["csno"])
    rows = rows.withColumn("batch_id", batch_of("rn", BATCH_SIZE))
    return M.batch_macro_report(rows)


@register("d4_batch_macro_report", with_fixtures(["fx_eval"], """
    SELECT CAST(class AS INTEGER) AS class, count(*) AS batches,
           round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
           round(avg(f1), 6) AS f1, round(avg(accuracy), 6) AS accuracy
    FROM fx_batch_ratio GROUP BY class""", [_BATCH_CONF, _BATCH_RATIOS]))
def q_d4(spark, d):
    rep = _batch_report(spark, d)
    return rep.select("class", "batches", *[r6(m).alias(m) for m in ("precision", "recall", "f1", "accuracy")])


def _frame_sql():
    cols = ", ".join(f"round(max(CASE WHEN class = {c} THEN value END), 4) AS class_{c}" for c in range(5))
    unions = " UNION ALL ".join(
        f"SELECT '{lab}' AS measure, class, avg({m}) AS value FROM fx_batch_ratio GROUP BY class"
        for m, lab in M.MEASURE_LABELS.items())
    return with_fixtures(["fx_eval"], f"SELECT measure, {cols} FROM ({unions}) GROUP BY measure",
                         [_BATCH_CONF, _BATCH_RATIOS])


@register("d16_metric_frame", _frame_sql())
def q_d16(spark, d):
    c = class_count(fx.fx_target(spark, d))
    frame = M.metric_frame(_batch_report(spark, d), c)
    return frame.select("measure", *[F.round(f"class_{i}", 4).alias(f"class_{i}") for i in range(c + 1)])


@register("d15_row_count", """
    SELECT 'events' AS table_name, count(*) AS n FROM events
    UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def q_d15(spark, d):
    from tessera.session import table
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
             for t in ("events", "documents", "lineitem")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("b7_drop_empty_categories", with_fixtures(["fx_dict_one"], """
    SELECT word, category FROM fx_dict_one WHERE category IS NOT NULL AND length(category) > 0"""))
def q_b7(spark, d):
    from tessera.operators.lookup import drop_empty_categories
    return drop_empty_categories(reduce_dictionary(fx.fx_dict(spark, d), fx.fx_target(spark, d)))


@register("b8_drop_unmapped_categories", with_fixtures(["fx_word_class"], "SELECT word, class_id FROM fx_word_class"))
def q_b8(spark, d):
    from tessera.operators.lookup import categories_to_classes, drop_empty_categories
    red = drop_empty_categories(reduce_dictionary(fx.fx_dict(spark, d), fx.fx_target(spark, d)))
    return categories_to_classes(red, fx.fx_target(spark, d)).select("word", "class_id")
