"""Queries of data access: A1-A11, B1-B6, B10, F4, G1-G4, G6, H8, H9, H14-H16,
H20, H21."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays as A
from tessera.functions import text as Tx
from tessera.operators.lookup import classes_of_words, reduce_dictionary, word_classes
from tessera.operators.resume import skip_done
from tessera.plans import evaluation as EV
from tessera.plans import fixtures as fx
from tessera.plans.catalog import r6, register
from tessera.plans.oracle import with_fixtures
from tessera.session import scratch_path, table
from tessera.sources import sinks as SK
from tessera.sources import tables as SR
from tessera.sources.casts import Profile, retyped


def _scratch(spark, tag):
    return scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")


# ---------------------------------------------------------------- scans
_A1_SQL = """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 6) AS sum_qty,
           round(CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE), 6) AS revenue
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"""


@register("a1_sql_scan", _A1_SQL)
def q_a1(spark, d):
    return SR.read_sql(spark, _A1_SQL.replace("FROM lineitem", "FROM {lineitem}"), SR.tables(spark, d, ["lineitem"]))


_A2_TEXTS = ["SELECT 'orders' AS source, count(*) AS n FROM orders WHERE o_orderstatus = 'F'",
             "SELECT 'customer' AS source, count(*) AS n FROM customer WHERE c_acctbal > 0"]


@register("a2_sql_list", " UNION ALL ".join(_A2_TEXTS))
def q_a2(spark, d):
    texts = [q.replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}") for q in _A2_TEXTS]
    orders, customers = SR.read_sql(spark, texts, SR.tables(spark, d, ["orders", "customer"]))
    return orders.unionByName(customers)


_CUST_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@register("a3_tsv_scan", "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer")
def q_a3(spark, d):
    path = _scratch(spark, "a3")
    table(spark, d, "customer").write.option("sep", "\t").option("header", "true").csv(path)
    c = SR.read_tsv(spark, path, _CUST_SCHEMA, header=True)
    return c.select("c_custkey", "c_name", "c_nationkey", r6("c_acctbal").alias("c_acctbal"), "c_mktsegment")


@register("a4_parquet_declared_schema", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def q_a4(spark, d):
    return SR.read_parquet(spark, f"{d}/orders.parquet", "o_orderkey bigint, o_custkey bigint, o_orderstatus string")


@register("a5_eval_input_scan", with_fixtures(["fx_truth", "fx_cand", "fx_true_cls"], """
    SELECT t.csno, coalesce(array_to_string(c.words, ' '), '') AS X, array_to_string(tc.classes, ',') AS Y,
           array_to_string(t.words, ' ') AS Y_txt
    FROM fx_truth t LEFT JOIN fx_cand c ON c.csno = t.csno AND c.cand_no = 1 JOIN fx_true_cls tc ON tc.csno = t.csno"""))
def q_a5(spark, d):
    path = _scratch(spark, "a5")
    EV.fixture_eval_input(spark, d).write.parquet(path)
    x = SR.read_parquet(spark, path, EV.INPUT_SCHEMA)
    return x.select("csno", "X", F.array_join("Y", ",").alias("Y"), "Y_txt")


@register("a6_load_dictionary", with_fixtures(["fx_dict"], "SELECT word, array_to_string(categories, ',') AS categories FROM fx_dict"))
def q_a6(spark, d):
    path = _scratch(spark, "a6")
    fx.fx_dict(spark, d).write.parquet(path)
    return SR.load_dictionary(spark, path).select("word", F.array_join("categories", ",").alias("categories"))


_OUT_SQL = with_fixtures(["fx_eval", "fx_cand", "fx_truth"], f"""
    SELECT CAST(e.csno AS VARCHAR) AS csno, array_to_string(e.y_pred_ml, '') AS y_pred_ml,
           coalesce(p.txt, '') AS y_pred_txt, array_to_string(e.y_true_ml, '') AS y_true_ml,
           array_to_string(t.words, ' ') AS y_true_txt, '{EV.RUN_DATE}' AS part_dt
    FROM fx_eval e JOIN fx_truth t USING (csno)
    LEFT JOIN (SELECT csno, string_agg(array_to_string(words, ' '), '|' ORDER BY cand_no) AS txt FROM fx_cand GROUP BY 1) p USING (csno)""")


def _flat_output(df):
    return df.select("csno", F.array_join("y_pred_ml", "").alias("y_pred_ml"),
                     F.array_join("y_pred_txt", "|").alias("y_pred_txt"),
                     F.array_join("y_true_ml", "").alias("y_true_ml"), "y_true_txt", "part_dt")


@register("a7_declared_output_schema", _OUT_SQL)
def q_a7(spark, d):
    return _flat_output(EV.fixture_eval_output(spark, d))


@register("b10_result_columns", f"SELECT csno, y_pred_ml, y_true_txt FROM ({_OUT_SQL})")
def q_b10(spark, d):
    return _flat_output(EV.fixture_eval_output(spark, d)).select("csno", "y_pred_ml", "y_true_txt")


# ---------------------------------------------------------------- sinks
_EV_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, part_dt string"


def _events_by_day(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value",
                                            Tx.day_text("ts").alias("part_dt"))


@register("a8_append_partitioned", """
    SELECT strftime(ts, '%Y%m%d') AS part_dt, count(*) AS n FROM events GROUP BY 1""")
def q_a8(spark, d):
    path = _scratch(spark, "a8")
    SK.append_partitioned(_events_by_day(spark, d), path)
    return SR.read_parquet(spark, path, _EV_SCHEMA).groupBy("part_dt").agg(F.count(F.lit(1)).alias("n"))


@register("a9_dynamic_partition_overwrite", """
    SELECT strftime(ts, '%Y%m%d') AS part_dt,
           count(*) FILTER (WHERE strftime(ts, '%Y%m%d') > '20240107' OR event_type = 'purchase') AS n
    FROM events GROUP BY 1""")
def q_a9(spark, d):
    path = _scratch(spark, "a9")
    ev = _events_by_day(spark, d)
    SK.append_partitioned(ev, path)
    SK.overwrite_partitions(ev.where((F.col("part_dt") <= "20240107") & (F.col("event_type") == "purchase")), path)
    return SR.read_parquet(spark, path, _EV_SCHEMA).groupBy("part_dt").agg(F.count(F.lit(1)).alias("n"))


def _database(spark):
    """A database of the session's own catalog whose tables lie in the run's folder."""
    name = f"tessera_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{_scratch(spark, name)}'")
    return name


@register("a8_append_table", """
    SELECT strftime(ts, '%Y%m%d') AS part_dt, 2 * count(*) AS n FROM events GROUP BY 1""")
def q_a8_table(spark, d):
    target = f"{_database(spark)}.event_days"
    for _ in range(2):
        SK.append_partitioned(_events_by_day(spark, d), target, is_path=False)
    return spark.table(target).groupBy("part_dt").agg(F.count(F.lit(1)).alias("n"))


@register("a9_insert_into_table", """
    SELECT strftime(ts, '%Y%m%d') AS part_dt,
           count(*) FILTER (WHERE strftime(ts, '%Y%m%d') > '20240107' OR event_type = 'purchase') AS n
    FROM events GROUP BY 1""")
def q_a9_table(spark, d):
    target = f"{_database(spark)}.event_days"
    ev = _events_by_day(spark, d)
    SK.append_partitioned(ev, target, is_path=False)
    SK.overwrite_partitions(ev.where((F.col("part_dt") <= "20240107") & (F.col("event_type") == "purchase")), target, is_path=False)
    return spark.table(target).groupBy("part_dt").agg(F.count(F.lit(1)).alias("n"))


@register("a10_append_tsv", with_fixtures(["fx_eval"], """
    SELECT csno, '[' || array_to_string(y_pred_ml, ',') || ']' AS y_pred_ml, 2 AS copies FROM fx_eval"""))
def q_a10(spark, d):
    path = _scratch(spark, "a10")
    rows = EV.fixture_label_rows(spark, d).select("csno", "y_pred_ml")
    SK.append_tsv(rows, path, header=False)
    SK.append_tsv(rows, path, header=False)
    back = SR.read_tsv(spark, path, "csno bigint, y_pred_ml string", header=False)
    return back.groupBy("csno", "y_pred_ml").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@register("a8_append_run", """
    SELECT strftime(ts, '%Y%m%d') AS part_dt, 2 * count(*) AS n, 2 AS runs FROM events GROUP BY 1""")
def q_a8_run(spark, d):
    """Two runs, the first of them tried twice; a third has no commit record."""
    path, ev = _scratch(spark, "a8r"), _events_by_day(spark, d)
    for run in ("r1", "r1", "r2"):
        SK.append_run(ev, path, run, "part_dt")
    ev.write.partitionBy("part_dt").parquet(f"{path}/run_id=r3")
    rows = SK.committed_runs(spark, path, _EV_SCHEMA)
    return rows.groupBy("part_dt").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").cast("int").alias("runs"))


@register("a10_append_tsv_run", with_fixtures(["fx_eval"], """
    SELECT csno, '[' || array_to_string(y_pred_ml, ',') || ']' AS y_pred_ml, 2 AS copies FROM fx_eval"""))
def q_a10_run(spark, d):
    path = _scratch(spark, "a10r")
    rows = EV.fixture_label_rows(spark, d).select("csno", "y_pred_ml")
    for run in ("a", "b", "a"):
        SK.append_run(rows, path, run, fmt="csv", sep="\t", header="false")
    back = SK.committed_runs(spark, path, "csno bigint, y_pred_ml string", fmt="csv", sep="\t", header="false")
    return back.groupBy("csno", "y_pred_ml").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@register("a11_typed_export", """
    SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, l_linenumber,
           CAST(CAST(l_quantity AS DECIMAL(10, 0)) AS INTEGER) AS qty,
           round(CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS DOUBLE), 6) AS price, round(l_discount, 6) AS l_discount
    FROM lineitem""")
def q_a11(spark, d):
    path = _scratch(spark, "a11")
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(10,0)").alias("qty"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), "l_discount")
    SK.export_typed(li, path, profile=Profile(whole=T.IntegerType()))
    back = spark.read.parquet(path)
    return back.select("l_orderkey", "l_linenumber", "qty", r6("price").alias("price"), r6("l_discount").alias("l_discount"))


# ---------------------------------------------------------------- casts
@register("b1_cast_projection", """
    SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey,
           round(CAST(CAST(o_totalprice AS DECIMAL(14, 2)) AS DOUBLE), 6) AS o_totalprice, o_orderstatus
    FROM orders""")
def q_b1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey",
                                         F.col("o_totalprice").cast("decimal(14,2)").alias("o_totalprice"), "o_orderstatus")
    c = retyped(o, Profile(whole=T.IntegerType()), {"o_orderstatus": "string"})
    return c.withColumn("o_totalprice", r6("o_totalprice"))


@register("b2_cast_map", """
    SELECT c_custkey, CAST(c_nationkey AS SMALLINT) AS c_nationkey,
           round(CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE), 6) AS c_acctbal FROM customer""")
def q_b2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    c = retyped(c, Profile(keep_decimals=True), {"c_nationkey": "short", "c_acctbal": "decimal(12,2)"})
    return c.withColumn("c_acctbal", r6(F.col("c_acctbal").cast("double")))


@register("b3_cast_key_resume", with_fixtures(["fx_truth", "fx_done"], """
    SELECT csno FROM fx_truth t WHERE NOT EXISTS (SELECT 1 FROM fx_done d WHERE d.csno = t.csno)"""))
def q_b3(spark, d):
    done_text = fx.fx_done(spark, d).select(F.col("csno").cast("string").alias("csno"))   # key as text (Q36)
    return skip_done(fx.fx_truth_keys(spark, d), done_text, "csno")


@register("b4_regex_columns", """
    SELECT round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax FROM lineitem""")
def q_b4(spark, d):
    li = SR.select_regex(table(spark, d, "lineitem"), "l_.*(price|count|tax)")
    return li.select(*[r6(c).alias(c) for c in li.columns])


@register("b4_regex_columns_sql", """
    SELECT round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax FROM lineitem""")
def q_b4_sql(spark, d):
    li = SR.read_sql(spark, "SELECT `l_.*(price|count|tax)` FROM {lineitem}", SR.tables(spark, d, ["lineitem"]), use_regex=True)
    return li.select(*[r6(c).alias(c) for c in li.columns])


@register("b6_constant_column", f"SELECT event_id, '{EV.RUN_DATE}' AS part_dt FROM events")
def q_b6(spark, d):
    return table(spark, d, "events").select("event_id", F.lit(EV.RUN_DATE).alias("part_dt"))


@register("f4_first_row", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1")
def q_f4(spark, d):
    o = table(spark, d, "orders").orderBy("o_orderkey").limit(1)
    return o.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"))


# ---------------------------------------------------------------- set operations
_TARGETS_SQL = "['ECONOMY', 'LARGE', 'MEDIUM', 'SMALL']"


def _targets():
    return F.array(*[F.lit(c) for c, _ in fx.TARGET_CLASSES])


@register("g1_intersect_targets", with_fixtures(["fx_dict"], f"""
    SELECT word, array_to_string(list_filter(categories, lambda c: list_contains({_TARGETS_SQL}, c)), ',') AS common,
           len(list_filter(categories, lambda c: list_contains({_TARGETS_SQL}, c))) > 0 AS any_target
    FROM fx_dict"""))
def q_g1(spark, d):
    dic = fx.fx_dict(spark, d)
    return dic.select("word", F.array_join(A.intersect("categories", _targets()), ",").alias("common"),
                      A.overlaps("categories", _targets()).alias("any_target"))


@register("g2_difference_targets", with_fixtures(["fx_dict"], f"""
    SELECT word, array_to_string(list_filter(categories, lambda c: NOT list_contains({_TARGETS_SQL}, c)), ',') AS other
    FROM fx_dict"""))
def q_g2(spark, d):
    dic = fx.fx_dict(spark, d)
    return dic.select("word", F.array_join(A.difference("categories", _targets()), ",").alias("other"))


@register("g3_distinct_class_sets", with_fixtures(["fx_cand", "fx_word_class"], """
    SELECT csno, array_to_string(list_transform(list_sort(list_distinct(list(classes))),
                 lambda s: '[' || array_to_string(s, ',') || ']'), ';') AS sets
    FROM (SELECT x.csno, x.cand_no, coalesce(list(DISTINCT wc.class_id ORDER BY wc.class_id)
                 FILTER (WHERE wc.class_id IS NOT NULL), []) AS classes
          FROM (SELECT csno, cand_no, replace(unnest(words), '#', '') AS word FROM fx_cand) x
          LEFT JOIN fx_word_class wc USING (word) GROUP BY x.csno, x.cand_no)
    GROUP BY csno"""))
def q_g3(spark, d):
    wc = word_classes(fx.fx_dict(spark, d), fx.fx_target(spark, d))
    cl = classes_of_words(fx.fx_cand_words(spark, d), ["csno", "cand_no"], wc)
    sets = cl.groupBy("csno").agg(F.array_sort(A.distinct_sets(F.collect_set("classes"))).alias("s"))
    return sets.select("csno", F.array_join(F.transform(
        "s", lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))), ";").alias("sets"))


@register("g4_extend_vocabulary", with_fixtures(["fx_vocab"], "SELECT token, id FROM fx_vocab"))
def q_g4(spark, d):
    from tessera.operators.vocab import extend_vocabulary
    return extend_vocabulary(fx.fx_vocab_base(spark, d), Tx.SEPARATORS + Tx.WEEK_TOKENS)


@register("g6_concat_marker_lists", with_fixtures(["fx_token", "fx_special"], """
    SELECT csno, cand_no, count(DISTINCT token) FILTER (WHERE token NOT IN (SELECT token FROM fx_special)) AS n_content
    FROM fx_token GROUP BY 1, 2"""))
def q_g6(spark, d):
    markers = A.concat_lists(F.array(*[F.lit(s) for s in Tx.SEPARATORS]), F.array(*[F.lit(w) for w in Tx.WEEK_TOKENS]))
    t = fx.fx_token(spark, d).groupBy("csno", "cand_no").agg(F.collect_set("token").alias("toks"))
    return t.select("csno", "cand_no", F.size(A.difference("toks", markers)).cast("long").alias("n_content"))


# ---------------------------------------------------------------- scalar functions
@register("h8_six_digit_id", r"SELECT c_custkey, regexp_extract(c_name, '.+(\d{6}).?', 1) AS emp_id FROM customer")
def q_h8(spark, d):
    return table(spark, d, "customer").select("c_custkey", Tx.six_digit_id("c_name").alias("emp_id"))


@register("h9_time_text", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y%m%d') AS day FROM events")
def q_h9(spark, d):
    return table(spark, d, "events").select("event_id", Tx.clock_text("ts").alias("clock"), Tx.day_text("ts").alias("day"))


@register("h9_current_time_text", "SELECT event_id, true AS is_clock, true AS is_day FROM events")
def q_h9_now(spark, d):
    now = F.current_timestamp()
    return table(spark, d, "events").select("event_id", Tx.clock_text(now).rlike(r"^[0-2]\d:[0-5]\d:[0-5]\d$").alias("is_clock"),
                                            Tx.day_text(now).rlike(r"^20\d{6}$").alias("is_day"))


@register("h14_round4", "SELECT event_id, round(value / 3, 4) AS v4 FROM events")
def q_h14(spark, d):
    return table(spark, d, "events").select("event_id", Tx.round4(F.col("value") / 3).alias("v4"))


@register("h15_math_guards", """
    SELECT event_id, round(exp(-value / 100), 6) AS e, round(CASE WHEN value - 10 = 0 THEN 0.0 ELSE value / (value - 10) END, 6) + 0.0 AS ratio,
           least(value, 50.0) AS lo, greatest(value, 50.0) AS hi FROM events""")
def q_h15(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", r6(F.exp(-v / 100)).alias("e"),
                                            r6(Tx.safe_ratio(v, v - 10)).alias("ratio"),
                                            F.least(v, F.lit(50.0)).alias("lo"), F.greatest(v, F.lit(50.0)).alias("hi"))


@register("h16_frame_size_mb", """
    SELECT 'lineitem' AS table_name, round(sum(8 + 8 + 8 + 4 + 8 + 8 + 8 + 8 + coalesce(strlen(l_returnflag), 0)
           + coalesce(strlen(l_linestatus), 0) + 8) / 1048576.0, 6) AS mb FROM lineitem""")
def q_h16(spark, d):
    from tessera.operators.stats import frame_size_mb
    return frame_size_mb(table(spark, d, "lineitem"), "lineitem")


@register("h20_map_lookup", with_fixtures(["fx_dict_one", "fx_target"], """
    SELECT d.word, d.category, t.class_id FROM fx_dict_one d LEFT JOIN fx_target t USING (category)"""))
def q_h20(spark, d):
    m = F.create_map(*[x for c, i in fx.TARGET_CLASSES for x in (F.lit(c), F.lit(i))])
    red = reduce_dictionary(fx.fx_dict(spark, d), fx.fx_target(spark, d))
    return red.select("word", "category", A.lookup(m, F.col("category")).alias("class_id"))


@register("h20_strict_lookup", with_fixtures(["fx_word_class"], "SELECT word, class_id FROM fx_word_class"))
def q_h20_strict(spark, d):
    m = F.create_map(*[x for c, i in fx.TARGET_CLASSES for x in (F.lit(c), F.lit(i))])
    known = reduce_dictionary(fx.fx_dict(spark, d), fx.fx_target(spark, d)).where(F.col("category").isin(*[c for c, _ in fx.TARGET_CLASSES]))
    return known.select("word", A.lookup(m, F.col("category"), strict=True).alias("class_id"))


@register("h22_first_target_row_local", with_fixtures(["fx_dict_one"], "SELECT word, category FROM fx_dict_one"))
def q_h22_local(spark, d):
    return fx.fx_dict(spark, d).select("word", A.first_target_or_first("categories", _targets()).alias("category"))


@register("h18_union_of_sets", with_fixtures(["fx_eval", "fx_cand"], """
    SELECT csno, array_to_string(y_pred_ml, '') AS y_pred_ml FROM fx_eval WHERE csno IN (SELECT csno FROM fx_cand)"""))
def q_h18_union(spark, d):
    wc = word_classes(fx.fx_dict(spark, d), fx.fx_target(spark, d))
    sets = classes_of_words(fx.fx_cand_words(spark, d), ["csno", "cand_no"], wc).groupBy("csno").agg(F.collect_set("classes").alias("sets"))
    return (sets.join(fx.fx_truth_keys(spark, d), "csno", "left_semi")
            .select("csno", F.array_join(A.multi_hot_union("sets", EV.class_count(fx.fx_target(spark, d))), "").alias("y_pred_ml")))


@register("h21_json_output", with_fixtures(["fx_dict"], """
    SELECT word, CAST(to_json({'word': word, 'categories': categories}) AS VARCHAR) AS js FROM fx_dict"""))
def q_h21(spark, d):
    dic = fx.fx_dict(spark, d)
    return dic.select("word", F.to_json(F.struct("word", "categories")).alias("js"))
