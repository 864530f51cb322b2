"""Queries of the text track: C5, D2, D8-D11, E6, G5, H10, H12, H13."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import overlap as O
from tessera.operators import metrics as M
from tessera.operators import ngrams as N
from tessera.operators.lcs import long_word_recall
from tessera.operators.ordinals import batch_of, row_ordinals, shard_of, shard_start
from tessera.plans import fixtures as fx
from tessera.plans.catalog import r6, register
from tessera.plans.oracle import with_fixtures
from tessera.session import table

# DuckDB spellings of the row-local text rules (must equal the Spark ones).
MARKERS_SQL = r"'(\s|\[EOHW\]|\[EOW\]|\[([1-9]|[1-4][0-9]|5[0-2])\])*'"


def ans_sql(a: str) -> str:
    return f"(CASE WHEN length(coalesce({a}, '')) < 2 THEN '</>' ELSE {a} END)"


def cand_sql(c: str) -> str:
    return f"(CASE WHEN regexp_full_match(coalesce({c}, ''), {MARKERS_SQL}) THEN '</>' ELSE {c} END)"


def ovl_sql(a: str, b: str) -> str:
    return (f"coalesce(list_sum(list_transform(list_distinct(string_split({a}, '')), lambda ch: "
            f"least(length({a}) - length(replace({a}, ch, '')), length({b}) - length(replace({b}, ch, ''))))), 0)")


def words_sql(x: str) -> str:
    return f"(CASE WHEN length(trim({x})) = 0 THEN []::VARCHAR[] ELSE string_split_regex(trim({x}), '\\s+') END)"


def lcs_sql(a: str, b: str) -> str:
    return (f"list_reduce({a}, lambda prev, aw: list_reduce(range(1, len({b}) + 1), lambda cur, j: "
            f"list_append(cur, CASE WHEN {b}[j] = aw THEN prev[j] + 1 ELSE greatest(prev[j + 1], cur[j]) END), [0]), "
            f"list_transform(range(0, len({b}) + 1), lambda x: 0))[len({b}) + 1]")


# One CTE with every per-pair text measure, shared by several oracle texts.
PAIR_SCORES = ("pair_scores", f"""
    SELECT csno, cand_no,
           {ovl_sql('a1', "replace(c1, ' ', '')")} / length(a1) AS overlap,
           {ovl_sql('c2', 'a2')} / greatest(length(c2), 1) AS bleu,
           CASE WHEN len({words_sql('a2')}) = 0 THEN 0.0
                ELSE {lcs_sql(words_sql('a2'), words_sql('c2'))} / len({words_sql('a2')}) END AS rouge
    FROM (SELECT *, replace(a1, '][', '] [') AS a2, replace(replace(c1, '#', ''), '][', '] [') AS c2
          FROM (SELECT csno, cand_no, {ans_sql('answer')} AS a1, {cand_sql('cand')} AS c1 FROM fx_pair))""")


def pair_scores(spark, d):
    p = fx.fx_pair(spark, d)
    return p.select("csno", "cand_no",
                    O.char_overlap_ratio("answer", "cand").alias("overlap"),
                    O.char_precision("answer", "cand").alias("bleu"),
                    O.rouge_l_recall("answer", "cand").alias("rouge"))


@register("c5_pair_truth", with_fixtures(["fx_pair"], "SELECT csno, cand_no, cand, answer FROM fx_pair"))
def q_c5(spark, d):
    return fx.fx_pair(spark, d)


@register("h10_char_overlap", with_fixtures(["fx_pair"], "SELECT csno, cand_no, round(overlap, 6) AS overlap FROM pair_scores",
                                            [PAIR_SCORES]))
def q_h10(spark, d):
    return pair_scores(spark, d).select("csno", "cand_no", r6("overlap").alias("overlap"))


@register("h13_char_precision", with_fixtures(["fx_pair"], "SELECT csno, cand_no, round(bleu, 6) AS bleu FROM pair_scores",
                                              [PAIR_SCORES]))
def q_h13(spark, d):
    return pair_scores(spark, d).select("csno", "cand_no", r6("bleu").alias("bleu"))


@register("h12_rouge_l_recall", with_fixtures(["fx_pair"], "SELECT csno, cand_no, round(rouge, 6) AS rouge FROM pair_scores",
                                              [PAIR_SCORES]))
def q_h12(spark, d):
    return pair_scores(spark, d).select("csno", "cand_no", r6("rouge").alias("rouge"))


@register("g5_char_intersection", with_fixtures(["fx_pair"], f"""
    SELECT csno, cand_no, CAST({ovl_sql('answer', 'cand')} AS BIGINT) AS n_common FROM fx_pair"""))
def q_g5(spark, d):
    return fx.fx_pair(spark, d).select("csno", "cand_no", O.char_multiset_overlap("answer", "cand").alias("n_common"))


@register("d2_running_mean", with_fixtures(["fx_pair"], """
    SELECT count(*) AS n, round(avg(overlap), 4) AS overlap_mean, round(avg(bleu), 4) AS bleu_mean,
           round(avg(rouge), 4) AS rouge_mean FROM pair_scores""", [PAIR_SCORES]))
def q_d2(spark, d):
    s = pair_scores(spark, d)
    return M.running_means(s, ["overlap", "bleu", "rouge"])


_W, _BS, _K = 4, 2, 5


@register("e6_progress_log", with_fixtures(["fx_pair", "fx_truth"], f"""
    SELECT shard, batch, CAST(sum(c) OVER w AS BIGINT) AS n,
           round(sum(s) OVER w / sum(c) OVER w, 4) AS running_mean
    FROM b WINDOW w AS (PARTITION BY shard ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    QUALIFY batch % {_K} = 0""", [PAIR_SCORES, ("o", f"""
        SELECT csno, shard, (rn - 1 - shard * (n // {_W})) // {_BS} AS batch FROM (
          SELECT csno, rn, n, CAST(CASE WHEN n // {_W} = 0 THEN {_W - 1}
                 ELSE least((rn - 1) // (n // {_W}), {_W - 1}) END AS INTEGER) AS shard
          FROM (SELECT csno, row_number() OVER (ORDER BY csno) AS rn, count(*) OVER () AS n FROM fx_truth))"""),
        ("b", "SELECT shard, batch, sum(overlap) AS s, count(overlap) AS c FROM pair_scores JOIN o USING (csno) GROUP BY 1, 2")]))
def q_e6(spark, d):
    o = row_ordinals(fx.fx_truth_keys(spark, d), ["csno"], total_col="n")
    o = o.withColumn("shard", shard_of("rn", "n", _W))
    o = o.withColumn("batch", batch_of(F.col("rn") - shard_start("shard", "n", _W), _BS))
    v = pair_scores(spark, d).join(o.select("csno", "shard", "batch"), "csno")
    return M.progress_log(v, "overlap", "shard", "batch", _K)


# ---------------------------------------------------------------- n-grams
def _truth_and_refs(spark, d):
    """Unigram rows of the truth and of the candidates."""
    return (N.word_gram_rows(fx.fx_truth_words(spark, d), ["csno"]),
            N.word_gram_rows(fx.fx_cand_words(spark, d), ["csno", "cand_no"]))


@register("d8_ngram_counts", with_fixtures(["fx_truth"], """
    SELECT csno, gram, count(*) AS cnt FROM (
      SELECT csno, unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i:i+1], ' '))) AS gram
      FROM fx_truth) GROUP BY 1, 2"""))
def q_d8(spark, d):
    return N.gram_counts(N.word_gram_rows(fx.fx_truth_words(spark, d), ["csno"], 2), ["csno"])


_CLIP = [("cc", """SELECT csno, w AS gram, count(*) AS cnt FROM (SELECT csno, unnest(words) AS w FROM fx_truth) GROUP BY 1, 2"""),
         ("rc", """SELECT csno, gram, max(c) AS ref_max FROM (
                     SELECT csno, cand_no, w AS gram, count(*) AS c FROM (SELECT csno, cand_no, unnest(words) AS w FROM fx_cand)
                     GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
         ("clip", """SELECT cc.csno, cc.gram, cc.cnt, least(cc.cnt, coalesce(rc.ref_max, 0)) AS clip
                     FROM cc LEFT JOIN rc ON cc.csno = rc.csno AND cc.gram = rc.gram""")]


@register("d9_count_clip", with_fixtures(["fx_truth", "fx_cand"], "SELECT csno, gram, cnt, clip FROM clip", _CLIP))
def q_d9(spark, d):
    t, c = _truth_and_refs(spark, d)
    return N.clipped_counts(t, c, ["csno"], ref_keys=["cand_no"])


@register("d10_modified_precision", with_fixtures(["fx_truth", "fx_cand"], """
    SELECT t.csno, CAST(coalesce(s.clipped, 0) AS BIGINT) AS clipped, CAST(len(t.words) AS BIGINT) AS total,
           round(coalesce(s.clipped, 0) / greatest(len(t.words), 1), 6) AS precision
    FROM fx_truth t LEFT JOIN (SELECT csno, sum(clip) AS clipped FROM clip GROUP BY 1) s USING (csno)""", _CLIP))
def q_d10(spark, d):
    t, c = _truth_and_refs(spark, d)
    p = N.clipped_precision(t, c, ["csno"], ref_keys=["cand_no"])
    return p.select("csno", F.col("clipped").cast("long").alias("clipped"), F.col("total").cast("long").alias("total"),
                    r6("precision").alias("precision"))


@register("d11_sentence_precision", with_fixtures(["fx_truth", "fx_cand"], """
    SELECT c.csno, c.cand_no, round(coalesce(s.clipped, 0) / greatest(len(c.words), 1), 6) AS precision
    FROM fx_cand c LEFT JOIN (
      SELECT csno, cand_no, sum(least(cnt, coalesce(rc, 0))) AS clipped FROM (
        SELECT x.csno, x.cand_no, x.gram, x.cnt, r.rc FROM
          (SELECT csno, cand_no, w AS gram, count(*) AS cnt FROM (SELECT csno, cand_no, unnest(words) AS w FROM fx_cand) GROUP BY 1, 2, 3) x
          LEFT JOIN (SELECT csno, w AS gram, count(*) AS rc FROM (SELECT csno, unnest(words) AS w FROM fx_truth) GROUP BY 1, 2) r
          ON x.csno = r.csno AND x.gram = r.gram) GROUP BY 1, 2) s
    ON c.csno = s.csno AND c.cand_no = s.cand_no
    WHERE c.csno IN (SELECT csno FROM fx_truth)"""))
def q_d11(spark, d):
    t, c = _truth_and_refs(spark, d)
    c = c.join(t.select("csno"), "csno", "left_semi")
    p = N.clipped_precision(c, t, ["csno", "cand_no"], ref_ids=["csno"])
    return p.select("csno", "cand_no", r6("precision").alias("precision"))


# ---------------------------------------------------------------- second source: conversations
_CONV = ("conv_pair", """
    SELECT u.conv_id, u.turn, u.text AS answer, a.text AS cand FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'""")


@register("h10_char_overlap_conversations", with_fixtures([], f"""
    SELECT conv_id, turn, round({ovl_sql('a1', "replace(c1, ' ', '')")} / length(a1), 6) AS overlap,
           round({ovl_sql("replace(replace(c1, '#', ''), '][', '] [')", "replace(a1, '][', '] [')")}
                 / greatest(length(replace(replace(c1, '#', ''), '][', '] [')), 1), 6) AS bleu
    FROM (SELECT conv_id, turn, {ans_sql('answer')} AS a1, {cand_sql('cand')} AS c1 FROM conv_pair)""", [_CONV]))
def q_h10_conv(spark, d):
    cv = table(spark, d, "conversations")
    u = cv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("answer"))
    a = cv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cand"))
    p = u.join(a, ["conv_id", "turn"])
    return p.select("conv_id", "turn", r6(O.char_overlap_ratio("answer", "cand")).alias("overlap"),
                    r6(O.char_precision("answer", "cand")).alias("bleu"))


@register("h12_rouge_l_recall_conversations", with_fixtures([], f"""
    SELECT conv_id, turn, round(CASE WHEN len(aw) = 0 THEN 0.0 ELSE {lcs_sql('aw', 'cw')} / len(aw) END, 6) AS rouge
    FROM (SELECT conv_id, turn, {words_sql("replace(a1, '][', '] [')")} AS aw,
                 {words_sql("replace(replace(c1, '#', ''), '][', '] [')")} AS cw
          FROM (SELECT conv_id, turn, {ans_sql('answer')} AS a1, {cand_sql('cand')} AS c1 FROM conv_pair))""", [_CONV]))
def q_h12_conv(spark, d):
    cv = table(spark, d, "conversations")
    u = cv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("answer"))
    a = cv.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("cand"))
    p = u.join(a, ["conv_id", "turn"])
    return p.select("conv_id", "turn", r6(O.rouge_l_recall("answer", "cand")).alias("rouge"))


@register("h12_long_form_conversations", with_fixtures([], f"""
    SELECT conv_id, turn, CAST({lcs_sql('aw', 'cw')} AS BIGINT) AS lcs, CAST(len(aw) AS BIGINT) AS n_words,
           round({lcs_sql('aw', 'cw')} / len(aw), 6) AS recall
    FROM (SELECT conv_id, turn, {words_sql('answer')} AS aw, {words_sql('cand')} AS cw FROM conv_pair)
    WHERE len(aw) > 0 AND len(cw) > 0""", [_CONV]))
def q_h12_long(spark, d):
    cv = table(spark, d, "conversations")
    def words(role, turn):
        return cv.where(F.col("role") == role).select("conv_id", turn.alias("turn"), F.posexplode(O.words_of("text")).alias("pos", "word"))
    keys = ["conv_id", "turn"]
    found = long_word_recall(words("user", F.col("turn")), words("assistant", F.col("turn") - 1), keys, keys)
    return found.withColumn("recall", r6("recall"))


@register("h12_long_form_candidates", with_fixtures(["fx_truth", "fx_cand"], f"""
    SELECT c.csno, c.cand_no, CAST({lcs_sql('t.words', 'c.words')} AS BIGINT) AS lcs, CAST(len(t.words) AS BIGINT) AS n_words,
           round({lcs_sql('t.words', 'c.words')} / len(t.words), 6) AS recall
    FROM fx_cand c JOIN fx_truth t USING (csno)"""))
def q_h12_candidates(spark, d):
    t = fx.fx_truth(spark, d).select("csno", F.posexplode("words").alias("pos", "word"))
    c = fx.fx_cand(spark, d).select("csno", "cand_no", F.posexplode("words").alias("pos", "word"))
    return long_word_recall(t, c, ["csno"], ["csno", "cand_no"]).withColumn("recall", r6("recall"))
