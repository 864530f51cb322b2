"""Queries of the word and score track: C4, C6, D5-D7, D12, D14, E1-E3, E7,
F2, F3, H1-H4, H7, H11, H23, K1, K2."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import metrics as M
from tessera.operators import scores as S
from tessera.operators import words as Wd
from tessera.plans import fixtures as fx
from tessera.plans.catalog import r6, register
from tessera.plans.oracle import with_fixtures
from tessera.session import table

PROMPT_LEN = 9      # padded prompt length L of the fixture (E7)
WEEK_SQL = r"'\[([1-9]|[1-4][0-9]|5[0-2])\]'"
KEYS = ["csno", "cand_no"]

_TOK_PROB = ("tok", f"""
    SELECT *, exp(score / ({PROMPT_LEN} + CAST(score < 0 AS INTEGER))) AS prob,
           CAST(sum(CASE WHEN contains(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY csno, cand_no ORDER BY pos
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS word_no
    FROM fx_token""")
_WORDS = ("wrd", """
    SELECT csno, cand_no, word_no, string_agg(token, '' ORDER BY pos) AS word,
           CASE WHEN word_no = 0 THEN 0.0 ELSE product(prob) END AS prob
    FROM tok GROUP BY 1, 2, 3""")
_GLUED = ("glued", f"""
    SELECT csno, cand_no, grp AS word_no, string_agg(word, '' ORDER BY word_no) AS word, product(prob) AS prob
    FROM (SELECT *, CAST(sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY csno, cand_no ORDER BY word_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp
          FROM (SELECT *, regexp_full_match(word, {WEEK_SQL})
                          AND coalesce(lag(word) OVER (PARTITION BY csno, cand_no ORDER BY word_no) IN ('[EOHW]', '[EOW]'), false) AS j
                FROM wrd))
    GROUP BY 1, 2, 3""")
_GEN_TEXT = ("gen", "SELECT csno, cand_no, string_agg(word, ' ' ORDER BY word_no) AS text FROM glued GROUP BY 1, 2")


def token_probs(spark, d):
    t = fx.fx_token(spark, d)
    return t.withColumn("prob", S.length_normalised_prob("score", F.lit(PROMPT_LEN)))


def merged_words(spark, d):
    return Wd.merge_pieces(token_probs(spark, d), KEYS)


def glued_words(spark, d):
    return Wd.glue_week_tokens(merged_words(spark, d), KEYS)


def generated_text(spark, d):
    per = Wd.words_per_candidate(glued_words(spark, d), KEYS)
    return per.select(*KEYS, T.join_words("words").alias("text"))


@register("e7_token_prob", with_fixtures(["fx_token"], "SELECT csno, cand_no, pos, round(prob, 6) AS prob FROM tok",
                                         [_TOK_PROB]))
def q_e7(spark, d):
    return token_probs(spark, d).select(*KEYS, "pos", r6("prob").alias("prob"))


@register("e1_merge_pieces", with_fixtures(["fx_token"], """
    SELECT csno, cand_no, word_no, word, round(prob, 6) AS prob FROM wrd""", [_TOK_PROB, _WORDS]))
def q_e1(spark, d):
    return merged_words(spark, d).select(*KEYS, "word_no", "word", r6("prob").alias("prob"))


@register("d12_word_prob_product", with_fixtures(["fx_token"], """
    SELECT csno, cand_no, word_no, round(CASE WHEN word_no = 0 THEN 0.0 ELSE product(exp(score)) END, 6) AS prob
    FROM tok GROUP BY 1, 2, 3""", [_TOK_PROB]))
def q_d12(spark, d):
    t = fx.fx_token(spark, d).withColumn("prob", F.exp("score"))
    return Wd.merge_pieces(t, KEYS).select(*KEYS, "word_no", r6("prob").alias("prob"))


@register("e2_glue_week_tokens", with_fixtures(["fx_token"], """
    SELECT csno, cand_no, word_no, word, round(prob, 6) AS prob FROM glued""", [_TOK_PROB, _WORDS, _GLUED]))
def q_e2(spark, d):
    return glued_words(spark, d).select(*KEYS, "word_no", "word", r6("prob").alias("prob"))


@register("e1_empty_candidates", with_fixtures(["fx_truth", "fx_token"], """
    SELECT k.csno, k.cand_no, coalesce(w.word_no, 0) AS word_no, coalesce(w.word, '') AS word,
           round(CASE WHEN w.word IS NULL THEN 0.0 ELSE w.prob END, 6) AS prob, coalesce(w.n_null, 0) AS n_null
    FROM (SELECT csno, unnest(range(1, 5)) AS cand_no FROM fx_truth) k
    LEFT JOIN (SELECT csno, cand_no, word_no, string_agg(token, '' ORDER BY pos) AS word,
                      CASE WHEN word_no = 0 THEN 0.0 ELSE product(CASE WHEN pos % 7 = 0 THEN NULL ELSE prob END) END AS prob,
                      count(*) FILTER (WHERE pos % 7 = 0) AS n_null FROM tok GROUP BY 1, 2, 3) w
    ON w.csno = k.csno AND w.cand_no = k.cand_no""", [_TOK_PROB]))
def q_e1_empty(spark, d):
    keys = fx.fx_truth_keys(spark, d).select("csno", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("cand_no"))
    t = token_probs(spark, d).withColumn("prob", F.when(F.col("pos") % 7 != 0, F.col("prob")))
    w = Wd.merge_pieces(t, KEYS, candidates=keys)
    return w.select(*KEYS, "word_no", "word", r6("prob").alias("prob"), "n_null")


@register("e2_cut_after_separator", with_fixtures(["fx_token"], f"""
    SELECT csno, word_no, word, round(prob, 6) AS prob FROM (
      SELECT csno, grp AS word_no, string_agg(word, '' ORDER BY word_no) AS word, product(prob) AS prob
      FROM (SELECT *, CAST(sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY csno ORDER BY word_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS grp,
                   coalesce(sum(CAST(word IN ('[EOHW]', '[EOW]') AS INTEGER)) OVER (PARTITION BY csno ORDER BY word_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
            FROM (SELECT *, regexp_full_match(word, {WEEK_SQL})
                            AND coalesce(lag(word) OVER (PARTITION BY csno ORDER BY word_no) IN ('[EOHW]', '[EOW]'), false) AS j
                  FROM (SELECT csno, word_no, string_agg(token, '' ORDER BY gpos) AS word,
                               CASE WHEN word_no = 0 THEN 0.0 ELSE product(prob) END AS prob
                        FROM (SELECT *, CAST(sum(CASE WHEN contains(token, '##') THEN 0 ELSE 1 END) OVER (PARTITION BY csno ORDER BY gpos
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS word_no
                              FROM (SELECT csno, token, cand_no * 1000000 + pos AS gpos,
                                           exp(score / ({PROMPT_LEN} + CAST(score < 0 AS INTEGER))) AS prob FROM fx_token))
                        GROUP BY 1, 2)))
      WHERE earlier = 0 OR (earlier = 1 AND j)
      GROUP BY csno, grp)"""))
def q_e2_cut(spark, d):
    """All candidates of a customer as one sequence, cut after its first separator."""
    t = token_probs(spark, d).select("csno", (F.col("cand_no") * 1_000_000 + F.col("pos")).alias("pos"), "token", "prob")
    g = Wd.glue_week_tokens(Wd.merge_pieces(t, ["csno"]), ["csno"], cut_after_separator=True)
    return g.select("csno", "word_no", "word", r6("prob").alias("prob"))


def _text_query(key, sql_expr, spark_fn):
    register(key, with_fixtures(["fx_token"], f"SELECT csno, cand_no, {sql_expr} AS text FROM gen",
                                [_TOK_PROB, _WORDS, _GLUED, _GEN_TEXT]))(
        lambda spark, d: generated_text(spark, d).select(*KEYS, spark_fn(F.col("text")).alias("text")))


_text_query("h4_join_words", "text", lambda c: c)
_text_query("h1_strip_hash", "replace(text, '#', '')", T.strip_hash)
_text_query("h2_space_brackets", "replace(text, '][', '] [')", T.space_brackets)
_text_query("h3_remove_spaces", "replace(text, ' ', '')", T.remove_spaces)


@register("h11_placeholders", with_fixtures(["fx_token"], f"""
    SELECT DISTINCT token,
       CASE WHEN regexp_full_match(token, '(\\s|\\[EOHW\\]|\\[EOW\\]|\\[([1-9]|[1-4][0-9]|5[0-2])\\])*') THEN '</>' ELSE token END AS cand_fixed,
       CASE WHEN length(replace(token, '#', '')) < 2 THEN '</>' ELSE replace(token, '#', '') END AS answer_fixed
    FROM fx_token"""))
def q_h11(spark, d):
    t = fx.fx_token(spark, d).select("token").distinct()
    return t.select("token", T.candidate_or_placeholder("token").alias("cand_fixed"),
                    T.answer_or_placeholder(T.strip_hash("token")).alias("answer_fixed"))


@register("h7_piece_and_week_counts", with_fixtures(["fx_token"], f"""
    SELECT csno, cand_no, count(*) FILTER (WHERE contains(token, '##')) AS n_pieces,
           count(*) FILTER (WHERE regexp_full_match(token, {WEEK_SQL})) AS n_week
    FROM fx_token GROUP BY 1, 2"""))
def q_h7(spark, d):
    t = fx.fx_token(spark, d)
    return t.groupBy(*KEYS).agg(F.count(F.when(T.is_piece("token"), 1)).alias("n_pieces"),
                                F.count(F.when(T.is_week_token("token"), 1)).alias("n_week"))


@register("h23_week_tokens", with_fixtures(["fx_token"], """
    SELECT w.token, coalesce(u.n, 0) AS n_used
    FROM (SELECT '[' || i || ']' AS token FROM range(1, 53) r(i)) w
    LEFT JOIN (SELECT token, count(*) AS n FROM fx_token GROUP BY 1) u USING (token)"""))
def q_h23(spark, d):
    used = fx.fx_token(spark, d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    w = T.week_tokens_frame(spark)
    return w.join(used, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n_used"))


@register("f2_top_k_candidates", with_fixtures(["fx_token"], """
    SELECT csno, cand_no, CAST(row_number() OVER (PARTITION BY csno ORDER BY score DESC, cand_no) AS INTEGER) AS rank,
           round(score, 6) + 0.0 AS score
    FROM (SELECT csno, cand_no, sum(score) AS score FROM fx_token GROUP BY 1, 2)
    QUALIFY rank <= 2"""))
def q_f2(spark, d):
    c = fx.fx_token(spark, d).groupBy(*KEYS).agg(F.sum("score").alias("score"))
    return S.top_k(c, "csno", "score", 2, "cand_no").select(*KEYS, "rank", r6("score").alias("score"))


@register("c6_ids_to_tokens", with_fixtures(["fx_token"], """
    SELECT csno, cand_no, string_agg(token, ' ' ORDER BY pos) AS text FROM fx_token GROUP BY 1, 2"""))
def q_c6(spark, d):
    vocab = fx.fx_vocab(spark, d)
    tok = fx.fx_token(spark, d).join(vocab, "token")
    ids = tok.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))),
                                             lambda x: x["id"]).alias("ids"))
    back = Wd.ids_to_tokens(ids, KEYS, vocab)
    return back.select(*KEYS, F.array_join("tokens", " ").alias("text"))


# ---------------------------------------------------------------- logits and scores
@register("f3_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings")
def q_f3(spark, d):
    return table(spark, d, "embeddings").select("vec_id", S.predict_ids("embedding").alias("pred"))


_LSM = ("lsm", """
    SELECT vec_id, label, e, m, ln(list_sum(list_transform(e, lambda v: exp(v - m)))) AS lse FROM (
      SELECT vec_id, label, e, list_max(e) AS m FROM (
        SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings))""")


@register("e3_log_softmax", with_fixtures([], """
    SELECT vec_id, label, round(e[label + 1] - m - lse, 6) AS logp_label, round(-lse, 6) AS logp_max FROM lsm""", [_LSM]))
def q_e3(spark, d):
    e = S.with_log_softmax(table(spark, d, "embeddings"), "embedding", "lsm")
    return e.select("vec_id", "label", r6(F.get("lsm", F.col("label"))).alias("logp_label"),
                    r6(F.array_max("lsm")).alias("logp_max"))


def _long_scores(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.posexplode("embedding").alias("token_id", "score")) \
            .withColumn("score", F.col("score").cast("double"))


@register("e3_log_softmax_long", with_fixtures([], """
    SELECT vec_id, label AS token_id, round(e[label + 1] - m - lse, 6) AS logp FROM lsm""", [_LSM]))
def q_e3_long(spark, d):
    n = S.log_softmax_long(_long_scores(spark, d), ["vec_id"])
    return n.where(F.col("token_id") == F.col("label")).select("vec_id", F.col("token_id").cast("int").alias("token_id"),
                                                               r6("score").alias("logp"))


_GATHER = [("seqs", """
    SELECT vec_id // 8 // 4 AS batch_id, vec_id // 8 AS seq_id, CAST(vec_id % 8 AS INTEGER) AS step, label AS token_id,
           CASE WHEN vec_id % 8 = 7 OR label = 0 THEN -1 ELSE vec_id // 8 END AS beam FROM embeddings"""),
    ("sc", """
    SELECT vec_id // 8 AS beam, CAST(vec_id % 8 AS INTEGER) AS step, CAST(i - 1 AS INTEGER) AS token_id, embedding[i]::DOUBLE AS score
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"""),
    ("lim", """
    SELECT batch_id, max(live) AS maxlen FROM (
      SELECT batch_id, seq_id, sum(CASE WHEN beam >= 0 THEN 1 ELSE 0 END) AS live FROM seqs GROUP BY 1, 2) GROUP BY 1""")]
_GATHER_SQL = with_fixtures([], """
    SELECT s.seq_id, s.step, round(CASE WHEN s.beam < 0 THEN 0.0 ELSE sc.score END, 6) AS transition_score
    FROM seqs s JOIN lim USING (batch_id)
    LEFT JOIN sc ON sc.beam = s.beam AND sc.step = s.step AND sc.token_id = s.token_id
    WHERE s.step < lim.maxlen""", _GATHER)


def _gather_inputs(spark, d):
    e = table(spark, d, "embeddings")
    seq = F.expr("vec_id div 8")
    step = (F.col("vec_id") % 8).cast("int")
    seqs = e.select((seq / 4).cast("long").alias("batch_id"), seq.alias("seq_id"), step.alias("step"),
                    F.col("label").alias("token_id"),
                    F.when((step == 7) | (F.col("label") == 0), F.lit(-1).cast("long")).otherwise(seq).alias("beam"))
    return e, seqs, seq, step


@register("c4_gather_scores", _GATHER_SQL)
def q_c4(spark, d):
    e, seqs, seq, step = _gather_inputs(spark, d)
    long = e.select(seq.alias("beam"), step.alias("step"), F.posexplode("embedding").alias("token_id", "score"))
    out = S.gather_scores(seqs, long, long_form=True)
    return out.select("seq_id", "step", r6("transition_score").alias("transition_score"))


@register("c4_gather_scores_array", _GATHER_SQL)
def q_c4_array(spark, d):
    e, seqs, seq, step = _gather_inputs(spark, d)
    arr = e.select(seq.alias("beam"), step.alias("step"), F.col("embedding").alias("scores"))
    out = S.gather_scores(seqs, arr)
    return out.select("seq_id", "step", r6("transition_score").alias("transition_score"))


_GATHER_NORM = ("scn", """
    SELECT beam, step, token_id, score - m - ln(sum(exp(score - m)) OVER (PARTITION BY beam, step)) AS score
    FROM (SELECT *, max(score) OVER (PARTITION BY beam, step) AS m FROM sc)""")


@register("c4_normalized_logits", with_fixtures([], """
    SELECT s.seq_id, s.step, round(CASE WHEN s.beam < 0 THEN 0.0 ELSE scn.score END, 6) AS transition_score
    FROM seqs s JOIN lim USING (batch_id)
    LEFT JOIN scn ON scn.beam = s.beam AND scn.step = s.step AND scn.token_id = s.token_id
    WHERE s.step < lim.maxlen""", _GATHER + [_GATHER_NORM]))
def q_c4_normalized(spark, d):
    e, seqs, seq, step = _gather_inputs(spark, d)
    arr = e.select(seq.alias("beam"), step.alias("step"), F.col("embedding").alias("scores"))
    out = S.gather_scores(seqs, arr, normalize_logits=True)
    return out.select("seq_id", "step", r6("transition_score").alias("transition_score"))


@register("c4_no_beam", with_fixtures([], """
    SELECT s.seq_id, s.step, round(sc.score, 6) AS transition_score
    FROM seqs s LEFT JOIN sc ON sc.beam = s.seq_id AND sc.step = s.step AND sc.token_id = s.token_id""", _GATHER))
def q_c4_no_beam(spark, d):
    e, seqs, seq, step = _gather_inputs(spark, d)
    arr = e.select(seq.alias("beam"), step.alias("step"), F.col("embedding").alias("scores"))
    out = S.gather_scores(seqs.drop("beam"), arr, beam=None)
    return out.select("seq_id", "step", r6("transition_score").alias("transition_score"))


# Weights of the fixture's linear scorer, by rule: w_i = ((i mod 7) - 3) / 10.
_WEIGHTS = [((i % 7) - 3) / 10.0 for i in range(64)]


@register("k1_score_batches", """
    SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1),
                         lambda i: embedding[i]::DOUBLE * (((i - 1) % 7) - 3) / 10.0)), 6) AS score
    FROM embeddings""")
def q_k1(spark, d):
    e = table(spark, d, "embeddings")
    out = S.score_batches(e, S.linear_scorer(_WEIGHTS), "embedding", "score double", ["vec_id"])
    return out.select("vec_id", r6("score").alias("score"))


@register("k2_metric_hook", """
    SELECT CAST(sum(CAST(list_position(l, list_max(l)) - 1 = label AS INTEGER)) AS BIGINT) AS hits, count(*) AS n,
           round(avg(CAST(list_position(l, list_max(l)) - 1 = label AS INTEGER)), 6) AS accuracy
    FROM (SELECT embedding AS l, label FROM embeddings)""")
def q_k2(spark, d):
    e = table(spark, d, "embeddings")
    hit = (S.predict_ids("embedding") == F.col("label")).cast("int")
    return e.select(hit.alias("h")).agg(F.sum("h").cast("long").alias("hits"), F.count(F.lit(1)).alias("n"),
                                        r6(F.avg("h")).alias("accuracy"))


_LOGIT_SEQS = ("sq", """
    SELECT seq, list(label ORDER BY vec_id) AS label, list(pred ORDER BY vec_id) AS pred FROM (
      SELECT vec_id, vec_id // 8 AS seq, label, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred FROM embeddings)
    GROUP BY 1""")


def _logit_sequences(spark, d):
    """Eight rows of logits are one sequence of predicted ids (F3) beside its labels."""
    e = table(spark, d, "embeddings").select("vec_id", "label", S.predict_ids("embedding").alias("pred"))
    s = e.groupBy(F.expr("vec_id div 8").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "pred"))).alias("s"))
    return s.select(F.transform("s", lambda x: x["label"]).alias("label"), F.transform("s", lambda x: x["pred"]).alias("pred"))


@register("d6_argmax_accuracy", with_fixtures([], """
    SELECT CAST(sum(h) AS BIGINT) AS hits, CAST(sum(k) AS BIGINT) AS positions, round(sum(h) / sum(k), 6) AS accuracy
    FROM (SELECT len(label) AS k, list_sum(list_transform(range(1, len(label) + 1), lambda i: CAST(label[i] = pred[i] AS INTEGER))) AS h FROM sq)""",
    [_LOGIT_SEQS]))
def q_d6_argmax(spark, d):
    a = M.token_accuracy(_logit_sequences(spark, d), shift=False)
    return a.select("hits", "positions", r6("accuracy").alias("accuracy"))


@register("k2_shifted_accuracy", with_fixtures([], """
    SELECT CAST(sum(h) AS BIGINT) AS hits, CAST(sum(k) AS BIGINT) AS positions, round(sum(h) / sum(k), 6) AS accuracy
    FROM (SELECT len(label) - 1 AS k, coalesce(list_sum(list_transform(range(1, len(label)), lambda i: CAST(label[i + 1] = pred[i] AS INTEGER))), 0) AS h FROM sq)""",
    [_LOGIT_SEQS]))
def q_k2_shifted(spark, d):
    a = M.token_accuracy(_logit_sequences(spark, d), shift=True)
    return a.select("hits", "positions", r6("accuracy").alias("accuracy"))


# ---------------------------------------------------------------- token accuracies
_IDS = ("ids", """
    SELECT t.csno, list_transform(t.words, lambda w: CAST(w[2:] AS INTEGER)) AS label,
           list_transform(c.words, lambda w: CAST(w[2:] AS INTEGER)) AS pred
    FROM fx_truth t JOIN fx_cand c ON c.csno = t.csno""")


def _ids(spark, d):
    t, c = fx.fx_truth(spark, d), fx.fx_cand(spark, d)
    def as_ids(col):
        return F.transform(col, lambda w: F.substring(w, 2, 10).cast("int"))
    return t.select("csno", as_ids("words").alias("label")).join(
        c.select("csno", as_ids("words").alias("pred")), "csno")


@register("d5_shifted_accuracy", with_fixtures(["fx_truth", "fx_cand"], """
    SELECT CAST(sum(h) AS BIGINT) AS hits, CAST(sum(k) AS BIGINT) AS positions, round(sum(h) / sum(k), 6) AS accuracy
    FROM (SELECT k, coalesce(list_sum(list_transform(range(1, k + 1), lambda i: CAST(coalesce(label[i + 1] = pred[i], false) AS INTEGER))), 0) AS h
          FROM (SELECT *, greatest(len(label) - 1, 0) AS k FROM ids))""", [_IDS]))
def q_d5(spark, d):
    a = M.token_accuracy(_ids(spark, d), shift=True)
    return a.select("hits", "positions", r6("accuracy").alias("accuracy"))


@register("d6_unshifted_accuracy", with_fixtures(["fx_truth", "fx_cand"], """
    SELECT CAST(sum(h) AS BIGINT) AS hits, CAST(sum(k) AS BIGINT) AS positions, round(sum(h) / sum(k), 6) AS accuracy
    FROM (SELECT k, coalesce(list_sum(list_transform(range(1, k + 1), lambda i: CAST(coalesce(label[i] = pred[i], false) AS INTEGER))), 0) AS h
          FROM (SELECT *, len(label) AS k FROM ids))""", [_IDS]))
def q_d6(spark, d):
    a = M.token_accuracy(_ids(spark, d), shift=False)
    return a.select("hits", "positions", r6("accuracy").alias("accuracy"))


@register("d7_accuracy_weighted", with_fixtures(["fx_truth", "fx_cand"], """
    SELECT round(sum(hw), 6) AS weighted_hits, round(sum(ws), 6) AS weight, round(sum(hw) / sum(ws), 6) AS accuracy
    FROM (SELECT coalesce(list_sum(list_transform(range(1, k + 1), lambda i: CAST(coalesce(label[i + 1] = pred[i], false) AS INTEGER) * CAST(i + 1 AS DOUBLE))), 0) AS hw,
                 coalesce(list_sum(list_transform(range(1, k + 1), lambda i: CAST(i + 1 AS DOUBLE))), 0) AS ws
          FROM (SELECT *, greatest(len(label) - 1, 0) AS k FROM ids))""", [_IDS]))
def q_d7(spark, d):
    ids = _ids(spark, d).withColumn("w", F.transform("label", lambda x, i: (i + 1).cast("double")))
    a = M.token_accuracy(ids, shift=True, weight_col="w")
    return a.select(r6("weighted_hits").alias("weighted_hits"), r6("weight").alias("weight"), r6("accuracy").alias("accuracy"))


@register("d7_accuracy_count", with_fixtures(["fx_truth", "fx_cand"], """
    SELECT round(CAST(sum(h) AS DOUBLE), 6) AS accuracy FROM (
      SELECT coalesce(list_sum(list_transform(range(1, k + 1), lambda i: CAST(coalesce(label[i + 1] = pred[i], false) AS INTEGER))), 0) AS h
      FROM (SELECT *, greatest(len(label) - 1, 0) AS k FROM ids))""", [_IDS]))
def q_d7c(spark, d):
    a = M.token_accuracy(_ids(spark, d), shift=True, normalize=False)
    return a.select(r6("accuracy").alias("accuracy"))


@register("d14_roc_auc", """
    WITH s AS (SELECT d.n_chars AS s, l.quality AS y FROM documents d JOIN labels l USING (doc_id)
               WHERE d.n_chars IS NOT NULL AND l.quality IS NOT NULL),
    r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM s)
    SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg,
           round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc
    FROM r""")
def q_d14(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    a = M.roc_auc(j, "n_chars", "quality")
    return a.select("n_pos", "n_neg", r6("auc").alias("auc"))
