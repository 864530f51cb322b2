"""Queries of the tokenizer job: A12, D13, H5, H6, I6."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import vocab as V
from tessera.plans import fixtures as fx
from tessera.plans.catalog import register
from tessera.plans.oracle import with_fixtures
from tessera.session import scratch_path, table
from tessera.sources.sinks import save_tokenizer

_WF_SQL = ("wf", "SELECT w AS word, count(*) AS freq FROM (SELECT unnest(words) AS w FROM fx_cand) GROUP BY 1")

# Byte-level words in DuckDB: a separator goes before the last blank of a run that precedes a non-blank (what the
# pattern's look-ahead does), then the pattern without look-ahead takes the parts.
_BLANK = r"\s\x0b\x85\p{Z}"
_SPLIT = rf"regexp_replace(nfc_normalize(text), '([{_BLANK}])([^{_BLANK}])', chr(1) || '\1\2', 'g')"
_TAKE = rf"'''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+'"
_CODE_SQL = """CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN b
               WHEN b <= 32 THEN b + 256 WHEN b BETWEEN 127 AND 160 THEN b + 162 ELSE 323 END"""
_DOC_WF_SQL = [
    ("bytemap", f"SELECT list(chr(CAST({_CODE_SQL} AS INTEGER)) ORDER BY b) AS m FROM range(0, 256) r(b)"),
    ("rw", f"""SELECT w, count(*) AS freq FROM (
                 SELECT unnest(regexp_extract_all(part, {_TAKE})) AS w
                 FROM (SELECT unnest(string_split({_SPLIT}, chr(1))) AS part FROM documents)) WHERE length(w) > 0 GROUP BY 1"""),
    ("wf", """SELECT array_to_string(list_transform(range(1, strlen(w) + 1), lambda i:
                       m[CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS INTEGER) + 1]), '') AS word, CAST(freq AS BIGINT) AS freq
              FROM rw, bytemap""")]


def _train_sql(n_merges: int) -> list[tuple[str, str]]:
    """Merges one by one: a row holds all words, each symbol between two control characters."""
    return [("train(rank, ws, toks, l, r, c)", f"""
        SELECT 0, (SELECT list({{'s': chr(1) || array_to_string(string_split(word, ''), chr(2) || chr(1)) || chr(2), 'f': CAST(freq AS BIGINT)}}) FROM wf),
               []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT
        UNION ALL
        SELECT rank + 1,
               list_transform(ws, lambda w: {{'s': replace(w.s, chr(1) || best.l || chr(2) || chr(1) || best.r || chr(2), chr(1) || best.l || best.r || chr(2)), 'f': w.f}}),
               CASE WHEN list_contains(toks, best.l || best.r) THEN toks ELSE list_append(toks, best.l || best.r) END, best.l, best.r, best.c
        FROM (SELECT rank, ws, toks, (
                SELECT {{'l': p.l, 'r': p.r, 'c': CAST(sum(p.f) AS BIGINT)}} FROM (
                  SELECT q[i] AS l, q[i + 1] AS r, f FROM (
                    SELECT q, f, unnest(range(1, len(q))) AS i FROM (
                      SELECT string_split(substr(w.s, 2, length(w.s) - 2), chr(2) || chr(1)) AS q, w.f AS f FROM (SELECT unnest(ws) AS w)))) p
                GROUP BY p.l, p.r ORDER BY sum(p.f) DESC, p.l, p.r LIMIT 1) AS best
              FROM train WHERE len(toks) < {n_merges})
        WHERE best.c >= 2""")]


_MERGES_OUT = "SELECT CAST(rank - 1 AS INTEGER) AS rank, l AS left_sym, r AS right_sym, c AS cnt FROM train WHERE rank > 0"
_PAIRS_SQL = ("pairs", """
    SELECT s[i] AS left_sym, s[i + 1] AS right_sym, CAST(sum(freq) AS BIGINT) AS cnt
    FROM (SELECT s, freq, unnest(range(1, len(s))) AS i FROM (SELECT string_split(word, '') AS s, freq FROM wf))
    GROUP BY 1, 2""")
EVENT_VOCAB = 2 + 256 + 30     # special tokens + byte alphabet + merges
DOC_VOCAB = 2 + 256 + 120
FULL_VOCAB = 110_000


def event_word_freq(spark, d):
    """Word frequencies of the candidates' words (events)."""
    return (fx.fx_cand_words(spark, d).select(F.col("word").alias("w"))
            .groupBy("w").agg(F.count(F.lit(1)).alias("freq"))
            .select(V.byte_level("w").alias("word"), "freq"))


def _pairs(spark, d):
    w = event_word_freq(spark, d).select(V.symbols_of("word").alias("syms"), "freq")
    return V.pair_counts(w).select(F.col("left").alias("left_sym"), F.col("right").alias("right_sym"), "cnt")


@register("d13_pair_counts", with_fixtures(["fx_cand"], "SELECT left_sym, right_sym, cnt FROM pairs", [_WF_SQL, _PAIRS_SQL]))
def q_d13(spark, d):
    return _pairs(spark, d)


@register("d13_best_pair", with_fixtures(["fx_cand"], """
    SELECT left_sym, right_sym, cnt FROM pairs ORDER BY cnt DESC, left_sym, right_sym LIMIT 1""", [_WF_SQL, _PAIRS_SQL]))
def q_d13_best(spark, d):
    return _pairs(spark, d).orderBy(F.desc("cnt"), "left_sym", "right_sym").limit(1)


# The full-width forms of 0 to 9.
FULL_WIDTH_DIGITS = "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19"


@register("h5_nfkc_normalize", f"""
    SELECT doc_id, CAST(length(nfc_normalize(text)) AS INTEGER) AS n_chars, md5(nfc_normalize(text)) AS norm_md5,
           translate(text, '0123456789', '{FULL_WIDTH_DIGITS}') <> nfc_normalize(text) AS changed
    FROM documents""")
def q_h5(spark, d):
    """The documents with their digits written full-width, which NFKC undoes."""
    wide = F.translate("text", "0123456789", FULL_WIDTH_DIGITS)
    n = table(spark, d, "documents").select("doc_id", wide.alias("text"), V.nfkc(wide).alias("norm"))
    return n.select("doc_id", F.length("norm").alias("n_chars"), F.md5("norm").alias("norm_md5"),
                    (F.col("norm") != F.col("text")).alias("changed"))


@register("h6_byte_level_words", with_fixtures([], "SELECT word, CAST(sum(freq) AS BIGINT) AS freq FROM wf GROUP BY 1", _DOC_WF_SQL))
def q_h6(spark, d):
    return V.word_frequencies(table(spark, d, "documents"), "text", tasks=int(spark.conf.get("spark.sql.shuffle.partitions")))


def _merges_out(m):
    return m.select("rank", F.col("left").alias("left_sym"), F.col("right").alias("right_sym"), "cnt")


@register("i6_bpe_train_events", with_fixtures(["fx_cand"], _MERGES_OUT, [_WF_SQL, *_train_sql(30)], recursive=True))
def q_i6_events(spark, d):
    _, merges = V.train_bpe(event_word_freq(spark, d), EVENT_VOCAB)
    return _merges_out(merges)


@register("i6_bpe_train_documents", with_fixtures([], _MERGES_OUT, [*_DOC_WF_SQL, *_train_sql(120)], recursive=True))
def q_i6_docs(spark, d):
    _, merges = V.train_bpe(V.word_frequencies(table(spark, d, "documents"), "text", tasks=int(spark.conf.get("spark.sql.shuffle.partitions"))), DOC_VOCAB)
    return _merges_out(merges)


@register("i6_bpe_train_full")
def q_i6_full(spark, d):
    """The reference's vocabulary size, or as many merges as pairs occur twice.
    No SQL text: the recursion takes one query a merge; the shorter keys have it."""
    _, merges = V.train_bpe(V.word_frequencies(table(spark, d, "documents"), "text", tasks=int(spark.conf.get("spark.sql.shuffle.partitions"))), FULL_VOCAB)
    return _merges_out(merges)


@register("a12_save_tokenizer", with_fixtures(["fx_cand"], f"""
    SELECT v.token, CAST(v.id AS INTEGER) AS id, m.rank FROM (
      SELECT unnest(['<|endoftext|>', '<|padding|>']) AS token, unnest([0, 1]) AS id
      UNION ALL SELECT c, row_number() OVER (ORDER BY code) + 1
                FROM (SELECT CAST({_CODE_SQL} AS INTEGER) AS code, chr(CAST({_CODE_SQL} AS INTEGER)) AS c FROM range(0, 256) r(b))
      UNION ALL SELECT token, 257 + pos FROM (SELECT unnest(toks) AS token, unnest(range(1, len(toks) + 1)) AS pos FROM train
                                              WHERE rank = (SELECT max(rank) FROM train))) v
    LEFT JOIN (SELECT l || r AS token, CAST(rank - 1 AS INTEGER) AS rank FROM train WHERE rank > 0) m USING (token)""",
    [_WF_SQL, *_train_sql(30)], recursive=True))
def q_a12(spark, d):
    vocab, merges = V.train_bpe(event_word_freq(spark, d), EVENT_VOCAB)
    folder = scratch_path(spark, f"a12-{uuid.uuid4().hex}")
    save_tokenizer(vocab, merges, folder)
    v = spark.read.schema("token string, id int").parquet(f"{folder}/vocab.parquet")
    m = spark.read.schema("rank int, left string, right string, cnt long").json(f"{folder}/merges.jsonl")
    return v.join(m.select(F.concat("left", "right").alias("token"), "rank"), "token", "left")
