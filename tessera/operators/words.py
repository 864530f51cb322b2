"""Generated pieces -> words with probabilities (E1, E2, D12) and the
id <-> token lookup (C6).

Words are numbered by scans over ranges of (key, position), so a candidate
of any length spreads over tasks; the aggregations that follow are per word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_piece, is_separator, is_week_token
from tessera.operators.ordinals import segmented_sums, with_neighbours


def _ordered_concat(order: str, text: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))),
                                    lambda s: s[text]), "")


def merge_pieces(tokens: DataFrame, keys: list[str], pos: str = "pos", token: str = "token",
                 prob: str = "prob", candidates: DataFrame | None = None) -> DataFrame:
    """A token containing '##' joins the word before it; text is
    concatenated and probabilities multiplied (D12). Pieces before the first
    word form word 0 with probability 0.0. NULL probabilities are skipped by
    the product and counted in ``n_null``. Of ``candidates`` (keys), those
    without any token give one empty word of probability 0.0."""
    starts = tokens.select(*keys, pos, token, prob, F.when(is_piece(token), 0).otherwise(1).alias("word"))
    t = segmented_sums(starts, keys, [pos], ["word"]).withColumnRenamed("word_upto", "word_no")
    g = t.groupBy(*keys, "word_no").agg(_ordered_concat(pos, token).alias("word"),
                                         F.product(prob).alias("_p"),
                                         F.count(F.when(F.col(prob).isNull(), 1)).alias("n_null"))
    words = g.select(*keys, "word_no", "word",
                     F.when(F.col("word_no") == 0, F.lit(0.0)).otherwise(F.col("_p")).alias("prob"), "n_null")
    if candidates is None:
        return words
    return (candidates.select(*keys).join(words, keys, "left")
            .select(*keys, F.coalesce("word_no", F.lit(0)).alias("word_no"), F.coalesce("word", F.lit("")).alias("word"),
                    F.when(F.col("word").isNull(), F.lit(0.0)).otherwise(F.col("prob")).alias("prob"),
                    F.coalesce("n_null", F.lit(0)).alias("n_null")))


def glue_week_tokens(words: DataFrame, keys: list[str], order: str = "word_no",
                     word: str = "word", prob: str = "prob", cut_after_separator: bool = False) -> DataFrame:
    """A week token right after a separator is glued to it (text
    concatenated, probabilities multiplied). Glued words are not separators,
    so chains cannot form; a leading week token stands alone. With
    ``cut_after_separator`` the words after the first separator (with its week
    token) go."""
    near = with_neighbours(words.select(*keys, order, word, prob), keys, [order], word, before=1)
    joins = is_week_token(word) & F.coalesce(is_separator(f"{word}_before_1"), F.lit(False))
    t = near.select(*keys, order, word, prob, F.when(joins, 0).otherwise(1).alias("_own"), is_separator(word).cast("int").alias("_sep"))
    t = segmented_sums(t, keys, [order], ["_own", "_sep"]).withColumnRenamed("_own_upto", "_grp")
    if cut_after_separator:
        earlier = F.col("_sep_upto") - F.coalesce("_sep", F.lit(0))
        t = t.where((earlier == 0) | ((earlier == 1) & (F.col("_own") == 0)))
    g = t.groupBy(*keys, "_grp").agg(_ordered_concat(order, word).alias(word),
                                      F.product(prob).alias(prob))
    return g.select(*keys, F.col("_grp").alias(order), word, prob)


def words_per_candidate(words: DataFrame, keys: list[str], order: str = "word_no") -> DataFrame:
    """Words and their probabilities as ordered arrays, one row per candidate."""
    s = F.array_sort(F.collect_list(F.struct(order, "word", "prob")))
    return words.groupBy(*keys).agg(s.alias("_s")).select(
        *keys, F.transform("_s", lambda x: x["word"]).alias("words"),
        F.transform("_s", lambda x: x["prob"]).alias("probs"))


def ids_to_tokens(seqs: DataFrame, keys: list[str], vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """``convert_ids_to_tokens``: posexplode, vocabulary join, ordered
    collect per sequence; an empty sequence stays empty."""
    ex = seqs.select(*keys, F.posexplode_outer(ids).alias("_pos", "id"))
    j = ex.join(vocab.select("id", "token"), "id", "left")
    s = F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "token"))))
    return j.groupBy(*keys).agg(F.transform(s, lambda x: x["token"]).alias("tokens"))


def decode_wordpiece(tokens) -> F.Column:
    """Tokens -> text as a word-piece decoder does: join by spaces, then glue
    '##' continuations to the word before."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.trim(F.replace(F.array_join(t, " "), F.lit(" ##"), F.lit("")))
