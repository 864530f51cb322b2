"""n-gram counts and clipped precision.

Grams are rows (ids, gram): an id's words never become one array, a hot id
spreads over many (id, gram) keys, and every aggregate is partial before the
shuffle. ``gram_rows`` makes them from token arrays, ``word_gram_rows`` from
one row per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordinals import with_neighbours

SEP = " "


def grams(tokens, n: int, sep: str = SEP) -> Column:
    """Array of n-grams (joined by ``sep``); empty when fewer than n tokens
    (``sequence(1, 0)`` would count down, hence the guard)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    k = F.size(t) - n + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(t, i, n), sep))
                  ).otherwise(F.array().cast("array<string>"))


def chars(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, ""))


def gram_rows(df: DataFrame, ids: list[str], tokens: str, n: int = 1) -> DataFrame:
    return df.select(*ids, F.explode(grams(tokens, n)).alias("gram"))


def word_gram_rows(words: DataFrame, ids: list[str], n: int = 1, order: tuple[str, ...] = ("ts", "event_id"),
                   word: str = "word", sep: str = SEP) -> DataFrame:
    """Grams of one row per word, in ``order``; for n = 1 nothing is ordered.
    The next words are found in blocks of rows, so a hot id has no task of its
    own; NULL words make no gram."""
    if n == 1:
        return words.select(*ids, F.col(word).alias("gram"))
    rows = with_neighbours(words.select(*ids, *order, word), ids, list(order), word, after=n - 1)
    parts = [word, *[f"{word}_after_{i}" for i in range(1, n)]]
    return rows.dropna(subset=parts).select(*ids, F.concat_ws(sep, *parts).alias("gram"))


def gram_counts(rows: DataFrame, ids: list[str]) -> DataFrame:
    return rows.groupBy(*ids, "gram").agg(F.count(F.lit(1)).alias("cnt"))


def ngram_counts(df: DataFrame, ids: list[str], tokens: str, n: int = 1) -> DataFrame:   # D8
    return gram_counts(gram_rows(df, ids, tokens, n), ids)


def clipped_counts(cand_rows: DataFrame, ref_rows: DataFrame, ids: list[str], ref_ids: list[str] | None = None,
                   ref_keys: list[str] = ()) -> DataFrame:                                # D9
    """Per (id, gram of the candidate): min(candidate count, max count over the
    references with the same ``ref_ids``). Reference grams are counted once per
    reference, however many candidates share it."""
    ref_ids = ref_ids or ids
    most = (ref_rows.groupBy(*ref_ids, *ref_keys, "gram").agg(F.count(F.lit(1)).alias("c"))
            .groupBy(*ref_ids, "gram").agg(F.max("c").alias("ref_max")))
    j = gram_counts(cand_rows, ids).join(most, [*ref_ids, "gram"], "left")
    return j.select(*ids, "gram", "cnt", F.least("cnt", F.coalesce("ref_max", F.lit(0))).alias("clip"))


def clipped_precision(cand_rows: DataFrame, ref_rows: DataFrame, ids: list[str], ref_ids: list[str] | None = None,
                      ref_keys: list[str] = (), candidates: DataFrame | None = None) -> DataFrame:   # D10, D11
    """sum(clipped counts) / candidate grams (1 when there are none).
    ``candidates`` (ids) keeps those without any gram, with precision 0."""
    sums = (clipped_counts(cand_rows, ref_rows, ids, ref_ids, ref_keys)
            .groupBy(*ids).agg(F.sum("clip").alias("clipped"), F.sum("cnt").alias("total")))
    if candidates is not None:
        sums = candidates.select(*ids).join(sums, ids, "left").na.fill(0, ["clipped", "total"])
    return sums.select(*ids, "clipped", "total", (F.col("clipped") / F.greatest("total", F.lit(1))).alias("precision"))


def modified_precision(cands: DataFrame, refs: DataFrame, ids: list[str], tokens: str,
                       n: int = 1, ref_ids: list[str] | None = None,
                       ref_keys: list[str] = ()) -> DataFrame:
    """``clipped_precision`` of token arrays (one row per candidate)."""
    return clipped_precision(gram_rows(cands, ids, tokens, n), gram_rows(refs, [*(ref_ids or ids), *ref_keys], tokens, n),
                             ids, ref_ids, ref_keys, cands)
