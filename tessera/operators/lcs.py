"""Word LCS of long texts (H12) over words in long form, one row each.

Only places where both texts have the same word matter: sorted by the place in
one text, and downwards by the place in the other, the LCS length is the
longest strictly increasing run of the second places. Spark joins the words of
both texts into those matches (a word that many rows share is a skewed join
key, which AQE splits) and sorts them on disk; a task streams the matches of a
pair and keeps one array no longer than the LCS. So neither text is ever an
array, a truth that several candidates share is not copied for them, and two
texts of a million words cost what their matches cost. Texts of few distinct
words have nearly words x words matches: for those the bit-parallel form in
``functions.lcs_udf`` is the cheaper one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_matches(truth: DataFrame, cand: DataFrame, on: list[str], keys: list[str],
                 word: str = "word", pos: str = "pos") -> DataFrame:
    """``keys, i, j``: places of equal words in a candidate and its truth. Null
    words and null keys match nothing."""
    t = truth.select(*on, F.col(word).alias("__word"), F.col(pos).cast("long").alias("i"))
    c = cand.select(*keys, F.col(word).alias("__word"), F.col(pos).cast("long").alias("j"))
    return c.join(t, [*on, "__word"]).select(*keys, "i", "j")


def longest_runs(matches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lcs``: the longest chain of matches that rises in both places."""
    schema = T.StructType([matches.schema[k] for k in keys] + [T.StructField("lcs", T.LongType())])
    width = len(keys)

    def run(batches: Iterator) -> Iterator:
        from bisect import bisect_left

        import pyarrow as pa
        key, tails = None, []                                # tails[n]: least last place of a chain of n + 1

        def rows(done):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*k, n))) for k, n in done],
                                              schema=pa.schema([*fields, pa.field("lcs", pa.int64())]))

        fields = None
        for batch in batches:
            fields = [batch.schema.field(n) for n in range(width)]
            done = []
            places = batch.column(width + 1).to_pylist()
            for now, j in zip(zip(*(batch.column(n).to_pylist() for n in range(width))), places):
                if now != key:
                    if key is not None:
                        done.append((key, len(tails)))
                    key, tails = now, []
                at = bisect_left(tails, j)
                if at == len(tails):
                    tails.append(j)
                else:
                    tails[at] = j
            if done:
                yield rows(done)
        if key is not None:
            yield rows([(key, len(tails))])

    return (matches.select(*keys, "i", "j").repartition(*keys).sortWithinPartitions(*keys, "i", F.col("j").desc())
            .mapInArrow(run, schema))


def long_word_recall(truth: DataFrame, cand: DataFrame, on: list[str], keys: list[str],
                     word: str = "word", pos: str = "pos") -> DataFrame:
    """``keys, lcs, n_words, recall`` of every candidate (``keys``) that has
    words and a truth (``on``, some of the keys) with words: word LCS / truth
    words. No common word gives 0."""
    length = truth.groupBy(*on).agg(F.count(word).alias("n_words"))
    found = longest_runs(word_matches(truth, cand, on, keys, word, pos), keys)
    return (cand.select(*keys).distinct().join(found, keys, "left").join(length, on)
            .select(*keys, F.coalesce("lcs", F.lit(0)).alias("lcs"), "n_words")
            .withColumn("recall", F.when(F.col("n_words") > 0, F.col("lcs") / F.col("n_words"))))
