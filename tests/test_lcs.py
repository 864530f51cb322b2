"""Word LCS in long form: against the plain table, on long texts, on edges."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.lcs_udf import lcs_words
from tessera.operators.lcs import long_word_recall


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def long_form(spark, rows, names):
    return spark.createDataFrame([(*k, n, w) for *k, words in rows for n, w in enumerate(words)],
                                 ", ".join(f"{c} long" for c in names) + ", pos long, word string").repartition(5)


def test_random_texts_share_a_truth(spark):
    rng = np.random.default_rng(4)
    truths = [(t, [f"w{k}" for k in rng.integers(0, 9, rng.integers(1, 40))]) for t in range(8)]
    cands = [(t, c, [f"w{k}" for k in rng.integers(0, 12, rng.integers(1, 40))]) for t in range(9) for c in range(3)]
    got = long_word_recall(long_form(spark, truths, ["t"]), long_form(spark, cands, ["t", "c"]), ["t"], ["t", "c"])
    words = dict(truths)
    want = {(t, c): (plain(words[t], w), len(words[t])) for t, c, w in cands if t in words}
    assert {(r.t, r.c): (r.lcs, r.n_words) for r in got.collect()} == want
    assert all(plain(words[t], w) == lcs_words(words[t], w) for t, c, w in cands if t in words)


def test_two_texts_of_a_million_words_with_few_matches(spark):
    n = 1_000_000
    def text(prefix, shared):
        return spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("pos"), F.when(F.col("id") % 20 == 0, shared)
                                     .otherwise(F.concat(F.lit(prefix), "id")).alias("word"))
    place = F.col("id") / 20
    rising = text("a", F.concat(F.lit("s"), place.cast("long")))
    # blocks of ten shared words in falling order: one of each block can stay
    turned = text("b", F.concat(F.lit("s"), (F.floor(place / 10) * 10 + 9 - place % 10).cast("long")))
    row = long_word_recall(rising, turned, ["k"], ["k"]).collect()
    assert [(r.lcs, r.n_words, r.recall) for r in row] == [(n // 200, n, 1 / 200)]


def test_edges(spark):
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b"), (2, 0, None), (None, 0, "a")], "k int, pos int, word string")
    c = spark.createDataFrame([(1, 0, "b"), (1, 1, None), (2, 0, "x"), (3, 0, "a"), (None, 0, "a")], "k int, pos int, word string")
    assert sorted((r.k, r.lcs, r.n_words, r.recall) for r in long_word_recall(t, c, ["k"], ["k"]).collect()) == [
        (1, 1, 2, 0.5), (2, 0, 0, None)]
    assert long_word_recall(t.limit(0), c, ["k"], ["k"]).collect() == []
    assert long_word_recall(t, c.limit(0), ["k"], ["k"]).collect() == []
