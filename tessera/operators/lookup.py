"""Dictionary lookups: H22 (reduce entries), C2 (word -> category),
C3 (category -> class), H19 (words -> class set)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip_hash


def reduce_dictionary(dictionary: DataFrame, targets: DataFrame) -> DataFrame:
    """H22 over a dictionary table ``(word, categories array)``.

    Distributed form: explode with position, mark target categories by a
    broadcast join with the class table (fixed size), keep per word the first
    target in dictionary order, else the first entry; empty lists give NULL.
    One shuffle on ``word`` with partial aggregation (min_by).
    """
    t = F.broadcast(targets.select("category", F.lit(0).alias("_miss")))
    ex = dictionary.select("word", F.posexplode_outer("categories").alias("_pos", "category"))
    ranked = ex.join(t, "category", "left").withColumn(
        "_rank", F.struct(F.coalesce("_miss", F.lit(1)), "_pos"))
    return ranked.groupBy("word").agg(F.min_by("category", "_rank").alias("category"))


def drop_empty_categories(df: DataFrame, category: str = "category") -> DataFrame:
    """Entries without a category (NULL or empty) are dropped."""
    return df.where(F.col(category).isNotNull() & (F.length(category) > 0))


def categories_to_classes(df: DataFrame, targets: DataFrame, category: str = "category") -> DataFrame:
    """Category -> class id; categories without a class are dropped
    (inner join with the class table, which is small by construction)."""
    return df.join(F.broadcast(targets.withColumnRenamed("category", category)), category, "inner")


def word_classes(dictionary: DataFrame, targets: DataFrame) -> DataFrame:
    """C3 applied to the dictionary side: (word, class_id) for words whose
    reduced category is a target; non-target and empty entries are dropped
    (B7, B8). Joining the small class table first keeps the big side to a
    single lookup join."""
    reduced = drop_empty_categories(reduce_dictionary(dictionary, targets))
    return categories_to_classes(reduced, targets).select("word", "class_id")


def lookup_words(words: DataFrame, dictionary: DataFrame, word_col: str = "word") -> DataFrame:
    """Left join on the word after stripping '#'; adds ``matched``. Spark
    broadcasts the dictionary if its measured bytes allow, else it shuffles
    both sides and splits a hot word's partition."""
    w = words.withColumn("word", strip_hash(word_col))
    d = dictionary.withColumn("_hit", F.lit(True))
    return (w.join(d, "word", "left")
            .withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit"))


def classes_of_words(words: DataFrame, keys: list[str], word_class: DataFrame, word_col: str = "word") -> DataFrame:
    """H19 on the long form (one row per word, NULL word allowed): keys + sorted
    distinct class ids.

    Words lose their '#' and are looked up with a left join; the distinct
    (key, class) rows come from a partial aggregation, so a key with a third of
    all words sends at most one row per class and task. Unmatched and
    non-target words give no class; a key without any keeps ``[]``. The set is
    bounded by the class count.
    """
    hit = words.select(*keys, strip_hash(word_col).alias("word")).join(word_class, "word", "left")
    return hit.groupBy(*keys).agg(F.array_sort(F.collect_set("class_id")).alias("classes"))


def classes_of(seqs: DataFrame, keys: list[str], word_class: DataFrame,
               words_col: str = "words") -> DataFrame:
    """H19 on sequences (an array of words per row; empty arrays keep ``[]``)."""
    return classes_of_words(seqs.select(*keys, F.explode_outer(words_col).alias("word")), keys, word_class)
