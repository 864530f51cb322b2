"""The frames of FIXTURES.md part 2, built with DataFrame functions.

Each mirrors a DuckDB view in ``tessera.plans.oracle``; every order is total
because ``event_id`` is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import table

# Fixed values of the fixture: the target categories and their class ids.
TARGET_CLASSES = [("ECONOMY", 1), ("LARGE", 2), ("MEDIUM", 3), ("SMALL", 4)]
# Rows of the earlier output are the customers seen before this instant.
DONE_BEFORE = "2024-01-01 06:00:00"
TRUTH_FROM_WEEK = 4


def fx_event(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        F.col("user_id").alias("csno"),
        "ts",
        F.weekofyear("ts").alias("wk"),
        "value",
        F.concat(F.lit("m"), F.get_json_object("props", "$.k")).alias("word"),
    )


def fx_dict(spark: SparkSession, d: str) -> DataFrame:
    """Every part belongs to the word of its key rounded down to a multiple of
    three, so the dictionary grows with the table, a word has one to three
    categories, and words of events with other numbers are not in it."""
    return (table(spark, d, "part")
            .groupBy(F.concat(F.lit("m"), (F.col("p_partkey") - F.col("p_partkey") % 3).cast("string")).alias("word"))
            .agg(F.array_sort(F.collect_set("p_type")).alias("categories")))


def fx_target(spark: SparkSession, d: str | None = None) -> DataFrame:
    return spark.createDataFrame(TARGET_CLASSES, "category string, class_id int")


def fx_truth_words(spark: SparkSession, d: str) -> DataFrame:
    """What happened from the truth's first week on, one row per word."""
    return fx_event(spark, d).where(F.col("wk") >= TRUTH_FROM_WEEK).select("csno", "ts", "event_id", "word")


def fx_cand_words(spark: SparkSession, d: str) -> DataFrame:
    """The earlier weeks, one candidate each, one row per word."""
    return fx_event(spark, d).where(F.col("wk") < TRUTH_FROM_WEEK).select(
        "csno", F.col("wk").alias("cand_no"), "ts", "event_id", "word")


def sequences(words: DataFrame, keys: list[str]) -> DataFrame:
    """All words per key in (ts, event_id) order as one array: for operators
    whose unit is a whole text. Measures per word use the long form."""
    return (words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "word"))).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s["word"]).alias("words")))


def fx_truth(spark: SparkSession, d: str) -> DataFrame:
    return sequences(fx_truth_words(spark, d), ["csno"])


def fx_cand(spark: SparkSession, d: str) -> DataFrame:
    return sequences(fx_cand_words(spark, d), ["csno", "cand_no"])


def fx_truth_keys(spark: SparkSession, d: str) -> DataFrame:
    return fx_truth_words(spark, d).select("csno").distinct()


def fx_token(spark: SparkSession, d: str) -> DataFrame:
    """Generated pieces: word 'm69' -> 'm6', '##9'; each candidate closes, after
    its last piece, with '[EOW]' and its week marker. One pass, no union."""
    w = Window.partitionBy("csno", "wk").orderBy("ts", "event_id")
    e = (fx_event(spark, d).where(F.col("wk") < TRUTH_FROM_WEEK)
         .withColumn("n", F.row_number().over(w)).withColumn("last", F.lead("event_id").over(w).isNull()))
    n, v, word = F.col("n"), F.col("value"), F.col("word")

    def piece(pos, token, score):
        return F.struct(pos.cast("int").alias("pos"), token.alias("token"),
                        score.cast("double").alias("score"))

    pieces = F.array(
        piece(2 * n - 1, F.substring(word, 1, 2), -v / 100),
        F.when(F.length(word) > 2, piece(2 * n, F.concat(F.lit("##"), F.expr("substring(word, 3)")), -v / 200)),
        F.when(F.col("last"), piece(2 * n + 1, F.lit("[EOW]"), F.lit(-0.5))),
        F.when(F.col("last"), piece(2 * n + 2, F.concat(F.lit("["), F.col("wk").cast("string"), F.lit("]")), F.lit(-0.25))),
    )
    return (e.select("csno", F.col("wk").alias("cand_no"),
                     F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p"))
            .select("csno", "cand_no", "p.pos", "p.token", "p.score"))


def fx_pair(spark: SparkSession, d: str) -> DataFrame:
    c, t = fx_cand(spark, d), fx_truth(spark, d)
    return c.join(t.withColumnRenamed("words", "twords"), "csno").select(
        "csno", "cand_no",
        F.array_join("words", " ").alias("cand"),
        F.array_join("twords", " ").alias("answer"))


def fx_done(spark: SparkSession, d: str) -> DataFrame:
    """Keys of an earlier evaluation run (with repeats, as an appended file has)."""
    return (table(spark, d, "events")
            .where(F.col("ts") < F.lit(DONE_BEFORE).cast("timestamp_ntz"))
            .select(F.col("user_id").alias("csno")))


def fx_vocab_base(spark: SparkSession, d: str) -> DataFrame:
    """Word-piece vocabulary: distinct pieces of fx_token, ids 0.. in token
    order, by range-partitioned ordinals; written once."""
    from tessera.operators.ordinals import row_ordinals
    from tessera.session import materialize
    ids = row_ordinals(fx_token(spark, d).select("token").distinct(), ["token"], "rn")
    return materialize(ids.select("token", (F.col("rn") - 1).cast("int").alias("id")), "vocab")


def fx_vocab(spark: SparkSession, d: str) -> DataFrame:
    """The base vocabulary extended with the separators and week tokens."""
    from tessera.functions.text import SEPARATORS, WEEK_TOKENS
    from tessera.operators.vocab import extend_vocabulary
    return extend_vocabulary(fx_vocab_base(spark, d), SEPARATORS + WEEK_TOKENS)
