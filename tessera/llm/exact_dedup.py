"""Exact deduplication by sorting the content.

Texts are normalised (each run of ASCII white space becomes one space) and
range-partitioned by sampled splitters over a short sort key: the leading
characters and a 64-bit hash of the normalised text. Inside each range an
external sort on the key and then on the *whole* text puts equal texts next to
each other, and the sorted aggregation compares every text in full with its
neighbour and keeps the smallest identifier of each run. The splitters never
hold a long text, and only the text is needed there, so it crosses the network
once.

A text that more than ``hot_share`` of all rows carry is dealt into several
sub-runs by its identifiers (at most ``1 / hot_share`` such texts exist, which
bounds the broadcast), each sorted in its own range; the sub-runs of a text,
one row each, are then merged by the SHA-256 of the normalised text. The
decisions go back to the documents over the same digest.

Defined results: a null text counts as empty; empty texts form one group; a
null identifier is kept only if every identifier of its group is null; rows
that repeat both the identifier and the text are one document (each is
reported, ``unique_documents`` returns it once). Extra columns are ignored by
``exact_groups`` and passed through by ``unique_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, text_or_empty

#: Runs that differ from a single space; a lone space needs no rewriting.
SPACE_RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
PREFIX_CHARS = 16


def normalise(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hot_share: float = 1e-3) -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, text_sha256``."""
    norm = normalise(docs[text_col])
    members = stage(docs.select(docs[id_col].alias("id"), F.xxhash64(norm).alias("h"),
                                F.sha2(norm, 256).alias("text_sha256")), "exact-members")
    share = max(1.0, members.count() * hot_share)
    hot = (members.groupBy("h").agg(F.count("*").alias("n"))
           .filter(F.col("n") > share)
           .select("h", F.ceil(F.col("n") / share).cast("int").alias("ways")))
    texts = docs.select(docs[id_col].alias("id"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    dealt = (texts.join(F.broadcast(hot), "h", "left")       # at most 1 / hot_share rows
             .select("id", "norm", "h", F.substring("norm", 1, PREFIX_CHARS).alias("lead"),
                     F.pmod(F.xxhash64("id"), F.coalesce("ways", F.lit(1))).alias("deal")))
    runs = (dealt.repartitionByRange("lead", "h", "deal")
            .groupBy("lead", "h", "deal", "norm")            # sorted, neighbours compared in full
            .agg(F.min("id").alias("low"), F.count("*").alias("n"),
                 F.min(F.sha2("norm", 256)).alias("text_sha256")))
    # written, so that the join below shuffles both sides itself and can split a hot text's members
    groups = stage(runs.groupBy("text_sha256").agg(F.min("low").alias("keep_id"), F.sum("n").alias("group_size")),
                   "exact-groups")
    return (members.join(groups, "text_sha256")
            .select(F.col("id").alias(id_col), "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     hot_share: float = 1e-3) -> DataFrame:
    """The documents that stay, all their columns unchanged."""
    stay = (exact_groups(docs, id_col, text_col, hot_share).filter("kept")
            .select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).distinct())
    rows = docs.withColumn("__sha_of", F.sha2(normalise(docs[text_col]), 256))
    return (rows.join(stay, rows[id_col].eqNullSafe(stay["__id"]) & (rows["__sha_of"] == stay["__sha"]), "left_semi")
            .dropDuplicates([id_col, "__sha_of"]).drop("__sha_of"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""
