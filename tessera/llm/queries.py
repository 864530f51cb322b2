"""The registered queries of the corpus operators: each applies its operator,
with production parameters, to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (chunk_dedup, exact_dedup, html_text, langid, mixing, packing, secrets, simhash, spelling, substring_dedup,
                         token_align, url_filter, vec_dedup)
from tessera.llm.common import table

REGISTRY: dict[str, tuple] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        REGISTRY[key] = (fn, sql)
        return fn
    return add


@query("op2_exact_dedup", exact_dedup.ORACLE)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_url_filter", url_filter.ORACLE)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.listed_from_crawl(pages))


@query("op8_mixing", mixing.ORACLE)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_to_weights(table(spark, sf_dir, "documents"), mixing.PRODUCTION_TARGETS, mixing.PRODUCTION_REST)
    return mixed.withColumn("mix_rate", F.round("mix_rate", 6))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents")).drop("ids")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), with_spans=True)


@query("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_vector_dedup")
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vec_dedup.vector_groups(table(spark, sf_dir, "embeddings"))


@query("op7_chunk_dedup")
def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = chunk_dedup.remove_duplicate_chunks(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def _sha256(text: str) -> str:
    import hashlib
    return hashlib.sha256(text.encode()).hexdigest()


@query("op11_secret_scan")
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_copied")


@query("op12_token_align")
def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_align.align_tokens(table(spark, sf_dir, "documents"), write_groups=_sha256)
    return aligned.withColumnRenamed("groups", "groups_sha256")


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
