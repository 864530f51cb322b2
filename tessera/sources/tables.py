"""Scans (A1-A7) and column selection by pattern.

Every file source takes a declared schema; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_sql(spark: SparkSession, sql: str | list[str], frames: dict[str, DataFrame] | None = None, use_regex: bool = False):
    """A1 / A2: one SQL text -> one frame, a list -> a list (lazy). ``{name}`` in
    a text stands for the frame of that name in ``frames``, so no view of the
    session is made or replaced. With ``use_regex`` back-quoted names are
    regular expressions (B4); the setting is put back afterwards (the frames
    are analysed already)."""
    texts = [sql] if isinstance(sql, str) else list(sql)
    key = "spark.sql.parser.quotedRegexColumnNames"
    old = spark.conf.get(key, "false")
    if use_regex:
        spark.conf.set(key, "true")
    try:
        res = [spark.sql(q, **{n: f for n, f in (frames or {}).items() if "{" + n + "}" in q}) for q in texts]
    finally:
        spark.conf.set(key, old)
    return res[0] if isinstance(sql, str) else res


def tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """The named Parquet tables, for SQL texts (A1)."""
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """A3: tab-separated text with a declared schema (header is an option)."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", str(header).lower())
            .option("mode", "FAILFAST").csv(path))


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A4 / A5: columnar scan; a declared schema prunes and types the columns."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


DICTIONARY_SCHEMA = "word string, categories array<string>"


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The word dictionary as a dimension table (word, categories)."""
    return read_parquet(spark, path, DICTIONARY_SCHEMA)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """A7 in jobs: select and cast to a declared target schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def select_regex(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose names match ``pattern`` (Java regex, whole name)."""
    return df.select(df.colRegex(f"`{pattern}`"))
