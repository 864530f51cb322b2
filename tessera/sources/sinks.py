"""Sinks (A8-A12): partitioned appends, dynamic partition overwrite,
tab-separated appends, typed export, vocabulary files.

Jobs write once per run (not once per batch). ``append_partitioned`` and
``append_tsv`` are plain appends: a run that is tried again adds its rows again.
``append_run`` writes under a run id, which a second try replaces, and publishes
the run by a commit record; ``committed_runs`` reads published runs only.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.stats import row_width
from tessera.session import delete_path, path_exists, scratch_path
from tessera.sources.casts import retyped


def append_partitioned(df: DataFrame, target: str, part_col: str = "part_dt",
                       fmt: str = "parquet", is_path: bool = True) -> None:
    """Append, partitioned by ``part_col``; ``target`` is a path or a
    catalog table name."""
    w = df.write.mode("append").partitionBy(part_col).format(fmt)
    if is_path:
        w.save(target)
    else:
        w.saveAsTable(target)


def overwrite_partitions(df: DataFrame, target: str, part_col: str = "part_dt",
                         fmt: str = "parquet", is_path: bool = True) -> None:
    """Dynamic partition overwrite: only partitions present in ``df``
    are replaced, all others stay."""
    spark = df.sparkSession
    key = "spark.sql.sources.partitionOverwriteMode"
    old = spark.conf.get(key, "static")
    spark.conf.set(key, "dynamic")
    try:
        if is_path:
            df.write.mode("overwrite").partitionBy(part_col).format(fmt).save(target)
        else:
            df.write.insertInto(target, overwrite=True)
    finally:
        spark.conf.set(key, old)


def tsv_ready(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs become JSON text (the CSV source rejects them)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def append_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    """A10: append tab-separated text with a header switch."""
    (tsv_ready(df).write.mode("append").option("sep", "\t").option("header", str(header).lower())
     .csv(path))


RUN = "run_id"


def append_run(df: DataFrame, target: str, run_id: str, part_col: str | None = None, fmt: str = "parquet",
               is_path: bool = True, **options) -> None:
    """A8, A10 for runs that may be tried again: the rows of ``run_id`` replace
    those of an earlier try, and the run counts from its commit record on (by
    path: a file in ``target``'s ``_commits`` folder; by name: a row of the
    table ``<target>_commits``). Until then its rows are not published, and
    other runs' rows are never touched."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run_id):
        raise ValueError(f"a run id of letters, digits, '.', '_' and '-', not {run_id!r}")
    spark = df.sparkSession
    record = spark.createDataFrame([(run_id,)], f"{RUN} string").coalesce(1)
    parts = [part_col] if part_col else []
    if is_path:
        (tsv_ready(df) if fmt == "csv" else df).write.mode("overwrite").partitionBy(*parts).format(fmt).options(**options).save(
            f"{target}/{RUN}={run_id}")
        record.write.mode("overwrite").json(f"{target}/_commits/{run_id}")
        return
    rows = df.withColumn(RUN, F.lit(run_id))
    if spark.catalog.tableExists(target):                    # a managed table: dropped partitions lose their files
        for held in spark.sql(f"SHOW PARTITIONS {target} PARTITION ({RUN} = '{run_id}')").collect():
            values = (unquote(v).replace("\\", "\\\\").replace("'", "\\'") for v in held[0].split("/"))
            spec = ", ".join("`{}` = '{}'".format(*v.split("=", 1)) for v in values)
            spark.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION ({spec})")
    rows.write.mode("append").partitionBy(RUN, *parts).format(fmt).options(**options).saveAsTable(target)
    log = f"{target}_commits"
    if not spark.catalog.tableExists(log) or spark.table(log).where(F.col(RUN) == run_id).isEmpty():
        record.write.mode("append").saveAsTable(log)


def committed_runs(spark: SparkSession, target: str, schema: str, fmt: str = "parquet", is_path: bool = True, **options) -> DataFrame:
    """Rows of the published runs of ``target``, with their ``run_id``;
    ``schema`` names the rows' own columns (partition columns included)."""
    fields = [f for f in T._parse_datatype_string(schema).fields if f.name != RUN]
    wanted = T.StructType([*fields, T.StructField(RUN, T.StringType())])
    log = f"{target}_commits"
    if is_path:
        if not path_exists(spark, f"{target}/_commits"):
            return spark.createDataFrame([], wanted)
        runs = spark.read.schema(f"{RUN} string").json(f"{target}/_commits/*").distinct()
        rows = spark.read.schema(wanted).format(fmt).options(**options).load(target)
    else:
        if not spark.catalog.tableExists(log):
            return spark.createDataFrame([], wanted)
        runs, rows = spark.table(log).distinct(), spark.table(target).select(*wanted.names)
    return rows.join(runs, RUN, "left_semi").select(*wanted.names)


def export_typed(df: DataFrame, path: str, mode: str = "overwrite", **typing) -> None:
    """The B1 projection, then Parquet."""
    retyped(df, **typing).write.mode(mode).parquet(path)


class ResultTooLarge(ValueError):
    """A local result over its limit of rows or bytes; nothing was sent."""


def local_result(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20, **typing):
    """A11 for the driver: the B1 projection (with ``typing``) as an Arrow
    table. The rows are written once, and their number and bytes are summed on
    the cluster before any is sent: over a limit ``ResultTooLarge`` is raised,
    and rows are never cut. The written copy is deleted afterwards."""
    typed = retyped(df, **typing) if typing else df
    path = scratch_path(df.sparkSession, f"local-result-{uuid.uuid4().hex}")
    try:
        typed.write.parquet(path)
        held = df.sparkSession.read.schema(typed.schema).parquet(path)
        rows, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_width(held)), F.lit(0))).head()
        if rows > max_rows or size > max_bytes:
            raise ResultTooLarge(f"{rows} rows of {size} bytes; the limits are {max_rows} rows and {max_bytes} bytes")
        return held.toArrow()
    finally:
        delete_path(df.sparkSession, path)


def save_tokenizer(vocab: DataFrame, merges: DataFrame, folder: str) -> None:
    """Vocabulary (token, id) and merges (rank, left, right), each as
    Parquet and as JSON lines."""
    for name, frame, order in (("vocab", vocab, "id"), ("merges", merges, "rank")):
        frame.orderBy(order).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        frame.orderBy(order).write.mode("overwrite").json(f"{folder}/{name}.jsonl")
