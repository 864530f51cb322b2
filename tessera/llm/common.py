"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import delete_path, scratch_path, table

__all__ = ["stage", "discard", "table", "text_or_empty"]


def text_or_empty(col) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the run's folder under the shared checkpoint folder
    and read it back: cuts the lineage, survives lost executors, and is
    computed once however often it is read. The files go with ``discard``, or
    when the driver ends."""
    path = scratch_path(df.sparkSession, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete staged frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_staged_path", None):
            delete_path(df.sparkSession, path)
