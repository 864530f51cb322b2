"""H16 re-aimed: the in-memory size of a frame as a table statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIXED = {T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
          T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.ShortType: 2, T.ByteType: 1,
          T.BooleanType: 1}


def _width(f: T.StructField) -> Column:
    for t, w in _FIXED.items():
        if isinstance(f.dataType, t):
            return F.lit(w)
    if isinstance(f.dataType, T.DecimalType):
        return F.lit(16)
    if isinstance(f.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0))


def row_width(df: DataFrame) -> Column:
    """Bytes of a row: the sum of its columns' widths."""
    return sum((_width(f) for f in df.schema.fields), F.lit(0).cast("long"))


def frame_size_mb(df: DataFrame, name: str) -> DataFrame:
    """Sum of per-column byte widths over all rows, in MB (one global,
    partially aggregated sum)."""
    return df.agg(F.round(F.sum(row_width(df)) / F.lit(1048576.0), 6).alias("mb")).select(
        F.lit(name).alias("table_name"), "mb")
