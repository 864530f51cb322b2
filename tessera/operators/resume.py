"""Skip keys that an earlier run already finished."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cast_key(df: DataFrame, key: str, to: str = "bigint", lenient: bool = False) -> DataFrame:
    """The key as an integer on both sides. ANSI cast raises on bad text
    (as the pandas cast did); ``lenient`` uses try_cast (NULL instead)."""
    c = F.col(key).try_cast(to) if lenient else F.col(key).cast(to)
    return df.withColumn(key, c)


def skip_done(todo: DataFrame, done: DataFrame, key: str = "csno") -> DataFrame:
    """Rows of ``todo`` whose key is absent from ``done``.

    A left anti join (not NOT IN, which is null-aware and plans as a nested
    loop). Duplicates on the done side do not change an anti join, so no
    distinct is needed; NULL keys are rejected on both sides first. Spark picks
    a broadcast when the done side is small, a shuffled join otherwise.
    """
    t = cast_key(todo, key).where(F.col(key).isNotNull())
    d = cast_key(done.select(key), key).where(F.col(key).isNotNull())
    return t.join(d, key, "left_anti")
