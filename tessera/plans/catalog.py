"""Query registry: key -> (Spark builder, DuckDB oracle text or None).

tables of ``sf_dir`` (directly or through the fixture frames) and returns a
lazy DataFrame with scalar columns: integers, strings, and doubles rounded to
6 places, aliased to the same names as in the oracle text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, sql)
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def load_all() -> dict[str, tuple[Builder, str | None]]:
    # Importing the query modules fills the registry.
    from tessera.plans import (q_eval, q_text, q_words, q_access, q_prep,  # noqa: F401
                               q_vocab, q_stream)
    return REGISTRY
