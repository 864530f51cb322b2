"""Word LCS (H12): an Arrow-batched pandas UDF, bit-parallel.

The table row of the dynamic programme is one integer with a bit per word of
``b``, so a pair costs len(a) additions of len(b) bits. Kept without postponed
annotations (pandas_udf reads the type hints)."""

import pandas as pd
from pyspark.sql import functions as F


def lcs_words(a, b) -> int:
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    places = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full                      # zero bits: steps of the LCS length along b
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _lcs_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_words(x, y) for x, y in zip(a, b)], dtype="int64")


def lcs_length(a, b):
    udf = F.pandas_udf(_lcs_series, "long")
    return udf(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)
