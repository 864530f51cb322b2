"""H5: NFKC normalisation. Spark has no built-in for it, so this is an
Arrow UDF (ASCII strings pass through); of a batch, ``ROWS`` texts at a time
are Python strings. Kept in its own module without postponed annotations,
which arrow_udf needs to read the type hints."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

ROWS = 256


def _normalise(x):
    if x is None or x.isascii():
        return x
    return unicodedata.normalize("NFKC", x)


def _nfkc_array(a: pa.Array) -> pa.Array:
    parts = [pa.array([_normalise(x) for x in a.slice(lo, ROWS).to_pylist()], pa.string()) for lo in range(0, len(a), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def nfkc(text):
    # Built on call, not at import: Python workers import this module too.
    udf = F.arrow_udf(_nfkc_array, "string")
    return udf(F.col(text) if isinstance(text, str) else text)
