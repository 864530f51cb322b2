"""Typed projections: precedence, widths, overrides and their errors."""

import pytest
from pyspark.sql import types as T

from tessera.sources.casts import Profile, plain_type, read_overrides, retyped

LONG, DOUBLE, FLOAT, INT = T.LongType(), T.DoubleType(), T.FloatType(), T.IntegerType()


@pytest.mark.parametrize("kind, profile, want", [
    (T.DecimalType(10, 0), Profile(), LONG), (T.DecimalType(10, 2), Profile(), DOUBLE),
    (T.DecimalType(10, 0), Profile(whole=INT), INT), (T.DecimalType(10, 2), Profile(real=FLOAT), FLOAT),
    (T.DecimalType(10, 2), Profile(keep_decimals=True), T.DecimalType(10, 2)),
    (DOUBLE, Profile(), DOUBLE), (DOUBLE, Profile(real=FLOAT), FLOAT), (LONG, Profile(whole=INT), INT),
    (INT, Profile(), INT), (INT, Profile(floats_only=True), FLOAT), (T.DecimalType(9, 0), Profile(floats_only=True), FLOAT),
    (T.StringType(), Profile(floats_only=True), T.StringType()), (T.DateType(), Profile(whole=INT), T.DateType()),
])
def test_plain_type(kind, profile, want):
    assert plain_type(kind, profile) == want


def test_overrides_win_and_nothing_to_do_is_the_same_frame(spark):
    df = spark.createDataFrame([(1, "2", 3.5)], "`a b` long, c string, `d``e` double")
    assert retyped(df) is df
    out = retyped(df, Profile(whole=INT), {"c": "smallint", "a b": "string"})
    assert [f.dataType for f in out.schema] == [T.StringType(), T.ShortType(), DOUBLE] and out.columns == df.columns
    assert tuple(out.first()) == ("1", 2, 3.5)


def test_errors_name_everything_wrong(spark):
    assert read_overrides(None, ["a"]) == {}
    with pytest.raises(TypeError):
        read_overrides([("a", "int")], ["a"])
    with pytest.raises(ValueError, match="no column 'b'.*'a' has no type 'nonsense'"):
        read_overrides({"b": "int", "a": "nonsense"}, ["a"])
