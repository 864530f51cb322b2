"""Typed projections (B1, B2): which columns of a frame change type, and to what.

A ``Profile`` says how wide the plain types are; ``plain_type`` maps a column's
type to its plain one, and a column is cast only if that differs. Columns named
in ``overrides`` take the type written there instead, in Spark's own DDL
notation.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Profile(NamedTuple):
    """Target widths. ``floats_only`` turns every number into a float;
    otherwise decimals become whole numbers or reals by their scale (unless
    ``keep_decimals``), and longs and doubles take the given widths."""
    whole: T.DataType = T.LongType()
    real: T.DataType = T.DoubleType()
    floats_only: bool = False
    keep_decimals: bool = False


def plain_type(kind: T.DataType, profile: Profile) -> T.DataType:
    """The type a column of type ``kind`` has under ``profile``."""
    if profile.floats_only and isinstance(kind, T.NumericType):
        return T.FloatType()
    if isinstance(kind, T.DecimalType):
        return kind if profile.keep_decimals else (profile.real if kind.scale else profile.whole)
    return {T.DoubleType: profile.real, T.LongType: profile.whole}.get(type(kind), kind)


def read_overrides(overrides: Mapping[str, str] | None, columns: list[str]) -> dict[str, T.DataType]:
    """Column -> type. Every unknown column and every text that Spark cannot
    read as a type is reported in one error."""
    if overrides is None:
        return {}
    if not isinstance(overrides, Mapping):
        raise TypeError(f"column types must be a mapping, not {type(overrides).__name__}")
    wrong = [f"no column {name!r}" for name in overrides if name not in columns]
    types = {}
    for name, text in overrides.items():
        try:
            types[name] = T.DataType.fromDDL(str(text))
        except PySparkException:
            wrong.append(f"{name!r} has no type {text!r}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return types


def retyped(df: DataFrame, profile: Profile = Profile(), overrides: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with every column in its target type; unchanged if all are."""
    named = read_overrides(overrides, df.columns)
    targets = {f.name: named.get(f.name, plain_type(f.dataType, profile)) for f in df.schema}
    changed = {f.name for f in df.schema if targets[f.name] != f.dataType}
    if not changed:
        return df
    cells = {name: F.col("`" + name.replace("`", "``") + "`") for name in df.columns}
    return df.select(*[cells[name].cast(targets[name]).alias(name) if name in changed else cells[name] for name in df.columns])
