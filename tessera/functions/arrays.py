"""Array and set functions: G1-G3, G6, H17, H18, H20, H22, F3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def multi_hot(classes, class_num: int) -> Column:          # H17
    """``class_num + 1`` slots (class 0 kept, always 0 for ids from 1)."""
    cls = F.coalesce(_c(classes), F.array().cast("array<int>"))
    return F.transform(F.sequence(F.lit(0), F.lit(class_num)),
                       lambda c: F.array_contains(cls, c).cast("int"))


def multi_hot_union(class_lists, class_num: int) -> Column:  # H18
    return multi_hot(F.flatten(_c(class_lists)), class_num)


def distinct_sets(nested) -> Column:                       # G3 uniq_list
    return F.array_distinct(F.transform(_c(nested), lambda s: F.array_sort(F.array_distinct(s))))


def intersect(a, b) -> Column:                             # G1 (keeps left order)
    return F.array_intersect(_c(a), _c(b))


def overlaps(a, b) -> Column:                              # G1 as a test
    return F.arrays_overlap(_c(a), _c(b))


def difference(a, b) -> Column:                            # G2
    return F.array_except(_c(a), _c(b))


def concat_lists(a, b) -> Column:                          # G6
    return F.concat(_c(a), _c(b))


def lookup(map_col, key, strict: bool = False) -> Column:  # H20
    """``d.get(k)`` (lenient, NULL when missing) or ``d[k]`` (strict: error)."""
    value = F.element_at(_c(map_col), _c(key))
    if not strict:
        return value
    return F.when(F.map_contains_key(_c(map_col), _c(key)), value).otherwise(
        F.raise_error(F.concat(F.lit("missing key: "), _c(key).cast("string"))))


def first_target_or_first(categories, targets) -> Column:  # H22 row-local form
    """One category per entry: first that is a target, else the first; empty -> NULL."""
    return F.coalesce(F.get(F.array_intersect(_c(categories), _c(targets)), 0),
                      F.get(_c(categories), 0))


def argmax(values) -> Column:                               # F3, first maximum wins
    v = _c(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")
