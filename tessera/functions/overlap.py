"""Row-local text overlap (H10, H12, H13, G5): higher-order functions over
the two strings of a row, so no shuffle and no row per character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import (answer_or_placeholder, candidate_or_placeholder,
                                    remove_spaces, space_brackets, strip_hash)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def char_count(s, ch) -> Column:
    """Occurrences of the one-character string ``ch`` in ``s``."""
    s = _c(s)
    return F.length(s) - F.length(F.replace(s, ch, F.lit("")))


def char_multiset_overlap(a, b) -> Column:                     # G5
    """|multiset(a) ∩ multiset(b)| over characters: sum over the distinct
    characters of ``a`` of min(count in a, count in b). O(distinct x length)."""
    a, b = _c(a), _c(b)
    chars = F.array_distinct(F.split(a, ""))
    return F.aggregate(chars, F.lit(0).cast("long"),
                       lambda acc, ch: acc + F.least(char_count(a, ch), char_count(b, ch)))


def char_overlap_ratio(answer, cand) -> Column:                # H10
    """Overlap of the answer (placeholder if shorter than 2) and the candidate
    (placeholder if only markers) with its spaces removed, / answer length."""
    a = answer_or_placeholder(answer)
    c = remove_spaces(candidate_or_placeholder(cand))
    return char_multiset_overlap(a, c) / F.length(a)


def char_precision(answer, cand) -> Column:                    # H13 (D10 with unit char, n = 1)
    """Clipped character counts of the candidate against the answer / the
    candidate's length (1 if empty); spaces count."""
    a = space_brackets(answer_or_placeholder(answer))
    c = space_brackets(strip_hash(candidate_or_placeholder(cand)))
    return char_multiset_overlap(c, a) / F.greatest(F.length(c), F.lit(1))


def words_of(text) -> Column:
    t = F.trim(_c(text))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, r"\s+"))


def rouge_l_recall(answer, cand) -> Column:   # H12
    """Word LCS / answer words, after '#' removal and bracket spacing."""
    from tessera.functions.lcs_udf import lcs_length
    a = words_of(space_brackets(answer_or_placeholder(answer)))
    c = words_of(space_brackets(strip_hash(candidate_or_placeholder(cand))))
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(lcs_length(a, c) / F.size(a))
