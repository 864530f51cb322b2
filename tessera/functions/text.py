"""String functions: H1-H4, H7-H9, H11, H14, H15, H23."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the reference's: the separator tokens and the
# placeholder text for an empty answer or candidate.
SEPARATORS = ["[EOHW]", "[EOW]"]
PLACEHOLDER = "</>"
# Week tokens are generated by rule: "[1]" .. "[52]".
WEEKS = 52
WEEK_TOKENS = [f"[{i}]" for i in range(1, WEEKS + 1)]
# Six-digit id inside a path (H8).
SIX_DIGIT_ID = r".+(\d{6}).?"

_WEEK_RE = r"\[(?:[1-9]|[1-4][0-9]|5[0-2])\]"
_SEP_RE = "|".join(s.replace("[", r"\[").replace("]", r"\]") for s in SEPARATORS)
ONLY_MARKERS_RE = rf"^(?:\s|{_SEP_RE}|{_WEEK_RE})*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_hash(x) -> Column:                       # H1
    return F.replace(_c(x), F.lit("#"), F.lit(""))


def space_brackets(x) -> Column:                   # H2
    return F.replace(_c(x), F.lit("]["), F.lit("] ["))


def remove_spaces(x) -> Column:                    # H3
    return F.replace(_c(x), F.lit(" "), F.lit(""))


def join_words(x, sep: str = " ") -> Column:       # H4
    return F.array_join(_c(x), sep)


def is_piece(token) -> Column:                     # H7: '##' in token
    return _c(token).contains("##")


def is_week_token(token) -> Column:                # H7: token in week list
    return _c(token).isin(WEEK_TOKENS)


def is_separator(token) -> Column:
    return _c(token).isin(SEPARATORS)


def six_digit_id(path) -> Column:                  # H8
    return F.regexp_extract(_c(path), SIX_DIGIT_ID, 1)


def clock_text(ts) -> Column:                      # H9 '%H:%M:%S'
    return F.date_format(_c(ts), "HH:mm:ss")


def day_text(ts) -> Column:                        # H9 '%Y%m%d'
    return F.date_format(_c(ts), "yyyyMMdd")


def answer_or_placeholder(answer) -> Column:       # H11, answer side
    a = F.coalesce(_c(answer), F.lit(""))
    return F.when(F.length(a) < 2, F.lit(PLACEHOLDER)).otherwise(a)


def candidate_or_placeholder(cand) -> Column:      # H11, candidate side
    c = F.coalesce(_c(cand), F.lit(""))
    return F.when(c.rlike(ONLY_MARKERS_RE), F.lit(PLACEHOLDER)).otherwise(c)


def round4(x) -> Column:                           # H14
    return F.round(_c(x), 4)


def safe_ratio(num, den) -> Column:                # H15 division with zero guard
    return F.when(_c(den) == 0, F.lit(0.0)).otherwise(_c(num) / _c(den))


def week_token_of(i) -> Column:                    # H23
    return F.concat(F.lit("["), _c(i).cast("string"), F.lit("]"))


def week_tokens_frame(spark: SparkSession) -> DataFrame:
    return spark.range(1, WEEKS + 1).select(week_token_of("id").alias("token"))


def special_tokens_frame(spark: SparkSession) -> DataFrame:
    seps = spark.createDataFrame([(s,) for s in SEPARATORS], "token string")
    return seps.union(week_tokens_frame(spark))
