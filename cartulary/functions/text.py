"""Scalar functions over text and numbers, as column expressions."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that carry no meaning in a name, and shorthand for long names.
GENERIC_WORDS = ("department", "of", "the", "and", "office", "us", "u", "s")
ALIASES = {
    "dod": "defense",
    "dept of defense": "defense",
    "department of defense": "defense",
    "hhs": "health and human services",
    "hud": "housing and urban development",
    "dhs": "homeland security",
    "doj": "justice",
    "doe": "energy",
    "usda": "agriculture",
    "va": "veterans affairs",
    "dot": "transportation",
    "treasury": "treasury",
    "dc": "district of columbia",
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalized(c: Column | str) -> Column:
    """Lower case; anything but letters, digits and spaces as a space; single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]+", " "), " +", " "))


def content_words(c: Column | str) -> Column:
    """The distinct words of a normalised text that are longer than two and not generic."""
    words = F.array_distinct(F.split(normalized(c), " "))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), F.array(*map(F.lit, GENERIC_WORDS)))


def overlap(candidate: Column, question: Column) -> Column:
    """Share of the candidate's words that the question has; 0 without any."""
    return F.when(F.size(candidate) == 0, 0.0).otherwise(F.size(F.array_intersect(candidate, question)) / F.size(candidate))


def mentions(question: Column | str, name: Column | str) -> Column:
    """Whether a normalised question holds a normalised name as whole words."""
    return F.contains(F.concat(F.lit(" "), normalized(question), F.lit(" ")), F.concat(F.lit(" "), normalized(name), F.lit(" ")))


def expanded(question: Column | str) -> Column:
    """The normalised question, followed by what its aliases stand for."""
    q = normalized(question)
    found = [F.when(F.regexp_like(q, F.lit(rf"\b{a}\b")), F.lit(" " + full)).otherwise("") for a, full in ALIASES.items()]
    return F.concat(q, *found)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts; Spark has no such function.  For distinct names, not for facts."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def best_window_ratio(name: pd.Series, text: pd.Series) -> pd.Series:
    """The best similarity of a name with any run of as many words of a text."""
    from difflib import SequenceMatcher

    def best(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        words, n = y.split(), max(1, len(x.split()))
        runs = {" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}
        return max(SequenceMatcher(None, x, r).ratio() for r in runs)

    return pd.Series([best(x, y) for x, y in zip(name, text, strict=True)], dtype="float64")


def number_of(c: Column | str) -> Column:
    """A number from text with thousands separators; null if it isn't one."""
    return F.regexp_replace(F.trim(col(c)), ",", "").try_cast("double")


def numbers_in(c: Column | str) -> Column:
    """All numbers of a text, in order."""
    found = F.regexp_extract_all(col(c), F.lit(r"(-?[0-9][0-9,]*\.?[0-9]*)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double"))


def close(actual: Column, wanted: Column, tolerance: float) -> Column:
    return F.abs(actual - wanted) <= tolerance * F.greatest(F.lit(1.0), F.abs(wanted))


def rounded(c: Column | str, digits: int) -> Column:
    """Rounds as DuckDB does: the scaled number to a whole one, halves away from 0.  Spark's `round` goes by the shortest decimal text."""
    scale = 10.0**digits
    whole = F.round(col(c) * scale)
    return F.when(F.abs(whole) < float("inf"), whole / scale).otherwise(col(c))


def district(c: Column | str) -> Column:
    """Two letters and a district number as XX-DD; null for anything else."""
    c = F.upper(F.trim(col(c)))
    pattern = r"^([A-Z]{2})-?0?([0-9]{1,2})$"
    return F.when(F.regexp_like(c, F.lit(pattern)), F.concat(F.regexp_extract(c, pattern, 1), F.lit("-"), F.lpad(F.regexp_extract(c, pattern, 2), 2, "0")))


def county(c: Column | str) -> Column:
    """A county's name without punctuation and the word county, in lower case."""
    words = F.regexp_replace(F.lower(col(c)), r"\bcounty\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(words, "[^a-z0-9 ]+", ""), " +", " "))


def padded(c: Column | str, width: int) -> Column:
    """A numeric code as text with leading zeros."""
    return F.lpad(col(c).cast("string"), width, "0")


def title(c: Column | str) -> Column:
    return F.initcap(F.lower(col(c)))


def lookup(c: Column | str, pairs: dict[str, str]) -> Column:
    """A value by a small fixed map; null if it has none."""
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))[col(c)]


# What a metric's name says about its unit, in order.
METRIC_KINDS = {
    "money": "contracts|grants|payments|wage|liabilit|assets|revenue|expenses|flow|amount|position|cash|spending",
    "percent": "poverty|education|owner|renter|white|black|asian|hispanic|satisfied|risk_averse|literacy|constraint|financing|share|ratio|per_1000",
    "count": "employees|residents|population|household|jobs|count",
}


def metric_kind(name: Column | str) -> Column:
    low = F.lower(F.coalesce(col(name), F.lit("")))
    return reduce(lambda rest, kind: F.when(F.regexp_like(low, F.lit(METRIC_KINDS[kind])), kind).otherwise(rest), reversed(METRIC_KINDS), F.lit("generic"))


def _formatted(value: Column, pattern: str) -> Column:
    """A number by a pattern; what isn't finite as nan and inf."""
    written = F.call_function("format_number", value, F.lit(pattern))
    return F.replace(F.replace(written, F.lit("NaN"), F.lit("nan")), F.lit("\u221e"), F.lit("inf"))


def shown(name: Column | str, value: Column | str) -> Column:
    """A value as text in its metric's unit; shares up to 1.5 count as fractions."""
    v, kind = col(value), metric_kind(name)
    size, sign = F.abs(v), F.when(v < 0, "-").otherwise("")
    money = F.when(size >= 1e9, F.concat(_formatted(size / 1e9, "0.00"), F.lit("B"))).when(size >= 1e6, F.concat(_formatted(size / 1e6, "0.00"), F.lit("M"))).when(size >= 1e3, F.format_number(size, 0)).otherwise(_formatted(size, "0.00"))
    percent = F.concat(_formatted(F.when(size <= 1.5, v * 100).otherwise(v), "0.0"), F.lit("%"))
    return F.when(v.isNull(), "N/A").when(kind == "money", F.concat(sign, F.lit("$"), money)).when(kind == "percent", percent).when(kind == "count", F.format_number(v, 0)).otherwise(_formatted(v, "#,##0.##"))
