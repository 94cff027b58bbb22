"""Scalar Column functions: text, dates, money, arrays (§2.9)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def js_round(c: Column, digits: int = 0) -> Column:
    """floor(x + 1/2): halves go up, also below zero."""
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def positive_ln(c: Column) -> Column:
    """ln, null at or below 0."""
    return F.when(c > 0, F.ln(c))


def symmetric_ratio(a: Column, b: Column) -> Column:
    return F.greatest(a, b) / F.least(a, b)


def quarter_ordinal(day: Column) -> Column:
    return (F.year(day) * 4 + F.quarter(day) - 1).cast("int")


def quarter_label(ordinal: Column) -> Column:
    return F.concat(F.floor(ordinal / 4).cast("string"), F.lit("-Q"), (ordinal % 4 + 1).cast("string"))


def known_on(day: Column, precision: Column) -> Column:
    """First day on which a result dated with that precision counts as known (D7); null: never."""
    return F.when(precision == "day", F.date_add(day, 1)).when(precision == "month", F.add_months(F.trunc(day, "MM"), 1)).when(precision == "year", F.add_months(F.trunc(day, "YYYY"), 12))


def half_life(age: Column, length: float) -> Column:
    return F.pow(F.lit(0.5), age / F.lit(length))


def age_years(day: Column, now: Column) -> Column:
    """Years of 31,557,600 seconds."""
    return F.datediff(now, day) * 86400.0 / 31557600.0


def normal_title(c: Column) -> Column:
    """Lower case without quotes, brackets' content and punctuation, single blanks (F1)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), "['\"]", ""), r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def tokens(c: Column, stop: list[str] = ()) -> Column:
    """Distinct tokens of a normal title without stop words."""
    found = F.filter(F.split(normal_title(c), " "), lambda t: t != "")
    return F.array_distinct(F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Canonical decomposition without marks (F2); no built-in decomposes."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


def osa(a: str, b: str, most: int) -> int | None:
    """Optimal string alignment distance, null beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
    return row[-1] if row[-1] <= most else None


def osa_distance(most: int):
    """Column function of two strings (F4); the built-in distance counts a transposition twice."""

    @F.pandas_udf(T.IntegerType())
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else osa(x, y, most) for x, y in zip(a, b, strict=True)], dtype="Int32")

    return distance


def typo_budget(c: Column) -> Column:
    """Edits allowed by length: none below 4 letters, one below 8, else two."""
    return F.when(F.length(c) < 4, 0).when(F.length(c) < 8, 1).otherwise(2)


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Value of the first pattern that matches."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(c.rlike(pattern), value).otherwise(out)
    return out


def earliest_mention(c: Column, words: list[str]) -> Column:
    """The word that stands first in the text."""
    places = F.array(*[F.struct(F.instr(c, w).alias("at"), F.lit(w).alias("word")) for w in words])
    return F.array_min(F.filter(places, lambda p: p["at"] > 0))["word"]


def fingerprint(parts: list[Column], least: int) -> Column:
    """Hash of the discriminators, null with fewer than ``least`` of them."""
    given = F.size(F.array_compact(F.array(*[p.cast("string") for p in parts])))
    return F.when(given >= least, F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary")))


def strip_html(c: Column) -> Column:
    text = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def century_year(c: Column, pivot: int) -> Column:
    """Two-digit year to four digits: above the pivot the 1900s."""
    return F.when(c >= 100, c).when(c > pivot, 1900 + c).otherwise(2000 + c)


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def delta_encode(a: Column) -> Column:
    return F.transform(a, lambda x, i: x - F.when(i > 0, F.get(a, i - 1)).otherwise(F.lit(0)))


def prefix_sum(a: Column) -> Column:
    return F.transform(a, lambda _, i: F.aggregate(F.slice(a, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x))


def marginal(price: Column, bands: list[tuple[float, float]]) -> Column:
    """Price with a premium charged band by band: (lower limit, rate) in ascending order."""
    total = price
    for (low, rate), high in zip(bands, [*(b[0] for b in bands[1:]), None], strict=True):
        inside = F.greatest(price - low, F.lit(0.0)) if high is None else F.greatest(F.least(price, F.lit(high)) - low, F.lit(0.0))
        total = total + inside * rate
    return total


def marginal_inverse(total: Column, bands: list[tuple[float, float]]) -> Column:
    """Price whose ``marginal`` is the total: exact, piecewise linear."""
    at, out = 0.0, None
    for (low, rate), high in zip(bands, [*(b[0] for b in bands[1:]), None], strict=True):
        value = F.lit(low) + (total - at) / (1 + rate)
        if high is not None:
            at_high = at + (high - low) * (1 + rate)
            out = (F.when(total <= at_high, value) if out is None else out.when(total <= at_high, value))
            at = at_high
        else:
            out = value if out is None else out.otherwise(value)
    return out


def round_increment(price: Column) -> Column:
    """Whether a price is a whole step of the increment usual at its size."""
    step = F.when(price < 1000, 10).when(price < 10000, 100).otherwise(1000)
    return price % step == 0
