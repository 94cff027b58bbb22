"""Parsers of titles, dimensions, dates and filters as Column expressions (§2.9). Rules are parameters or
small public tables; nothing here knows one market's vocabulary."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English number words.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Roman numerals.
ROMAN = [("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)]


def _case(key: Column, table: dict, default: Column | None = None) -> Column:
    out = default if default is not None else F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _some(c: Column) -> Column:
    return F.when(c != "", c)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return _some(F.regexp_extract(c, pattern, group))


def rewritten(c: Column, aliases: list[tuple[str, str]]) -> Column:
    """Lower-cased query with whole alias phrases replaced, in order."""
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(" "))
    for phrase, word in aliases:
        out = F.replace(out, F.lit(f" {phrase} "), F.lit(f" {word} "))
    return F.trim(out)


def number_word(c: Column) -> Column:
    """Digits or a number word up to twelve (F8)."""
    return F.coalesce(F.expr("null").cast("int"), _case(F.lower(c), {w: i for i, w in enumerate(NUMBER_WORDS)}).cast("int"), F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int")))


def set_size(c: Column) -> Column:
    """n of "set of n" or "n pieces" in a title, in digits or words (F8)."""
    words = "|".join(["[0-9]{1,4}", *NUMBER_WORDS])
    return F.coalesce(number_word(extracted(F.lower(c), rf"\bset of ({words})\b")), number_word(extracted(F.lower(c), rf"\b({words}) pieces\b")))


def roman(c: Column) -> Column:
    """Value of a Roman numeral in upper case, null for other text (F8)."""
    digit = lambda x: _case(x, {k: v for k, v in ROMAN if len(k) == 1}, F.lit(0))
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    total = F.aggregate(F.transform(letters, lambda x, i: F.when(digit(x) < F.coalesce(digit(F.get(letters, i + 1)), F.lit(0)), -digit(x)).otherwise(digit(x))), F.lit(0), lambda a, x: a + x)
    return F.when(c.rlike("^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


def card(c: Column) -> Column:
    """struct<year, set, number, grader, grade> of a card title such as "1996 Base Set #4 PSA 9" (F12)."""
    return F.struct(
        extracted(c, r"\b((?:18|19|20)[0-9]{2})\b").cast("int").alias("year"),
        extracted(c, r"\b(?:18|19|20)[0-9]{2}\s+(.+?)\s+#").alias("set"),
        extracted(c, r"#([A-Za-z0-9-]+)").alias("number"),
        extracted(c, r"\b(PSA|BGS|SGC|CGC)\s+[0-9]").alias("grader"),
        extracted(c, r"\b(?:PSA|BGS|SGC|CGC)\s+([0-9]{1,2}(?:\.[05])?)\b").cast("double").alias("grade"),
    )


def card_key(parsed: Column, grade: bool) -> Column:
    """Identity of a card, with its grade for the ladder key's counterpart; null if a part is unknown."""
    parts = [parsed["year"].cast("string"), F.lower(parsed["set"]), F.upper(parsed["number"]), *([parsed["grader"], parsed["grade"].cast("string")] if grade else [])]
    return F.when(functools.reduce(Column.__and__, [p.isNotNull() for p in parts]), F.concat_ws("|", *parts))


def reference(c: Column) -> Column:
    """Reference number after "ref", vetted: it has a digit and is no year."""
    found = extracted(c, r"(?i)\bref(?:erence|\.)?\s*(?:no\.?\s*)?([A-Z0-9][A-Z0-9./-]{2,})")
    return F.when(found.rlike("[0-9]") & ~found.rlike("^(?:18|19|20)[0-9]{2}$"), F.upper(F.regexp_replace(found, r"[./-]+$", "")))


def serials(c: Column) -> Column:
    """array<string>: numbers after "case", "movement" or "serial no." (F15)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?:case|movement|serial)\s+(?:no\.?\s*)?([0-9][0-9.]{2,})"), F.lit(1))


def edition(c: Column) -> Column:
    """struct<number, size> of n/m that is no date, score or scale: 1 <= n <= m, nothing numeric beside it,
    no "scale" or "page" before (F16)."""
    found = F.regexp_extract(c, r"(?i)(?<![0-9/.])(?<!scale )(?<!page )([0-9]{1,4})\s?/\s?([0-9]{1,4})(?![0-9/])", 0)
    n, m = (F.regexp_extract(found, r"([0-9]+)\s?/\s?([0-9]+)", g).try_cast("int") for g in (1, 2))
    return F.when((n >= 1) & (n <= m), F.struct(n.alias("number"), m.alias("size")))


def edition_key(maker: Column, title: Column) -> Column:
    """Maker and the words of the title without edition numbers."""
    bare = F.regexp_replace(F.lower(title), r"(?:no\.?\s*)?[0-9]+\s?(?:/|of)\s?[0-9]+", " ")
    words = F.array_sort(F.filter(F.split(F.regexp_replace(bare, "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    return F.when(maker.isNotNull() & (F.size(words) > 0), F.concat_ws("|", maker.cast("string"), F.concat_ws(" ", words)))


def unglued(c: Column) -> Column:
    """Words run together by lost line breaks are parted: "silverVintage" (F18)."""
    return F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")


def unshouted(c: Column) -> Column:
    """A title in capitals only, of four letters at least, takes initial capitals."""
    return F.when((F.upper(c) == c) & (F.length(F.regexp_replace(c, "[^A-Z]", "")) >= 4), F.initcap(F.lower(c))).otherwise(c)


def estimate_range(c: Column) -> Column:
    """struct<low, high> of "$1,200 - 1,800" or "1.5k-2k"; one figure is both; crossed ends are swapped."""
    plain = F.regexp_replace(F.lower(c), "[,$£€ ]", "")
    found = F.regexp_extract_all(plain, F.lit(r"([0-9]+(?:\.[0-9]+)?k?)"), F.lit(1))
    value = lambda x: F.regexp_replace(x, "k$", "").cast("double") * F.when(x.endswith("k"), 1000).otherwise(1)
    ends = F.transform(F.slice(found, 1, 2), value)
    return F.when(F.size(ends) > 0, F.struct(F.array_min(ends).alias("low"), F.array_max(ends).alias("high")))


def over_estimate(hammer: Column, low: Column, high: Column) -> Column:
    """Whole percent over the high estimate, or under the low one, on the hammer's basis; 0 between."""
    pct = lambda x: F.floor((hammer / x - 1) * 100 + 0.5)
    return F.when(hammer > high, pct(high)).when(hammer < low, pct(low)).when(hammer.isNotNull() & F.coalesce(high, low).isNotNull(), F.lit(0).cast("long"))


def money(c: Column) -> Column:
    """Short money text: $950, $12.3k, $4.5m."""
    short = lambda x, unit: F.concat(F.lit("$"), F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))
    return F.when(c >= 999_950, short(c / 1e6, "m")).when(c >= 999.5, short(c / 1e3, "k")).when(c.isNotNull(), F.concat(F.lit("$"), F.floor(c + 0.5).cast("string")))


def dimensions(c: Column) -> Column:
    """array<double> in centimetres of "12 1/2 x 8 in", "30 x 20 cm" or "300 × 200 mm", largest first."""
    number = r"[0-9]+(?:\.[0-9]+)?(?:\s+[0-9]+/[0-9]+)?"
    run = extracted(F.lower(c), rf"({number}(?:\s*[x×]\s*{number}){{0,2}})\s*(?:in\b|inches|cm\b|mm\b|\")")
    unit = extracted(F.lower(c), rf"{number}(?:\s*[x×]\s*{number}){{0,2}}\s*(in\b|inches|cm\b|mm\b|\")")
    factor = F.when(unit == "cm", 1.0).when(unit == "mm", 0.1).otherwise(2.54)

    def value(x: Column) -> Column:
        whole = F.regexp_extract(x, r"^([0-9.]+)", 1).cast("double")
        top, bottom = (F.regexp_extract(x, r"\s([0-9]+)/([0-9]+)$", g).try_cast("double") for g in (1, 2))
        return F.round((whole + F.coalesce(top / bottom, F.lit(0.0))) * factor, 3)

    return F.when(run.isNotNull(), F.sort_array(F.transform(F.split(run, r"\s*[x×]\s*"), value), asc=False))


def size_class(cm: Column, limits: list[tuple[float, str]], beyond: str) -> Column:
    """Name of the first limit that the largest dimension stays under."""
    out = F.lit(beyond)
    for limit, name in reversed(limits):
        out = F.when(cm[0] < limit, name).otherwise(out)
    return F.when(cm.isNotNull(), out)


def local_day(instant: Column, house: Column, zones: dict, default: str = "UTC") -> Column:
    """Day of a sale where its house is (D2); ``zones``: house to time zone."""
    return F.to_date(F.from_utc_timestamp(instant, _case(house, zones, F.lit(default))))


def day_end(day: Column, house: Column, zones: dict, default: str = "UTC") -> Column:
    """Instant at which a day ends where the house is."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), _case(house, zones, F.lit(default)))


def live_until(close: Column, kind: Column, slack_minutes: dict[str, int], default: int) -> Column:
    """Close plus the slack of its kind of sale (D3)."""
    return F.timestamp_seconds(F.unix_timestamp(close) + 60 * _case(kind, slack_minutes, F.lit(default)))


def named_date(c: Column) -> Column:
    """Date of "12 March 1998" or "March 12, 1998"; a month alone gives its last day, a season the last
    day of its third month (D5)."""
    text, names = F.lower(c), "|".join(MONTHS)
    month = _case(extracted(text, rf"\b({names})\b"), {m: i for i, m in enumerate(MONTHS, 1)})
    season = _case(extracted(text, r"\b(spring|summer|autumn|fall|winter)\b"), {"spring": 5, "summer": 8, "autumn": 11, "fall": 11, "winter": 2})
    year = extracted(text, r"\b((?:18|19|20)[0-9]{2})\b").cast("int")
    day = F.coalesce(extracted(text, rf"\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+(?:{names})\b"), extracted(text, rf"\b(?:{names})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?\b(?!\d)")).cast("int")
    first = F.make_date(year, F.coalesce(month, season), F.lit(1))
    return F.when(month.isNotNull() & day.isNotNull(), F.date_add(first, day - 1)).otherwise(F.last_day(first))


def encoded_filters(fields: dict[str, Column]) -> Column:
    """URL query of the fields that are set."""
    return F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in fields.items()])), "&")


def decoded_filters(c: Column) -> Column:
    """map<string, string> of a URL query."""
    pairs = F.transform(F.filter(F.split(c, "&"), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.url_decode(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    return F.map_from_entries(pairs)


def dictionary_decoded(codes: Column, dictionary: Column) -> Column:
    """Values of a dictionary-coded column; code -1 is null."""
    return F.transform(codes, lambda i: F.when(i >= 0, F.get(dictionary, i)))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution by Acklam's public rational approximation."""
    a = [-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2, 1.383577518672690e2, -3.066479806614716e1, 2.506628277459239]
    b = [-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2, 6.680131188771972e1, -1.328068155288572e1, 1.0]
    c = [-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
    d = [7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416, 1.0]
    poly = lambda w, x: functools.reduce(lambda s, k: s * x + F.lit(k), w, F.lit(0.0))
    low, q = F.least(p, 1 - p), p - 0.5
    t = F.sqrt(-2 * F.ln(low))
    tail = poly(c, t) / poly(d, t)
    centre = poly(a, q * q) * q / poly(b, q * q)
    return F.when((p <= 0) | (p >= 1), None).when(low >= 0.02425, centre).when(p < 0.5, tail).otherwise(-tail)
