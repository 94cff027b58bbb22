"""Quality rules with risk-controlled thresholds, in DataFrame expressions throughout.

Fixed base rules reject first. The method then adds, for every stratum, one cutoff a rule from a grid
laid down in advance: on labelled documents (the holdout; no cutoff is fitted on them beforehand) the
false rejections of good documents at each cutoff are counted, and the exact binomial probability of
so few at the allowed rate is compared with the error level, Bonferroni-corrected over strata and
rules and in fixed sequence from lenient to strict within a rule. Among certified cutoffs that which
rejects most bad documents is taken. The allowed rate is split over the rules, so the chance that
any stratum loses more than ``risk`` of its good documents to the method is at most ``error``.
Strata with too few labelled documents certify nothing and lose nothing.

Edge cases: null or empty text has 0 words and fails the base rule; a null stratum is one of its own
(``und``); null or absent labels and ids are not used; several label rows of an id count as good only
if all are; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

RISK, ERROR = 0.02, 0.05

#: Rules: value that rejects where it exceeds the cutoff, and cutoffs from lenient to strict.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.9, 0.7, 0.5, 0.35, 0.25, 0.18, 0.12, 0.08, 0.05, 0.03]),
    "capitals": ("n_capitals / greatest(word_chars, 1)", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
}

_BLANKS = r"[\\x20\\x09-\\x0D]+"


def repeat_words(words: str, width: int = 8) -> str:
    """SQL: words in windows of ``width`` that occur at least twice in the array column ``words``.

    Window hashes are sorted with their places; neighbours of equal hash give the repeated places,
    and the gaps between sorted places (at most a window each) add up to the words covered. One-element
    arrays bind intermediate values, so that nothing is computed again for each element.
    """
    hashes = f"transform(sequence(0, size({words}) - {width}), i -> xxhash64(slice({words}, i + 1, {width})))"
    placed = "sort_array(transform(h, (x, i) -> struct(x as h, i as i)))"
    twice = "filter(transform(s, (e, j) -> case when e.h = get(s, j - 1).h or e.h = get(s, j + 1).h then e.i end), e -> e is not null)"
    covered = f"aggregate(sort_array(get(transform(array({placed}), s -> {twice}), 0)), struct(0L as n, -{width} as last), (a, x) -> struct(a.n + least({width}, x - a.last) as n, x as last), a -> a.n)"
    return f"case when size({words}) < {width} then 0L else get(transform(array({hashes}), h -> case when size(array_distinct(h)) = size(h) then 0L else {covered} end), 0) end"


def features(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """id, stratum and the counts of every rule; one row a row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = rows.selectExpr("id", "stratum", "text", f"filter(split(text, '{_BLANKS}'), w -> w <> '') as words", r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]') as lines")
    return split.selectExpr(
        "id",
        "stratum",
        "cast(size(words) as bigint) as n_words",
        "cast(char_length(concat_ws('', words)) as bigint) as word_chars",
        "cast(regexp_count(text, '[#*$%&|<>]') as bigint) as n_symbols",
        r"cast(regexp_count(text, '\\p{Lu}') as bigint) as n_capitals",
        "cast(size(lines) as bigint) as n_lines",
        "cast(size(lines) - size(array_distinct(lines)) as bigint) as n_dup_lines",
        f"{repeat_words('words')} as n_repeat_words",
    )


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, rate), summed in logarithms term by term."""
    first = n.cast("double") * F.log(F.lit(1 - rate))
    odds = F.log(F.lit(rate / (1 - rate)))
    start = F.struct(first.alias("term"), F.exp(first).alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + odds
        return F.struct(term.alias("term"), (a["total"] + F.exp(term)).alias("total"))

    counts = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    # beyond the mean the tail is over one half: no level allows it, and no sum is needed
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.aggregate(counts, start, step, lambda a: F.least(a["total"], F.lit(1.0))))


def cutoffs(rows: DataFrame, labels: DataFrame, id_col: str, good_col: str, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff: the chosen cutoff of each stratum and rule that certifies one."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(good_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(good_col) > 0).alias("good"))
    judged = rows.join(known, "id")
    steps = [F.struct(F.lit(r).alias("rule"), F.expr(f"size(filter(array({', '.join(f'{c}D' for c in grid)}), c -> ({value}) > c))").alias("passed")) for r, (value, grid) in RULES.items()]
    tallied = judged.select("stratum", "good", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", F.col("s.rule").alias("rule"), F.col("s.passed").alias("passed")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    grid = [(r, i + 1, float(c)) for r, (_, cs) in RULES.items() for i, c in enumerate(cs)]
    table = rows.sparkSession.createDataFrame(grid, "rule string, step int, cutoff double")
    # at most strata * rules * steps rows from here on
    tallied = written(tallied, "rule-tallies")
    largest = tallied.where(F.col("rule") == next(iter(RULES))).groupBy("stratum").agg(F.sum("good").alias("n"))
    strata = max(1, largest.count())
    at = tallied.join(largest, "stratum").join(F.broadcast(table), "rule")  # the grid of rules, a constant
    counted = at.groupBy("stratum", "n", "rule", "step", "cutoff").agg(F.sum(F.when(F.col("passed") >= F.col("step"), F.col("good")).otherwise(0)).alias("wrong"), F.sum(F.when(F.col("passed") >= F.col("step"), F.col("bad")).otherwise(0)).alias("right"))
    level = error / (strata * len(RULES))
    tested = counted.withColumn("sure", binomial_tail(F.col("wrong"), F.col("n"), risk / len(RULES)) <= level)
    sequence = W.partitionBy("stratum", "rule").orderBy("step")
    certified = tested.withColumn("all", F.min("sure").over(sequence)).where("all and right > 0")
    best = W.partitionBy("stratum", "rule").orderBy(F.desc("right"), "step")
    return certified.withColumn("place", F.row_number().over(best)).where("place = 1").select("stratum", "rule", "cutoff")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Counts, base_failed, the rules that reject (array) and kept of every row."""
    rows = written(features(docs, id_col, text_col, stratum_col), "quality-features")
    chosen = written(cutoffs(rows, labels, id_col, good_col, risk, error), "cutoffs")
    by_stratum = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    rejects = F.array_compact(F.array(*[F.when(F.expr(value) > F.col(f"cut_{r}"), F.lit(r)) for r, (value, _) in RULES.items()]))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # one row a stratum, of a written table: broadcast only if Spark finds it small enough
    named = rows.join(by_stratum, "stratum", "left").withColumn("base_failed", base).withColumn("rejected_by", rejects)
    return named.select(F.col("id").alias(id_col), "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))
