"""Feed predicates, exclusion stamps and comparability gates (§2.2, J4, J5, J16, J18, J19)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def all_of(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__and__, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(Column.__or__, conditions, F.lit(False))


def served_live(status: str, day: str, today: Column, grace_days: int) -> Column:
    """Upcoming lots from today on, and those whose result is still awaited."""
    return (F.col(status) == "upcoming") & (F.col(day) >= F.date_sub(today, grace_days))


def triage(window: Column | None = None, equal: dict[str, list] | None = None, facets: tuple[str, list[list[str]]] | None = None, anchor: Column | None = None, low: float | None = None, high: float | None = None, new: Column | None = None) -> Column:
    """One predicate of the given parts: a time window, any-of sets by column, facet groups, bounds on the
    anchor price and the new flag (P3). A null attribute fails the part that asks for it."""
    parts = [c for c in (window, new) if c is not None]
    parts += [F.col(c).isin(v) for c, v in (equal or {}).items()]
    if facets:
        held, groups = facets
        parts += [F.arrays_overlap(F.col(held), F.array(*[F.lit(v) for v in g])) for g in groups]
    if low is not None:
        parts.append(anchor >= low)
    if high is not None:
        parts.append(anchor <= high)
    return F.coalesce(all_of(parts), F.lit(False))


def new_since(df: DataFrame, house: str, first_seen: str, since: Column, onboarding_days: int) -> DataFrame:
    """``df`` with is_new: seen since then, unless its house was itself being taken up (P5)."""
    start = df.groupBy(house).agg(F.min(first_seen).alias("_start"))
    return df.join(start, house).withColumn("is_new", (F.col(first_seen) >= since) & (F.datediff(first_seen, "_start") > onboarding_days)).drop("_start")


def text_query_matches(lots: DataFrame, queries: DataFrame, text: Column, known_keys: list[str]) -> DataFrame:
    """(query_id, lot_id): every word of the query's text occurs, its category agrees; a query with a key
    that is not known matches nothing (P7). ``queries``: query_id, category, words, keys; one row a saved query."""
    sound = queries.where(F.size(F.array_except("keys", F.array(*[F.lit(k) for k in known_keys]))) == 0)
    tokens = lots.withColumn("_t", F.split(F.lower(text), "[^a-z0-9#]+"))
    on = (sound.category.isNull() | (sound.category == tokens.category)) & (F.size(F.array_except(sound.words, F.col("_t"))) == 0)
    return tokens.join(sound, on).select("query_id", "lot_id")


def stamp(df: DataFrame, rules: list[tuple[Column, str]], name: str) -> DataFrame:
    """``df`` with the first reason that holds, or null."""
    return df.withColumn(name, F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules]))


class InvariantError(ValueError):
    """A fatal rule has violations."""


def assert_invariants(df: DataFrame, fatal: dict[str, Column], warn: dict[str, Column], most: float) -> dict[str, int]:
    """Counts of every rule in one pass; raises if a fatal rule is broken at all, or a warning by more
    than ``most`` of the rows (P10)."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(n) for n, c in (fatal | warn).items()]).first().asDict()
    n = counts.pop("_n")
    broken = [k for k in fatal if counts[k]] + [k for k in warn if counts[k] > most * n]
    if broken:
        raise InvariantError(", ".join(f"{k}: {counts[k]} of {n}" for k in broken))
    return counts


def fits_market(market: str, form: str, forms: dict[str, list[str]]) -> Column:
    """Whether a form belongs in a market; markets without a list take all."""
    out = F.lit(True)
    for m, held in forms.items():
        out = F.when(F.col(market) == m, F.col(form).isin(held)).otherwise(out)
    return out


def is_open(close: Column, now: Column) -> Column:
    return close > now


def closes_within(close: Column, now: Column, hours: float) -> Column:
    """Open and closing within so many hours."""
    left = F.unix_timestamp(close) - F.unix_timestamp(now)
    return (left > 0) & (left <= hours * 3600)


def differ(a: Column, b: Column) -> Column:
    """A conflict: both known and unlike; an unknown side never conflicts."""
    return F.coalesce(a != b, F.lit(False))


def apart(a: Column, b: Column, most: float) -> Column:
    """Known sizes whose ratio exceeds ``most``."""
    return F.coalesce((a > 0) & (b > 0) & (F.greatest(a, b) / F.least(a, b) > most), F.lit(False))


def gap(a: Column, b: Column, most: float) -> Column:
    return F.coalesce(F.abs(a - b) > most, F.lit(False))


def gated_pairs(targets: DataFrame, comps: DataFrame, keys: list[str], conflicts: list[tuple[str, str, float | None]], extra: list[Column] = ()) -> DataFrame:
    """Pairs of equal keys with ``conflict``, the first rule that parts them or null.

    Rules: (kind, column, limit) of kind differ, apart or gap; attributes are compared as t.<column> and
    c.<column>. The join is by equality of the keys, so Spark shuffles once a side and gates in the join."""
    t, c = targets.alias("t"), comps.alias("c")
    kinds = {"differ": lambda x, y, _: differ(x, y), "apart": apart, "gap": gap}
    reasons = [F.when(kinds[k](F.col(f"t.{col}"), F.col(f"c.{col}"), limit), F.lit(f"{k}:{col}")) for k, col, limit in conflicts]
    on = all_of([F.col(f"t.{k}") == F.col(f"c.{k}") for k in keys] + list(extra))
    return t.join(c, on).withColumn("conflict", F.coalesce(*reasons) if reasons else F.lit(None))


def collisions(df: DataFrame, key: str, house: str, id_col: str) -> DataFrame:
    """Live rows whose key is live at another house, with the number of other houses."""
    houses = df.groupBy(key).agg((F.countDistinct(house) - 1).alias("n_elsewhere")).where("n_elsewhere > 0")
    return df.join(houses, key).select(id_col, key, house, "n_elsewhere")


def partition_keys(parts: dict[str, list[str]]) -> Column:
    """array<string>: one key a partition kind whose columns are all known."""
    keys = [F.when(all_of([F.col(c).isNotNull() for c in cols]), F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in cols])) for kind, cols in parts.items()]
    return F.array_compact(F.array(*keys))


def superset_pairs(targets: DataFrame, comps: DataFrame, parts: dict[str, list[str]], id_col: str) -> DataFrame:
    """Distinct (target, comp) that share a partition: every later gate sees a superset of its pairs."""
    a = targets.select(F.col(id_col).alias("target"), F.explode(partition_keys(parts)).alias("_k"))
    b = comps.select(F.col(id_col).alias("comp"), F.explode(partition_keys(parts)).alias("_k"))
    return a.join(b, "_k").where("target <> comp").select("target", "comp").distinct()


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Union by name; of rows of one key that of the first source stays."""
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])
    return every.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("source_rank", *[c for c in every.columns if c not in (key, "source_rank")]))).where("_n = 1").drop("_n")
