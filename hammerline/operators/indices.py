"""Intervals and publication of price indices: clustered covariance, house effects, horizons (M1, M2, M5, M6)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Fit:
    """Levels in logarithms by period (0 at the first), their covariance, effects of houses, and counts."""

    periods: list[int]
    levels: np.ndarray
    covariance: np.ndarray
    houses: dict = field(default_factory=dict)
    pairs: int = 0
    objects: int = 0

    def error(self, start: int, end: int) -> float:
        """Standard error of the move between two periods."""
        a, b = self.periods.index(start), self.periods.index(end)
        v = self.covariance[b, b] + self.covariance[a, a] - 2 * self.covariance[a, b]
        return float(np.sqrt(max(v, 0.0)))


def sale_pairs(df: DataFrame, key: str, day: str, value: str, tie: str, house: str, q: str, most: float) -> DataFrame:
    """(key, q0, q1, h0, h1, ratio) of consecutive sales in unlike periods; extreme ratios dropped."""
    order = W.partitionBy(key).orderBy(day, tie)
    rows = df.select(F.col(key).alias("key"), F.col(q).alias("q1"), F.col(house).alias("h1"), F.lag(q).over(order).alias("q0"), F.lag(house).over(order).alias("h0"), F.ln(F.col(value) / F.lag(value).over(order)).alias("ratio"))
    return rows.where((F.col("q0") < F.col("q1")) & (F.abs("ratio") <= most))


def repeat_sales_fit(pairs: DataFrame, least_ends: int, huber: float, floor: float, least_pairs: int, least_objects: int) -> Fit | None:
    """Bailey-Muth-Nourse with house effects in three stages and a key-clustered sandwich covariance.

    Houses with ``least_ends`` ends of cross-house pairs get an effect; the busiest is the reference. Spark
    reduces the pairs to cells (q0, q1, h0, h1) for the normal equations, and the scores of the keys to
    one matrix of periods and houses: the driver holds numbers for these only. None under the floors."""
    counts = pairs.agg(F.count("*").alias("n"), F.countDistinct("key").alias("k")).first()
    if counts["n"] < least_pairs or counts["k"] < least_objects:
        return None
    ends = pairs.where("h0 <> h1").select(F.explode(F.array("h0", "h1")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).collect()  # one row a house
    busy = sorted(((-r["n"], r["h"]) for r in ends if r["n"] >= least_ends))
    houses = [h for _, h in busy[1:]]
    periods = sorted({x for r in pairs.groupBy("q0", "q1").count().collect() for x in (r["q0"], r["q1"])})  # pairs of periods
    place = {q: i - 1 for i, q in enumerate(periods)}  # the first period is the base
    at = {h: len(periods) - 1 + i for i, h in enumerate(houses)}
    p = len(periods) - 1 + len(houses)
    spark = pairs.sparkSession
    slots = spark.createDataFrame([(q, i) for q, i in place.items()], f"q {pairs.schema['q0'].dataType.simpleString()}, s int")
    sides = spark.createDataFrame([(h, i) for h, i in at.items()] or [(None, -1)], f"h {pairs.schema['h0'].dataType.simpleString()}, s int")
    rows = pairs
    for c in ("q0", "q1"):
        rows = rows.join(F.broadcast(slots.select(F.col("q").alias(c), F.col("s").alias(f"s_{c}"))), c)  # one row a period
    for c in ("h0", "h1"):
        rows = rows.join(F.broadcast(sides.select(F.col("h").alias(c), F.col("s").alias(f"s_{c}"))), c, "left")  # one row a house
    none = F.lit(-1)
    rows = rows.select("key", "ratio", (F.col("q1") - F.col("q0")).cast("double").alias("gap"), *[F.coalesce(f"s_{c}", none).alias(c) for c in ("q0", "q1", "h0", "h1")])
    beta, spread, weight = np.zeros(p), F.lit(1.0), F.lit(1.0)

    def residual(b: np.ndarray) -> Column:
        level = F.array(*[F.lit(float(x)) for x in [0.0, *b]])
        own = lambda c: F.get(level, F.col(c) + 1)
        return F.col("ratio") - (own("q1") - own("q0")) - (own("h1") - own("h0"))

    for stage in range(3):
        e = residual(beta)
        if stage == 1:
            fit = rows.withColumn("e2", e * e).agg(F.regr_slope("e2", "gap").alias("b"), F.regr_intercept("e2", "gap").alias("a")).first()
            spread = F.greatest(F.lit(float(fit["a"] or 0.0)) + F.lit(float(fit["b"] or 0.0)) * F.col("gap"), F.lit(floor))
            weight = 1 / spread
        if stage == 2:
            weight = 1 / spread * F.least(F.lit(1.0), F.lit(huber) / F.greatest(F.abs(e) / F.sqrt(spread), F.lit(1e-9)))
        cells = rows.withColumn("w", weight).groupBy("q0", "q1", "h0", "h1").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("ratio")).alias("wr")).collect()  # periods and houses
        a, b = np.zeros((p, p)), np.zeros(p)
        for r in cells:
            v = np.zeros(p + 1)  # the last place takes what is the base
            v[r["q1"]] += 1
            v[r["q0"]] -= 1
            v[r["h1"]] += 1
            v[r["h0"]] -= 1
            v = v[:-1]
            nz = np.flatnonzero(v)
            a[np.ix_(nz, nz)] += r["w"] * np.outer(v[nz], v[nz])
            b[nz] += r["wr"] * v[nz]
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
    score = rows.withColumn("s", weight * residual(beta))
    moves = F.array(*[F.struct(F.col(c).alias("i"), F.lit(sign).alias("g")) for c, sign in (("q1", 1.0), ("q0", -1.0), ("h1", 1.0), ("h0", -1.0))])
    by_key = score.select("key", "s", F.explode(moves).alias("m")).where("m.i >= 0").groupBy("key", F.col("m.i").alias("i")).agg(F.sum(F.col("s") * F.col("m.g")).alias("u"))
    meat = np.zeros((p, p))
    for r in by_key.alias("x").join(by_key.alias("y"), "key").groupBy(F.col("x.i").alias("i"), F.col("y.i").alias("j")).agg(F.sum(F.col("x.u") * F.col("y.u")).alias("u")).collect():  # periods and houses
        meat[r["i"], r["j"]] += r["u"]
    g = counts["k"]
    sandwich = inverse @ meat @ inverse * g / max(g - 1, 1)
    n = len(periods)
    covariance = np.zeros((n, n))
    covariance[1:, 1:] = sandwich[: n - 1, : n - 1]
    return Fit(periods, np.concatenate(([0.0], beta[: n - 1])), covariance, {h: float(beta[i]) for h, i in at.items()}, counts["n"], g)


def clustered_errors(df: DataFrame, value: str, period: str, cluster: str) -> Fit:
    """Mean log level of each period with the sale-clustered CR1 covariance (M2): sales of one cluster share
    a shock, so their residuals are summed before they are squared."""
    rows = df.select(F.ln(value).alias("y"), F.col(period).alias("q"), F.col(cluster).alias("c"))
    cells = rows.groupBy("q").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    found = sorted((r["q"], r["m"], r["n"]) for r in cells.collect())  # one row a period
    periods = [q for q, _, _ in found]
    place = {q: i for i, q in enumerate(periods)}
    scores = rows.join(F.broadcast(cells), "q").groupBy("c", "q").agg((F.sum(F.col("y") - F.col("m")) / F.max("n")).alias("u"))
    n, groups = sum(k for _, _, k in found), rows.select("c").distinct().count()
    k, meat = len(periods), np.zeros((len(periods),) * 2)
    for r in scores.alias("x").join(scores.alias("z"), "c").groupBy(F.col("x.q").alias("i"), F.col("z.q").alias("j")).agg(F.sum(F.col("x.u") * F.col("z.u")).alias("u")).collect():  # pairs of periods
        meat[place[r["i"]], place[r["j"]]] = r["u"]
    scale = groups / max(groups - 1, 1) * (n - 1) / max(n - k, 1)
    levels = np.asarray([m for _, m, _ in found])
    return Fit(periods, levels - (levels[0] if k else 0), meat * scale, pairs=n, objects=groups)


@dataclass(frozen=True)
class Publication:
    """Floors and ceilings of a horizon; all belong to the caller."""

    pairs: int
    objects: int
    widest: float  # half width of the 95 % interval in logarithms
    yearly: float  # largest implied growth a year, either way, in logarithms


def horizon(fit: Fit | None, end: int, years: int, rules: Publication, per_year: int = 4) -> dict:
    """Move over so many years up to ``end`` with its interval, or the reason it is withheld (M6).

    A horizon of several years also needs each of its one-year windows to pass, but for their sign."""
    out = {"years": years, "end": end, "move": None, "low": None, "high": None, "reason": None}

    def window(start: int, stop: int, whole: bool) -> str | None:
        if start not in fit.periods or stop not in fit.periods:
            return "no-endpoint"
        move = fit.levels[fit.periods.index(stop)] - fit.levels[fit.periods.index(start)]
        half = 1.96 * fit.error(start, stop)
        if abs(move) > rules.yearly * (stop - start) / per_year:
            return "implausible"
        if half > rules.widest:
            return "wide"
        return "sign" if whole and abs(move) < half else None

    if fit is None or fit.pairs < rules.pairs or fit.objects < rules.objects:
        return out | {"reason": "few"}
    start = end - years * per_year
    reason = window(start, end, True)
    if reason is None and years > 1:
        reason = next((f"year:{x}" for y in range(years) if (x := window(start + y * per_year, start + (y + 1) * per_year, False))), None)
    if reason:
        return out | {"reason": reason}
    move = fit.levels[fit.periods.index(end)] - fit.levels[fit.periods.index(start)]
    half = 1.96 * fit.error(start, end)
    return out | {"move": float(np.expm1(move)), "low": float(np.expm1(move - half)), "high": float(np.expm1(move + half))}


def end_sensitivity(fit: Fit, ends: list[int], years: int, per_year: int = 4) -> float | None:
    """Largest difference between the moves read at several ends (M6)."""
    moves = [fit.levels[fit.periods.index(e)] - fit.levels[fit.periods.index(e - years * per_year)] for e in ends if e in fit.periods and e - years * per_year in fit.periods]
    return float(max(moves) - min(moves)) if len(moves) > 1 else None
