"""Valuation in stages with abstain reasons, and what is read off it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .aggregates import capped, half_reached


@dataclass(frozen=True)
class Rules:
    """Thresholds of one valuation; none has a default, they belong to the market that is valued."""

    least: int  # comps a pool needs
    top: int  # comps used, newest first
    half_life_days: float
    share: float  # largest weight of one comp
    carry: tuple[float, float]  # limits of the time factor
    spread: float  # widest interquartile range over the median
    scale: float  # largest factor between value and estimate
    weights: dict[str, float]  # blend weight by confidence
    signal: float  # distance from 1 of a ratio that is told
    margin: float  # part of the value a bid may reach


def level_calendar(levels: DataFrame, keys: list[str], q: str, value: str, last: int) -> DataFrame:
    """Level at every quarter up to ``last``: the quarter's own or the last one before."""
    ends = levels.groupBy(*keys).agg(F.min(q).alias("_a"))
    calendar = ends.select(*keys, F.explode(F.sequence(F.col("_a"), F.lit(last))).alias(q))
    order = W.partitionBy(*keys).orderBy(q).rowsBetween(W.unboundedPreceding, 0)
    return calendar.join(levels, [*keys, q], "left").withColumn(value, F.last(value, ignorenulls=True).over(order))


def carry_factor(now: Column, then: Column, limits: tuple[float, float]) -> Column:
    return F.coalesce(F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), now / then)), F.lit(1.0))


def prior_pairs(targets: DataFrame, sold: DataFrame, key: str, band: str) -> DataFrame:
    """Pairs of a target and a sale of its key known before its day, with ``strict`` where the band agrees."""
    t = targets.select(key, *[F.col(c).alias(f"t_{c}") for c in targets.columns if c != key])
    c = sold.select(key, *[F.col(c).alias(f"c_{c}") for c in sold.columns if c != key])
    return t.join(c, key).where(F.col("c_day") < F.col("t_day")).withColumn("strict", F.col(f"c_{band}") == F.col(f"t_{band}"))


def value_lots(targets: DataFrame, sold: DataFrame, levels: DataFrame, key: str, band: str, market: str, rules: Rules, premium: list[tuple[float, float]]) -> DataFrame:
    """One row a target: value or reason, n, path, confidence, blend, band, signal, hammer and max bid.

    Targets and sales need lot_id, ``key``, ``band``, ``market``, day, q, price and est_mid; ``levels`` is
    (market, q, level). The pools of a target are never mixed: the strict one if it is large enough, else
    all of the key. Every stage is a set of columns; a target without a value keeps its reason."""
    pairs = prior_pairs(targets.select("lot_id", key, band, market, "day", "q", "est_mid"), sold.select("lot_id", key, band, "day", "q", "price"), key, band)
    whole = W.partitionBy("t_lot_id")
    pairs = pairs.withColumn("_s", F.count_if("strict").over(whole))
    pool = pairs.where(F.col("strict") | (F.col("_s") < rules.least)).withColumn("path", F.when(F.col("_s") >= rules.least, "strict").otherwise("wide"))
    pool = pool.withColumn("_n", F.row_number().over(W.partitionBy("t_lot_id").orderBy(F.desc("c_day"), "c_lot_id"))).where(F.col("_n") <= rules.top)
    level = levels.select(F.col(market).alias(f"t_{market}"), F.col("q").alias("_q"), "level")
    pool = pool.withColumn("_tq", F.col("t_q") - 1).withColumn("_cq", F.least("c_q", F.col("t_q") - 1))
    for at, name in (("_tq", "_now"), ("_cq", "_then")):  # one row a market and quarter: Spark broadcasts it if small
        pool = pool.join(level.withColumnRenamed("_q", at).withColumnRenamed("level", name), [f"t_{market}", at], "left")
    pool = pool.withColumn("carried", F.col("c_price") * carry_factor(F.col("_now"), F.col("_then"), rules.carry)).withColumn("w", F.round(S.half_life(F.datediff("t_day", "c_day"), rules.half_life_days), 9))
    # all windows and the aggregate are by target: one shuffle
    pool = capped(pool, ["t_lot_id"], "w", "c_lot_id", rules.share, "cw")
    for name in ("c_price", "carried"):
        pool = pool.withColumn(f"_{name}", F.when(half_reached(["t_lot_id"], name, "cw", "c_lot_id"), F.col(name)))
    read = pool.groupBy("t_lot_id", "path").agg(F.min("_c_price").alias("raw"), F.min("_carried").alias("value"), F.count("*").alias("n"), ((F.percentile("c_price", F.lit(0.75)) - F.percentile("c_price", F.lit(0.25))) / F.median("c_price")).alias("spread"), F.percentile("carried", F.lit(0.15)).alias("low"), F.percentile("carried", F.lit(0.85)).alias("high"))
    out = targets.join(read, targets.lot_id == read.t_lot_id, "left")
    ratio = F.col("value") / F.col("est_mid")
    reason = F.when(F.col("n").isNull(), "none").when(F.col("n") < rules.least, "thin").when(F.col("spread") > rules.spread, "dispersed").when((ratio > rules.scale) | (ratio < 1 / rules.scale), "scale")
    confidence = F.when((F.col("n") >= 2 * rules.least) & (F.col("spread") <= rules.spread / 2), "high").when(F.col("path") == "strict", "medium").otherwise("low")
    out = out.withColumn("reason", reason).withColumn("confidence", F.when(F.col("reason").isNull(), confidence))
    weight = F.coalesce(*[F.when(F.col("confidence") == k, F.lit(v)) for k, v in rules.weights.items()])
    out = out.withColumn("blend", F.when(F.col("reason").isNull(), blend(F.col("est_mid"), F.col("value"), weight)))
    known = F.col("reason").isNull()
    return out.select(
        "lot_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "path",
        "reason",
        "confidence",
        *[F.when(known, F.col(c)).alias(c) for c in ("raw", "value", "low", "high", "blend")],
        signal(F.col("blend") / F.col("est_mid"), rules.signal).alias("signal"),
        S.marginal_inverse(F.col("blend"), premium).alias("hammer"),
        S.marginal_inverse(F.col("blend") * rules.margin, premium).alias("max_bid"),
    )


def blend(mid: Column, value: Column, weight: Column, house: Column | None = None) -> Column:
    """Estimate and value joined in logarithms; ``house`` is the estimate's known log bias."""
    return mid * F.exp((1 - weight) * (house if house is not None else F.lit(0.0)) + weight * F.ln(value / mid))


def signal(ratio: Column, distance: float) -> Column:
    return F.when(ratio > 1 + distance, "above").when(ratio < 1 - distance, "below").when(ratio.isNotNull(), "fair")


def bid_read(bid: Column, value: Column, width: float) -> Column:
    """All-in bid against the value."""
    return F.when(bid > value * (1 + width), "over").when(bid < value * (1 - width), "under").when(bid.isNotNull() & value.isNotNull(), "at")


def floor_at_bid(value: Column, bid: Column) -> Column:
    """A value never stands below the live bid."""
    return F.greatest(value, F.coalesce(bid, value))


def newest_band(df: DataFrame, keys: list[str], day: str, value: str, tie: str, least: int, newest: int, since: Column, spread: float, ends: tuple[float, float]) -> DataFrame:
    """Descriptive band of a pool (M20): its rows since ``since`` if they suffice, else all; the newest of
    them; abstains if few or if the interquartile range over the median exceeds ``spread``."""
    whole = W.partitionBy(*keys)
    rows = df.withColumn("_recent", F.count_if(F.col(day) >= since).over(whole)).where((F.col("_recent") < least) | (F.col(day) >= since))
    rows = rows.withColumn("_n", F.row_number().over(whole.orderBy(F.desc(day), tie))).where(F.col("_n") <= newest)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(value, F.lit(ends[0])).alias("low"), F.median(value).alias("mid"), F.percentile(value, F.lit(ends[1])).alias("high"), ((F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))) / F.median(value)).alias("_s"))
    return out.where((F.col("n") >= least) & (F.col("_s") <= spread)).drop("_s")


def knee(x: Column, at: float) -> Column:
    """x up to the knee, a square root from there on, without a step in level or slope."""
    return F.when(x <= at, x).otherwise(F.sqrt(at * (2 * x - at)))


def on_ladder(price: Column, start: float, step: float) -> Column:
    """Whether a price is a rung of a geometric ladder, each rung rounded to the unit."""
    k = F.round(F.ln(price / start) / F.ln(F.lit(1 + step)))
    return F.coalesce((price >= start) & (F.round(start * F.pow(F.lit(1 + step), k)) == price), F.lit(False))


def dated(value: Column, day: Column, eras: list[tuple[str, list[tuple[float, float]]]], inverse: bool = False) -> Column:
    """Premium of the era a day falls in: (first day, bands) in ascending order; before the first, its own."""
    f = S.marginal_inverse if inverse else S.marginal
    out = f(value, eras[0][1])
    for first, bands in eras[1:]:
        out = F.when(day >= F.lit(first).cast("date"), f(value, bands)).otherwise(out)
    return out


def rates_before(df: DataFrame, keys: list[str], q: str, hit: str, k: float) -> DataFrame:
    """(keys, q, n, rate): hits of all quarters before q, shrunk to the rate over all keys before q; what a
    replay may know at a quarter boundary (M35)."""
    cells = df.groupBy(*keys, q).agg(F.count("*").alias("_c"), F.sum(hit).alias("_h"))
    every = cells.groupBy(q).agg(F.sum("_c").alias("_c"), F.sum("_h").alias("_h"))
    total = W.orderBy(q).rowsBetween(W.unboundedPreceding, -1)  # one row a quarter
    parent = every.select(q, (F.sum("_h").over(total) / F.sum("_c").over(total)).alias("_p"))
    own = W.partitionBy(*keys).orderBy(q).rowsBetween(W.unboundedPreceding, -1)
    before = cells.select(*keys, q, F.sum("_c").over(own).alias("n"), F.sum("_h").over(own).alias("_x"))
    return before.join(F.broadcast(parent), q).where("n > 0").select(*keys, q, "n", ((F.col("_x") + k * F.col("_p")) / (F.col("n") + k)).alias("rate"))


def tape(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, first value, last changed value and number of changes (M38): the first serve of a key stands, of
    later ones the last that changed the value."""
    by = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_was", F.lag(value).over(by)).withColumn("_n", F.row_number().over(by))
    changed = (F.col("_n") == 1) | (F.col(value) != F.col("_was"))
    return rows.where(changed).groupBy(*keys).agg(F.min_by(value, "_n").alias("first"), F.max_by(value, "_n").alias("last_changed"), (F.count("*") - 1).alias("changes"))


def drift(df: DataFrame, keys: list[str], age: str, error: str, recent: int, base: int, least: int, factor: float) -> DataFrame:
    """Median error of the last ``recent`` days against the ``base`` days before; alert if it grew by ``factor``."""
    now, then = F.col(age) < recent, (F.col(age) >= recent) & (F.col(age) < recent + base)
    out = df.where(F.col(age) >= 0).groupBy(*keys).agg(F.count_if(now).alias("n_now"), F.count_if(then).alias("n_then"), F.median(F.when(now, F.col(error))).alias("error_now"), F.median(F.when(then, F.col(error))).alias("error_then"))
    return out.withColumn("alert", F.coalesce((F.col("n_now") >= least) & (F.col("n_then") >= least) & (F.col("error_now") > factor * F.col("error_then")), F.lit(False)))


def compared(df: DataFrame, keys: list[str], actual: str, one: str, other: str) -> DataFrame:
    """Two engines on the rows both value: n, median errors, and how often the first is nearer."""
    a, b = F.abs(F.ln(F.col(one) / F.col(actual))), F.abs(F.ln(F.col(other) / F.col(actual)))
    rows = df.where(F.col(one).isNotNull() & F.col(other).isNotNull()).withColumn("_a", a).withColumn("_b", b)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.median("_a").alias("error_one"), F.median("_b").alias("error_other"), F.avg((F.col("_a") < F.col("_b")).cast("double")).alias("nearer"))


def leave_one_out(df: DataFrame, keys: list[str], value: str, tie: str, name: str, least: int) -> DataFrame:
    """``df`` with the median of the other rows of its group (M53), null below ``least`` of them.

    Taken from ranks: without the row of rank r the middle ranks of the rest move by one at most."""
    by, whole = W.partitionBy(*keys).orderBy(value, tie), W.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(by)).withColumn("_n", F.count("*").over(whole))
    middle = rows.where((F.col("_r") >= F.floor(F.col("_n") / 2)) & (F.col("_r") <= F.floor(F.col("_n") / 2) + 2)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", value))).alias("_m"))  # three rows a group
    at = lambda k: F.col("_m")[(k + F.when(F.col("_r") <= k, 1).otherwise(0)).cast("int")]
    m = F.col("_n") - 1
    other = (at(F.floor((m + 1) / 2)) + at(F.floor(m / 2) + 1)) / 2
    return rows.join(middle, keys, "left").withColumn(name, F.when(m >= least, other)).drop("_r", "_n", "_m")


def cells_moved(before: DataFrame, now: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Cells that came, went or moved by at least ``share``."""
    a, b = before.select(*keys, F.col(value).alias("was")), now.select(*keys, F.col(value).alias("is_now"))
    out = a.join(b, keys, "full_outer").withColumn("change", F.col("is_now") / F.col("was") - 1)
    return out.where(F.col("was").isNull() | F.col("is_now").isNull() | (F.abs("change") >= share))
