"""Market reads over pools, cells and ledgers (§2.8, §2.11): factors, gates, ladders, lanes, outcomes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import capped_weights, weighted_median


def venue_factors(df: DataFrame, key: str, house: str, value: str, k: float, wide_from: int, limit: float, wide_limit: float) -> DataFrame:
    """house, n, factor: mean log deviation from the key's mean over keys seen at two houses or more,
    shrunk by ``k`` and clamped, wider where ``wide_from`` rows speak (M23)."""
    same = W.partitionBy(key)
    rows = df.withColumn("_l", F.ln(value)).withColumn("_two", F.min(house).over(same) != F.max(house).over(same)).withColumn("_d", F.col("_l") - F.avg("_l").over(same))
    sums = rows.where("_two").groupBy(house).agg(F.count("*").alias("n"), F.sum("_d").alias("_s"))
    room = F.when(F.col("n") >= wide_from, wide_limit).otherwise(limit)
    return sums.select(house, "n", F.greatest(1 - room, F.least(1 + room, F.exp(F.col("_s") / (F.col("n") + k)))).alias("factor"))


def roster_factors(df: DataFrame, group: str, member: str, value: str, least_rows: int, least_members: int) -> DataFrame:
    """Median of each member over the median of its group's member medians."""
    own = df.groupBy(group, member).agg(F.median(value).alias("own"), F.count("*").alias("n")).where(F.col("n") >= least_rows)
    whole = own.groupBy(group).agg(F.median("own").alias("_whole"), F.count("*").alias("_m")).where(F.col("_m") >= least_members)
    return own.join(whole, group).select(group, member, "n", (F.col("own") / F.col("_whole")).alias("factor"))


def purify_pools(df: DataFrame, key: str, material: str, markers: str, value: str, intrinsic: float, dominance: float, least: int) -> DataFrame:
    """Pools narrowed to one plain variant (M21): key, n, median, material, abstain.

    Markers on at least ``intrinsic`` of a pool belong to it, rows with another leave. A material of at
    least ``dominance`` of the stated ones keeps itself and the unstated; otherwise the cheapest
    stated material of two rows stays alone if it has ``least`` rows, or the pool abstains.
    """
    pools = df.groupBy(key).agg(F.count("*").alias("_pool"))
    seen = df.select(key, F.explode(markers).alias("_marker")).groupBy(key, "_marker").agg(F.count("*").alias("_m")).join(pools, key)
    odd = seen.where(F.col("_m") < intrinsic * F.col("_pool")).groupBy(key).agg(F.collect_set("_marker").alias("_odd"))  # markers are a vocabulary
    plain = df.join(odd, key, "left").where(~F.coalesce(F.arrays_overlap(markers, "_odd"), F.lit(False)))
    by_material = plain.groupBy(key, F.col(material).alias("_mat")).agg(F.count("*").alias("_n"), F.median(value).alias("_med"))
    stated = by_material.where("_mat is not null").groupBy(key).agg(F.sum("_n").alias("_known"), F.max("_n").alias("_top"), F.min_by("_mat", F.struct(-F.col("_n"), F.col("_mat"))).alias("_lead"), F.min(F.when(F.col("_n") >= 2, F.struct(F.col("_med").alias("med"), F.col("_mat").alias("mat"), F.col("_n").alias("n")))).alias("_cheap"))
    choice = stated.withColumn("_mixed", F.col("_top") < dominance * F.col("_known")).withColumn("_abstain", F.col("_mixed") & (F.coalesce(F.col("_cheap.n"), F.lit(0)) < least))
    choice = choice.select(key, "_mixed", "_abstain", F.when(F.col("_mixed"), F.col("_cheap.mat")).otherwise(F.col("_lead")).alias("_keep"))
    kept = plain.join(choice, key, "left").where(F.col("_keep").isNull() | (F.col(material) == F.col("_keep")) | F.col(material).isNull() & ~F.col("_mixed"))
    out = kept.groupBy(key).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.first("_keep").alias("material"), F.coalesce(F.first("_abstain"), F.lit(False)).alias("_a"))
    return out.select(key, F.when(F.col("_a"), 0).otherwise(F.col("n")).cast("long").alias("n"), F.when(~F.col("_a"), F.col("median")).alias("median"), F.when(~F.col("_a"), F.col("material")).alias("material"), F.when(F.col("_a"), F.lit("mixed")).alias("abstain"))


def tiered_prices(targets: DataFrame, sales: DataFrame, exact: list[str], grade: str, wide: list[str], value: str, step: int, least: tuple[int, int, int]) -> DataFrame:
    """``targets`` with price and tier: the exact pool, else the pool of grades one step away, else the
    wide pool (M22). Grades are exploded to the neighbours they serve, so that every join is by equality."""
    def pool(df: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.median(value).alias(name), F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n")

    near = sales.withColumn(grade, F.explode(F.array(F.col(grade) - step, F.col(grade) + step)))
    out = targets.join(pool(sales, [*exact, grade], least[0], "_exact"), [*exact, grade], "left").join(pool(near, [*exact, grade], least[1], "_near"), [*exact, grade], "left").join(pool(sales, wide, least[2], "_wide"), wide, "left")
    tier = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "grade").when(F.col("_wide").isNotNull(), "wide")
    return out.withColumn("price", F.coalesce("_exact", "_near", "_wide")).withColumn("tier", tier).drop("_exact", "_near", "_wide")


def grade_ladder(df: DataFrame, key: str, grade: str, value: str, grades: list[int], base: int, least_cell: int, least_pairs: int) -> dict[int, float | None]:
    """Multipliers of grades against the base, by least squares on the log ratios of all grade pairs of
    a key (M24); None for a grade with too few pairs, and for all if the ladder does not rise.

    The driver gets one row a pair of grades; a key's pairs are bounded by the list of grades."""
    cells = df.where(F.col(grade).isin(grades)).groupBy(key, grade).agg(F.ln(F.median(value)).alias("l"), F.count("*").alias("n")).where(F.col("n") >= least_cell)
    a, b = cells.select(key, F.col(grade).alias("g"), F.col("l").alias("x")), cells.select(key, F.col(grade).alias("h"), F.col("l").alias("y"))
    sums = a.join(b, key).where("g < h").groupBy("g", "h").agg(F.count("*").alias("n"), F.sum(F.col("y") - F.col("x")).alias("s")).collect()
    free = [g for g in grades if g != base]
    at = {g: i for i, g in enumerate(free)}
    normal, right, pairs = np.zeros((len(free), len(free))), np.zeros(len(free)), dict.fromkeys(grades, 0)
    for r in sums:
        v = np.zeros(len(free))
        for g, sign in ((r["h"], 1), (r["g"], -1)):
            pairs[g] += r["n"]
            if g in at:
                v[at[g]] = sign
        normal += r["n"] * np.outer(v, v)
        right += r["s"] * v
    beta = np.linalg.lstsq(normal, right, rcond=None)[0] if free else np.zeros(0)
    found = {g: float(np.exp(beta[at[g]])) if g in at else 1.0 for g in grades}
    told = [found[g] for g in sorted(grades) if pairs[g] >= least_pairs]
    rises = all(x <= y for x, y in zip(told, told[1:], strict=False))
    return {g: found[g] if rises and (g == base or pairs[g] >= least_pairs) else None for g in grades}


def blend_weights(df: DataFrame, conf: str, cell: str, x: str, y: str, weight: str, tie: str, steps: int, step: float) -> DataFrame:
    """Per confidence class the grid weight w of least weighted median |y - w x - a(cell)|, where a(cell)
    is the weighted median of y - w x there (M32); equal errors go to the smaller weight."""
    grid = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("_r", F.round(F.col(y) - F.col("k") * step * F.col(x), 9))
    centre = weighted_median(grid, [conf, "k", cell], "_r", weight, tie, "_a")
    errors = grid.join(centre, [conf, "k", cell]).withColumn("_e", F.round(F.abs(F.col("_r") - F.col("_a")), 9))
    error = weighted_median(errors, [conf, "k"], "_e", weight, tie, "error")
    return error.groupBy(conf).agg(F.min_by("k", F.struct("error", "k")).alias("k"), F.min("error").alias("error")).select(conf, (F.col("k") * step).alias("w"), "error")


def gate_cells(df: DataFrame, keys: list[str], residual: str, least: int, factor: float, share: float, max_bias: float) -> DataFrame:
    """n, close_share (residuals within ``factor`` either way), bias, open and reason of every accuracy
    cell from log residuals (M34)."""
    cells = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.abs(residual) <= F.ln(F.lit(factor))).cast("double")).alias("_w"), F.exp(F.median(residual)).alias("_b"))
    known = F.col("n") >= least
    reason = F.when(~known, "few").when(F.col("_w") < share, "inaccurate").when((F.col("_b") > max_bias) | (F.col("_b") < 1 / max_bias), "biased")
    return cells.select(*keys, "n", F.when(known, F.col("_w")).alias("close_share"), F.when(known, F.col("_b")).alias("bias"), reason.isNull().alias("open"), reason.alias("reason"))


def band_coverage(df: DataFrame, keys: list[str], ratio: str, fitted: Column, low: float, high: float, least: int) -> DataFrame:
    """Band [q low, q high] of the rows where ``fitted`` holds and the share of the other rows inside it."""
    rows = df.withColumn("_fit", fitted)
    bands = rows.where("_fit").groupBy(*keys).agg(F.percentile(ratio, F.lit(low)).alias("lo"), F.percentile(ratio, F.lit(high)).alias("hi"), F.count("*").alias("n_fit")).where(F.col("n_fit") >= least)
    tested = rows.where("not _fit").join(bands, keys)
    return tested.groupBy(*keys, "lo", "hi", "n_fit").agg(F.count("*").alias("n_test"), F.avg(F.col(ratio).between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"))


def complete_quarters(df: DataFrame, keys: list[str], quarter: str, share: float) -> DataFrame:
    """Last quarter of each group with at least ``share`` of the median count of the four before it (M3)."""
    counts = df.groupBy(*keys, quarter).agg(F.count("*").alias("_n"))
    before = F.sort_array(F.collect_list("_n").over(W.partitionBy(*keys).orderBy(quarter).rowsBetween(-4, -1)))
    size = F.size("_before")
    median = (F.get("_before", F.floor((size - 1) / 2).cast("int")) + F.get("_before", F.floor(size / 2).cast("int"))) / 2
    whole = counts.withColumn("_before", before).where((size > 0) & (F.col("_n") >= share * median))
    return whole.groupBy(*keys).agg(F.max(quarter).alias("last_q"), F.max_by("_n", quarter).alias("n_last"))


def house_shift(df: DataFrame, keys: list[str], house: str, now: Column, then: Column) -> DataFrame:
    """Largest change of a house's share of rows between two periods, in points of one (M3)."""
    counts = df.groupBy(*keys, house).agg(F.count_if(now).alias("_now"), F.count_if(then).alias("_then"))
    whole = W.partitionBy(*keys)
    change = F.abs(F.col("_now") / F.sum("_now").over(whole) - F.col("_then") / F.sum("_then").over(whole))
    return counts.withColumn("_c", F.when((F.sum("_now").over(whole) > 0) & (F.sum("_then").over(whole) > 0), change)).groupBy(*keys).agg(F.max("_c").alias("shift"))


def composite(levels: DataFrame, sizes: DataFrame, key: str, period: str, level: str, size: str, cap: float, least: int, coverage: float, most: int = 10_000) -> DataFrame:
    """Geometric mean of component indices by capped size weights (M4), for periods with ``least``
    components that hold ``coverage`` of the weight. Components are published ones: more than ``most`` raise."""
    rows = sizes.select(key, size).orderBy(key).limit(most + 1).collect()  # bounded: more raise
    if len(rows) > most:
        raise ValueError(f"more than {most} components")
    weights = levels.sparkSession.createDataFrame(list(zip([r[0] for r in rows], capped_weights([float(r[1]) for r in rows], cap), strict=True)), f"{key} {sizes.schema[key].dataType.simpleString()}, _w double")
    joined = levels.join(F.broadcast(weights), key)
    out = joined.groupBy(period).agg(F.exp(F.sum(F.col("_w") * F.ln(level)) / F.sum("_w")).alias("value"), F.count("*").alias("n"), F.sum("_w").alias("coverage"))
    return out.where((F.col("n") >= least) & (F.col("coverage") >= coverage))


def gap_lane(days: Column, projected: Column, floor: Column, near: tuple[float, float], far: tuple[float, float], deepest: float) -> tuple[Column, Column]:
    """(depth, shelf) of a projected close under a floor (M45). ``near`` and ``far``: days until the close
    and least depth of the two shelves; what lies deeper than ``deepest`` is taken for an error."""
    depth = 1 - projected / floor
    fits = (depth <= deepest) & (days > 0)
    return depth, F.when(fits & (days <= near[0]) & (depth >= near[1]), "soon").when(fits & (days > near[0]) & (days <= far[0]) & (depth >= far[1]), "later")


def decayed_signals(df: DataFrame, keys: list[str], kind: str, time: str, now: Column, weights: dict[str, float], half_life_days: float, lift: float, most: float) -> DataFrame:
    """Strongest signal of each key: weight of the kind, halved every ``half_life_days`` since it was last
    seen, lifted by ``lift`` a repeat up to ``most`` (M47)."""
    base = F.coalesce(*[F.when(F.col(kind) == k, w) for k, w in weights.items()])
    seen = df.groupBy(*keys, kind).agg(F.count("*").alias("_n"), F.max(time).alias("_t"))
    age = F.datediff(now, F.col("_t"))
    score = base * F.pow(F.lit(0.5), age / half_life_days) * F.least(F.lit(most), 1 + lift * (F.col("_n") - 1))
    return seen.withColumn("_s", score).where("_s is not null").groupBy(*keys).agg(F.max("_s").alias("score"))


def facet_splits(df: DataFrame, entity: str, facets: dict[str, Column], value: str, least: int) -> DataFrame:
    """entity, facet, label, n, median and share of every facet label with enough rows."""
    labels = F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("label")) for n, c in facets.items()])
    rows = df.select(entity, value, F.explode(labels).alias("_f")).select(entity, value, "_f.*").where("label is not null")
    cells = rows.groupBy(entity, "facet", "label").agg(F.count("*").alias("n"), F.median(value).alias("median"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(entity, "facet"))).where(F.col("n") >= least)


def resolve_picks(picks: DataFrame, outcomes: DataFrame, key: str, now: Column) -> DataFrame:
    """``picks`` (key, close, value, low, high, est_mid) with state, vs_value, vs_est and in_range from
    ``outcomes`` (key, status, price) (M57). Of several outcomes of a key a sale counts first, then the
    higher price, then the later status name, so that no pick is multiplied."""
    done = F.struct(F.coalesce((F.col("status") == "sold") & (F.col("price") > 0), F.lit(False)).alias("sold"), F.col("price").alias("price"), F.col("status").alias("status"))
    ledger = outcomes.groupBy(key).agg(F.max(done).alias("_o")).select(key, F.col("_o.status").alias("_status"), F.col("_o.price").alias("_price"))
    joined = picks.join(ledger, key, "left")
    sold = (F.col("_status") == "sold") & (F.col("_price") > 0)
    state = F.when(sold, "hammered").when(F.col("_status").isin("bought_in", "withdrawn"), "passed").when(F.col("close") <= now, "awaited").otherwise("ahead")
    return joined.withColumn("state", state).withColumn("vs_value", F.when(sold, (F.col("_price") / F.col("value") - 1) * 100)).withColumn("vs_est", F.when(sold, (F.col("_price") / F.col("est_mid") - 1) * 100)).withColumn("in_range", F.when(sold, F.col("_price").between(F.col("low"), F.col("high")))).drop("_status", "_price")


def summarise_picks(resolved: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Counts by state and medians of sold picks, null below ``least``."""
    sold = F.col("state") == "hammered"
    n = F.count_if(sold)
    return resolved.groupBy(*keys).agg(n.alias("n"), F.when(n >= least, F.median("vs_value")).alias("med_vs_value"), F.when(n >= least, F.median("vs_est")).alias("med_vs_est"), F.when(n >= least, F.count_if("in_range")).alias("in_range"), F.count_if(F.col("state") == "awaited").alias("awaited"), F.count_if(F.col("state") == "passed").alias("passed"))


def neighbour_labels(df: DataFrame, group: str, number: str, vote: str, id_col: str, reach: int, least: int, purity: float) -> DataFrame:
    """id and label of rows without a vote whose neighbours within ``reach`` numbers agree."""
    around = F.collect_list(vote).over(W.partitionBy(group).orderBy(number).rangeBetween(-reach, reach))
    rows = df.where(F.col(number).isNotNull()).withColumn("_votes", around).where(F.col(vote).isNull() & (F.size("_votes") >= least))
    counted = F.array_min(F.transform(F.array_distinct("_votes"), lambda v: F.struct((-F.size(F.filter("_votes", lambda x: x == v))).alias("n"), v.alias("label"))))
    return rows.withColumn("_best", counted).where(-F.col("_best.n") >= purity * F.size("_votes")).select(id_col, F.col("_best.label").alias("label"), F.size("_votes").cast("long").alias("n"))


def stale_sources(df: DataFrame, source: str, time: str, good: Column, now: Column, hours: float) -> DataFrame:
    """Last good time of every source and whether its rows are to be hidden."""
    last = df.groupBy(source).agg(F.max(F.when(good, F.col(time))).alias("last_good"))
    return last.withColumn("stale", F.col("last_good").isNull() | ((F.unix_timestamp(now) - F.unix_timestamp(F.col("last_good").cast("timestamp"))) / 3600 > hours))


def incremental_targets(df: DataFrame, attempted: DataFrame, key: str, recent: Column, order: list[str], budget: int) -> DataFrame:
    """Rows never attempted that are recent, oldest first, up to the budget."""
    return df.join(attempted.select(key).distinct(), key, "left_anti").where(recent).orderBy(*order).limit(budget)


def retained(df: DataFrame, owner: str, order: list[Column], expired: Column, newest: int) -> DataFrame:
    """Rows that are not expired and among the owner's newest."""
    return df.where(~expired).withColumn("_n", F.row_number().over(W.partitionBy(owner).orderBy(*order))).where(F.col("_n") <= newest).drop("_n")


def notification_plan(candidates: DataFrame, sent: DataFrame, user: str, keys: list[str], order: list[str | Column], cap: int) -> DataFrame:
    """Candidates that were not sent before, the first ``cap`` of each user."""
    fresh = candidates.join(sent.select(*keys).distinct(), keys, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(W.partitionBy(user).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")


def name_digest(df: DataFrame, name: str, day: str, value: str, sold: Column, live: Column, now: Column, window: int, year: int, least: int, moves: float) -> DataFrame:
    """Move, record, biggest recent sale and live count of every name (M58). ``lead`` is what is most worth
    telling: a record within the window, a move, a sale, live lots."""
    age = F.datediff(now, F.col(day))
    price = F.when(sold, F.col(value))
    rows = df.withColumn("_p", price).withColumn("_age", age).withColumn("_live", live)
    last, prior = (F.col("_age") >= 0) & (F.col("_age") < year), (F.col("_age") >= year) & (F.col("_age") < 2 * year)
    move = F.when((F.count(F.when(last, F.col("_p"))) >= least) & (F.count(F.when(prior, F.col("_p"))) >= least), F.median(F.when(last, F.col("_p"))) / F.median(F.when(prior, F.col("_p"))) - 1)
    out = rows.groupBy(name).agg(F.max("_p").alias("record"), F.min(F.when(F.col("_p").isNotNull(), F.struct(-F.col("_p"), F.col("_age")))).getField("_age").alias("record_age"), F.max(F.when((F.col("_age") >= 0) & (F.col("_age") < window), F.col("_p"))).alias("biggest"), move.alias("move"), F.count_if("_live").alias("n_live"))
    lead = F.when(F.col("record_age").between(0, window - 1), "record").when(F.abs("move") >= moves, "move").when(F.col("biggest").isNotNull(), "sale").when(F.col("n_live") > 0, "live")
    return out.withColumn("lead", lead)


def gates_compared(df: DataFrame, one: Column, other: Column) -> DataFrame:
    """How many rows pass each of two gates, and what a change from one to the other loses and gains."""
    return df.agg(F.count_if(one).alias("passed_a"), F.count_if(other).alias("passed_b"), F.count_if(one & ~other).alias("lost"), F.count_if(~one & other).alias("gained"))
