"""Time-aware, hierarchical and similarity joins (§2.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of_last(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, tie: str, strict: bool = False) -> DataFrame:
    """``left`` with the value of the latest right row of the key at or before (or before) its time.

    One sort of the union: no pair of a target and an earlier row is ever made (J7, J6)."""
    a = left.withColumn("_t", F.col(left_time).cast("timestamp")).withColumn("_side", F.lit(0 if strict else 1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType))
    b = right.select(*keys, F.col(right_time).cast("timestamp").alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.col(value).alias("_v"), F.col(tie).alias("_tie")).withColumn("_right", F.lit(True))
    both = a.withColumn("_right", F.lit(False)).unionByName(b, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(order)).where("not _right").drop("_t", "_side", "_v", "_tie", "_right")


def nearest(left: DataFrame, right: DataFrame, left_key: Column, right_key: str, value: str) -> DataFrame:
    """``left`` with the value of the nearest key of a small calendar table, ties to the later.
    The table is aggregated to one array, which is broadcast: it must be a calendar, not data."""
    pairs = right.agg(F.collect_list(F.struct(F.col(right_key).alias("k"), F.col(value).alias("v"))).alias("_all"))
    ranked = F.array_min(F.transform("_all", lambda p: F.struct(F.abs(p["k"] - left_key).alias("d"), (-p["k"]).alias("k"), p["v"].alias("v"))))
    return left.crossJoin(F.broadcast(pairs)).withColumn(value, ranked["v"]).drop("_all")


def fill_forward(calendar: DataFrame, values: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Value of the nearest earlier period, of the first one before it."""
    joined = calendar.join(values, [*keys, period], "left")
    order = W.partitionBy(*keys).orderBy(period)
    earlier = F.last(value, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    return joined.withColumn(value, F.coalesce(earlier, first))


def fallback(df: DataFrame, levels: list[tuple[list[str], DataFrame]], value: str) -> DataFrame:
    """First known value over levels from fine to coarse; every level is a small table of cells."""
    names = []
    for i, (keys, cells) in enumerate(levels):
        names.append(f"_l{i}")
        cell = cells.select(*keys, F.col(value).alias(names[-1]))
        df = df.join(cell, keys, "left") if keys else df.crossJoin(F.broadcast(cell))
    return df.withColumn(value, F.coalesce(*names)).drop(*names)


def prior_median(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """n and median of the rows of the key strictly before each row's day (J6): one range window over
    the day number, so that no pair of a target and an earlier row is made."""
    before = W.partitionBy(*keys).orderBy(F.unix_date(F.col(time).cast("date"))).rangeBetween(W.unboundedPreceding, -1)
    return df.withColumn("n_prior", F.count(value).over(before)).withColumn("median_prior", F.percentile(value, F.lit(0.5)).over(before))


def token_similarity(df: DataFrame, id_col: str, token_col: str, weight: str, floor: float, reach: float = 0.7) -> DataFrame:
    """Pairs a < b of cosine at least ``floor`` between sparse vectors (id, token, weight), with prefix filter.

    Equal vectors collapse to the one of smallest id, so copies meet only in the result. Tokens are ordered
    by document frequency, rarest first. A vector's prefix ends where the norm of the rest falls below
    ``reach * floor``. Tokens up to the earlier end of two prefixes are in both; the rest adds at most the
    larger of the two norms left over, so pairs whose product over the prefixes misses the floor by more
    are dropped before the whole vectors are read. No pair is lost (J17, M11).

    Weights of 0 add nothing; a vector without others, or with a null id, has no pairs."""
    df = df.where(F.col(weight) != 0).where(F.col(id_col).isNotNull())
    hashes = [F.xxhash64(F.lit(i), F.col(token_col), F.col(weight)) for i in range(2)]
    parts = [f(h) for h in hashes for f in (lambda h: F.shiftright(h, 32), lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    keys = [f"_h{i}" for i in range(len(parts))]
    vectors = df.groupBy(id_col).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_norm"), F.count("*").alias("_n"), *[F.sum(p).alias(k) for p, k in zip(parts, keys, strict=True)])
    classes = vectors.groupBy("_n", *keys).agg(F.min(F.struct(id_col, "_norm")).alias("_rep"), F.count("*").alias("_copies"))
    norms = classes.select(F.col(f"_rep.{id_col}").alias(id_col), "_rep._norm")
    unit = df.join(norms, id_col).withColumn("_u", F.col(weight) / F.col("_norm")).select(id_col, token_col, "_u")
    frequency = unit.groupBy(token_col).agg(F.count("*").alias("_df"))
    order = W.partitionBy(id_col).orderBy(F.desc("_df"), F.desc(token_col)).rowsBetween(W.unboundedPreceding, 0)
    marked = unit.join(frequency.where("_df > 1"), token_col, "left").withColumn("_df", F.coalesce("_df", F.lit(1))).withColumn("_suffix", F.sum(F.col("_u") * F.col("_u")).over(order))
    cut = (reach * floor) ** 2
    rest = F.sqrt(F.coalesce(F.max(F.when(F.col("_suffix") < cut, F.col("_suffix"))).over(W.partitionBy(id_col)), F.lit(0.0)))
    prefix = marked.withColumn("_rest", rest).where((F.col("_suffix") >= cut) & (F.col("_df") > 1))
    a = prefix.select(F.col(id_col).alias("a"), F.col(token_col).alias("_k"), F.col("_u").alias("_x"), F.col("_rest").alias("_ra"))
    b = prefix.select(F.col(id_col).alias("b"), F.col(token_col).alias("_k"), F.col("_u").alias("_y"), F.col("_rest").alias("_rb"))
    met = a.join(b, "_k").where("a < b").groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("_known"), F.max(F.greatest("_ra", "_rb")).alias("_rest"))
    pairs = met.where(F.col("_known") + F.col("_rest") >= floor - 1e-9).select("a", "b")
    x = unit.select(F.col(id_col).alias("a"), F.col(token_col).alias("_k"), F.col("_u").alias("_x"))
    y = unit.select(F.col(id_col).alias("b"), F.col(token_col).alias("_k"), F.col("_u").alias("_y"))
    scored = pairs.join(x, "a").join(y, ["b", "_k"]).groupBy("a", "b").agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine")).where(F.col("cosine") >= floor)
    members = vectors.join(classes.select("_n", *keys, F.col(f"_rep.{id_col}").alias("_class"), "_copies"), ["_n", *keys]).select(F.col(id_col).alias("_id"), "_class", "_copies")
    one, two = members.select(F.col("_id").alias("_one"), F.col("_class").alias("a")), members.select(F.col("_id").alias("_two"), F.col("_class").alias("b"))
    across = scored.join(one, "a").join(two, "b").select(F.least("_one", "_two").alias("a"), F.greatest("_one", "_two").alias("b"), "cosine")
    copies = members.where("_copies > 1")
    within = copies.select(F.col("_id").alias("a"), "_class").join(copies.select(F.col("_id").alias("b"), "_class"), "_class").where("a < b")
    return across.unionByName(within.select("a", "b", F.lit(1.0).alias("cosine")).where(F.lit(floor) <= 1))
