"""Order statistics, weighted aggregates, shrinkage (§2.4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def quantile(value: str, q: float) -> Column:
    """Linear interpolation between order statistics, q clamped to [0, 1] (A5)."""
    return F.percentile(value, F.lit(min(1.0, max(0.0, q))))


def upper_middle(value: str) -> Column:
    """The upper of the two middle values (A4)."""
    ordered = F.sort_array(F.collect_list(value))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str, name: str = "weighted_median") -> DataFrame:
    """Lower weighted median; rows of non-positive weight are dropped, and a group left without
    weights has its plain median (A6)."""
    good = df.where((F.col(weight) > 0) & F.col(value).isNotNull())
    order = W.partitionBy(*keys).orderBy(value, tie)
    cumulative = good.withColumn("_c", F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", F.sum(weight).over(W.partitionBy(*keys)))
    heavy = cumulative.where(F.col("_c") >= F.col("_t") / 2).groupBy(*keys).agg(F.min(value).alias(name))
    plain = df.groupBy(*keys).agg(F.median(value).alias("_plain"))
    return plain.join(heavy, keys, "left").select(*keys, F.coalesce(name, "_plain").alias(name))


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, tie: str, name: str) -> DataFrame:
    """Interpolates between the midpoints of the cumulative weights."""
    order = W.partitionBy(*keys).orderBy(value, tie)
    rows = df.where(F.col(weight) > 0).withColumn("_c", F.sum(weight).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", F.sum(weight).over(W.partitionBy(*keys)))
    rows = rows.withColumn("_p", (F.col("_c") - F.col(weight) / 2) / F.col("_t"))
    rows = rows.withColumn("_np", F.lead("_p").over(order)).withColumn("_nv", F.lead(value).over(order)).withColumn("_n", F.row_number().over(order))
    first = F.min(F.when((F.col("_n") == 1) & (F.col("_p") >= q), F.col(value)))
    last = F.max(F.when(F.col("_np").isNull() & (F.col("_p") <= q), F.col(value)))
    between = F.max(F.when((F.col("_p") <= q) & (F.col("_np") > q), F.col(value) + (F.col("_nv") - F.col(value)) * (q - F.col("_p")) / (F.col("_np") - F.col("_p"))))
    return rows.groupBy(*keys).agg(F.coalesce(between, first, last).alias(name))


def kish(weight: str) -> Column:
    """Effective number of rows (A10)."""
    return F.sum(weight) * F.sum(weight) / F.sum(F.col(weight) * F.col(weight))


def mad_scale(df: DataFrame, keys: list[str], value: str, name: str = "scale") -> DataFrame:
    """Median absolute deviation from the group's median over 0.6745."""
    centre = df.groupBy(*keys).agg(F.median(value).alias("_m"))
    return df.join(centre, keys).groupBy(*keys).agg((F.median(F.abs(F.col(value) - F.col("_m"))) / 0.6745).alias(name))


def median_rank(n: int) -> int:
    """Rank (from 1) of the lower end of a 95 % interval of the median of n values: exact binomial up
    to 60, normal beyond; 0 if there is none (A12, N7)."""
    if n <= 60:
        total, k = 0.0, 0
        while k <= n:
            total += math.comb(n, k) / 2**n
            if total > 0.025:
                return k
            k += 1
        return 0
    return max(0, math.floor(n / 2 - 0.98 * math.sqrt(n)))


def median_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median and the interval between two order statistics of every group."""
    ranks = df.sparkSession.createDataFrame([(n, median_rank(n)) for n in range(61)], "n long, _k int")  # 61 rows
    order = W.partitionBy(*keys).orderBy(value)
    rows = df.withColumn("_r", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy(*keys)))
    rows = rows.join(F.broadcast(ranks), "n", "left").withColumn("_k", F.coalesce("_k", F.greatest(F.lit(0), F.floor(F.col("n") / 2 - 0.98 * F.sqrt("n"))).cast("int")))
    return rows.groupBy(*keys, "n").agg(F.median(value).alias("median"), F.max(F.when(F.col("_r") == F.col("_k"), F.col(value))).alias("low"), F.max(F.when(F.col("_r") == F.col("n") + 1 - F.col("_k"), F.col(value))).alias("high"))


def mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value, ties to the smallest."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(name))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in [edge, next edge), the last open; empty bins are rows too."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col(value))) - 1
    bins = df.sparkSession.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "bin int, edge double")
    counts = df.where(F.col(value) >= edges[0]).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", "edge", F.coalesce("n", F.lit(0)).alias("n"))


def shrunk(value: Column, weight: Column, parent: Column, k: float) -> Column:
    """(W x + K parent) / (W + K)."""
    return (weight * value + k * parent) / (weight + k)


def at_least(n: Column, least: int, value: Column) -> Column:
    """Null for a group too small to tell."""
    return F.when(n >= least, value)


def capped_weights(weights: list[float], share: float) -> list[float]:
    """Weights of sum 1 of which none exceeds ``share``; the excess goes to the others in proportion."""
    total = sum(weights)
    w = [x / total for x in weights] if total else []
    if share * len(w) <= 1:
        return [1 / len(w)] * len(w) if w else []
    while w and max(w) > share + 1e-12:
        fixed = [x >= share - 1e-12 for x in w]
        free = sum(x for x, f in zip(w, fixed, strict=True) if not f)
        rest = 1 - share * sum(fixed)
        w = [share if f else x * rest / free for x, f in zip(w, fixed, strict=True)]
    return w
