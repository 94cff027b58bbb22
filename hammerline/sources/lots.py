"""Lots: the wide auction row, mapped from the driver's tables, and its SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

LOTS_SQL = """lots AS (SELECT CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15) AS BIGINT) AS lot_id, l_orderkey AS sale, l_suppkey AS maker, l_partkey AS object,
  n_regionkey AS house, p_brand AS category, p_type AS form, p_size AS size, l_extendedprice AS price, CAST(l_shipdate AS DATE) AS day,
  CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN 'sold' WHEN l_linestatus = 'F' THEN 'bought_in' ELSE 'upcoming' END AS status,
  p_retailprice * l_quantity * 0.9 AS est_low, p_retailprice * l_quantity * 1.1 AS est_high, l_discount AS discount, l_tax AS tax, l_quantity AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
sold AS (SELECT *, CAST(year(day) * 4 + quarter(day) - 1 AS INT) AS q FROM lots WHERE status = 'sold' AND price > 0)"""


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a lot; its id is 60 bits of a hash of the keys, whatever their range. The part and supplier sides are dimension tables whose join strategy is left to
    the optimiser (broadcast only under its size threshold)."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    status = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") != "R", "sold").otherwise("bought_in")).otherwise("upcoming")
    made = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    estimate = F.col("p_retailprice") * F.col("l_quantity")
    return made.select(
        F.conv(F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").cast("binary")), 1, 15), 16, 10).cast("long").alias("lot_id"),
        F.col("l_orderkey").alias("sale"),
        F.col("l_suppkey").alias("maker"),
        F.col("l_partkey").alias("object"),
        F.col("n_regionkey").alias("house"),
        F.col("p_brand").alias("category"),
        F.col("p_type").alias("form"),
        F.col("p_size").alias("size"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_shipdate").cast("date").alias("day"),
        status.alias("status"),
        (estimate * 0.9).alias("est_low"),
        (estimate * 1.1).alias("est_high"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
    )


def sold(rows: DataFrame) -> DataFrame:
    """Sold and priced lots, with their quarter ordinal."""
    return rows.where((F.col("status") == "sold") & (F.col("price") > 0)).withColumn("q", (F.year("day") * 4 + F.quarter("day") - 1).cast("int"))
