"""Segments, corpus tables and published artefacts: the sources and sinks of §2.1."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def read_segment(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Gzipped newline JSON; a line may hold one array of rows. A missing path is empty. Only the
    columns of ``schema`` are parsed, which is the projection at scan (S1, S4, S5)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path)
    as_array = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
    rows = lines.where(F.length(F.trim("value")) > 0).select(F.explode(F.from_json(as_array, f"array<{schema.simpleString()}>")).alias("r"))
    return rows.select("r.*")


def read_segments(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """All segments by name."""
    out = spark.createDataFrame([], schema)
    for p in paths:
        out = out.unionByName(read_segment(spark, p, schema), allowMissingColumns=True)
    return out


def write_segments(df: DataFrame, path: str, key: str) -> None:
    """One folder a segment key as gzipped JSON; segments that are absent stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy(key).json(path)


def write_corpus(df: DataFrame, path: str, ordinal: str = "lot_id") -> None:
    """Typed projection besides the whole row as JSON, zstd, by tier; a job's files appear on commit."""
    whole = df.withColumn("row_json", F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    whole.sortWithinPartitions(ordinal).write.mode("overwrite").option("compression", "zstd").partitionBy("tier").parquet(path)


def read_corpus(spark: SparkSession, path: str, ordinal: str = "lot_id") -> DataFrame:
    """Main and archive tiers, the partitions of one table, in order."""
    return spark.read.parquet(path).orderBy("tier", ordinal)


def write_sharded(df: DataFrame, path: str, rows_per_shard: int) -> DataFrame:
    """Size-bounded shards; returns shard and row counts."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard).json(path)
    return df.sparkSession.read.json(path, schema=df.schema).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("shard")).agg(F.count("*").alias("n"))


def dual_write(df: DataFrame, corpus: str, served: str, drop: list[str]) -> None:
    """The corpus and its served projection (without corpus-only columns) from one evaluation."""
    write_corpus(df, corpus)
    df.sparkSession.read.parquet(corpus).drop("row_json", *drop).write.mode("overwrite").parquet(served)


def guarded_upsert(old: DataFrame, new: DataFrame, key: str, least: float, order: list[str]) -> DataFrame:
    """The table after a load: the new rows, one a key (the first in ``order``); rows that vanished are
    swept, unless the new side is empty or has fewer keys than ``least`` of the old, which raises (S17)."""
    fresh = new.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    n, m = fresh.count(), old.select(key).distinct().count()
    if n == 0 or n < least * m:
        raise ValueError(f"refused: {n} rows against {m}")
    return fresh


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not stored yet, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def publish(df: DataFrame, base: str, keep: int, version: str | None = None) -> str:
    """Write-once version folder, then a pointer that is written aside and renamed, so that readers find
    the old or the new one (S19). Pointers are numbered: the highest is valid; the ``keep`` versions last
    pointed at stay."""
    spark = df.sparkSession
    version = version or time.strftime("%Y%m%dT%H%M%S", time.gmtime())
    if exists(spark, f"{base}/version={version}"):
        raise ValueError(f"version {version} exists")
    df.write.parquet(f"{base}/version={version}")
    told = _pointers(spark, base)
    aside, place = (_fs(spark, f"{base}/{name}")[0] for name in (f"_aside-{version}", f"pointer={len(told) and told[-1][0] + 1:012d}={version}"))
    fs = _fs(spark, base)[1]
    fs.create(aside, False).close()
    if not fs.rename(aside, place):
        raise ValueError(f"another version took the place of {version}")
    told = _pointers(spark, base)
    for _, name, path in told[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/version={name}"), True)
        fs.delete(path, False)
    return version


def _pointers(spark: SparkSession, base: str) -> list[tuple]:
    """(number, version, path) in order; as many as versions are kept."""
    p, fs = _fs(spark, base)
    names = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("pointer=")]
    return sorted(((int(x.getName().split("=", 2)[1]), x.getName().split("=", 2)[2], x) for x in names), key=lambda x: x[:2])


def published(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base}/version={_pointers(spark, base)[-1][1]}")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Rows packed by a hash of their key, sorted within, so that a lookup reads one folder's pages."""
    bucket = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions(key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, key: str, value, buckets: int = 64) -> DataFrame:
    import zlib

    return spark.read.parquet(path).where((F.col("bucket") == zlib.crc32(str(value).encode()) % buckets) & (F.col(key) == value)).drop("bucket")
