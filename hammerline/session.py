"""SparkSession factory and table access shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "hammerline", master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
