"""Session settings and table readers shared by every query."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "tarn", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session; on a cluster the submitter's own session is used instead."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("TARN_DRIVER_MEMORY", "8g"),
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table by Spark's own reader, so any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> None:
    """Temp views over the tables, for SQL text."""
    for name in TABLES if names is None else names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
