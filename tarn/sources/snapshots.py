"""Versioned tables: each version is a Parquet folder that nothing writes twice; a published one can't be purged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DONE = "PUBLISHED"


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Spark itself would find it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def create(df: DataFrame, root: str, version: str) -> None:
    """Writes a version; an error if it exists."""
    df.write.mode("error").parquet(f"{root}/{version}/rows")


def sample(spark: SparkSession, root: str, version: str, new: str, fraction: float, seed: int = 1) -> None:
    """A new version of a random share of another's rows."""
    create(read(spark, root, version).sample(fraction, seed=seed), root, new)


def read(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{version}/rows")


def is_published(spark: SparkSession, root: str, version: str) -> bool:
    mark, files = _path(spark, f"{root}/{version}/{_DONE}")
    return files.exists(mark)


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Marks a version that exists as published."""
    rows, files = _path(spark, f"{root}/{version}/rows/_SUCCESS")
    if not files.exists(rows):
        raise ValueError(f"no version {version}")
    mark, files = _path(spark, f"{root}/{version}/{_DONE}")
    files.create(mark, True).close()


def purge(spark: SparkSession, root: str, version: str) -> None:
    """Deletes a version; an error if it is published."""
    if is_published(spark, root, version):
        raise ValueError(f"version {version} is published")
    where, files = _path(spark, f"{root}/{version}")
    files.delete(where, True)


def versions(spark: SparkSession, root: str) -> list[tuple[str, bool]]:
    """(version, published) of the versions written whole, by name."""
    where, files = _path(spark, root)
    names = sorted(f.getPath().getName() for f in files.listStatus(where)) if files.exists(where) else []
    whole = [n for n in names if files.exists(_path(spark, f"{root}/{n}/rows/_SUCCESS")[0])]
    return [(n, is_published(spark, root, n)) for n in whole]
