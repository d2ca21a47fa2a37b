"""Readers and writers of files: delimited, fixed-width, ORC, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def copy_from(
    spark: SparkSession, path: str, schema: str, delimiter: str = ",", null: str = "", header: bool = False, quote: str = '"', date_format: str | None = None, encoding: str = "UTF-8", transform: dict[str, Column] | None = None, errors: str | None = None
) -> DataFrame:
    """Delimited text. With ``errors`` rows that don't fit keep their line in that column; without, they are an error."""
    r = spark.read.option("sep", delimiter).option("nullValue", null).option("header", header).option("quote", quote).option("encoding", encoding)
    if date_format:
        r = r.option("dateFormat", date_format)
    if errors:
        df = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", errors).schema(f"{schema}, {errors} string").csv(path)
    else:
        df = r.option("mode", "FAILFAST").schema(schema).csv(path)
    for name, value in (transform or {}).items():
        df = df.withColumn(name, value)
    return df


def copy_to(df: DataFrame, path: str, delimiter: str = ",", null: str = "", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", delimiter).option("nullValue", null).option("header", header).csv(path)


def read_fixed(spark: SparkSession, path: str, fields: list[tuple[str, int, int, str]]) -> DataFrame:
    """Fixed-width lines: (name, offset, length, type) of each field."""
    return spark.read.text(path).select(*[F.trim(F.substring("value", a + 1, n)).cast(t).alias(name) for name, a, n, t in fields])


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, **options: str) -> DataFrame:
    """A table or a query of another database; its driver must be on the class path."""
    key = "query" if " " in table_or_query.strip() else "dbtable"
    return spark.read.format("jdbc").option("url", url).option(key, table_or_query).options(**options).load()
