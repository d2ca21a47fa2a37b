"""Continuous views: windowed aggregates over a stream of files, with retention and incremental refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def with_time(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream whose ``time`` (as a point in time, which watermarks need) lags by ``late`` at most."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed(events: DataFrame, width: str, slide: str | None = None, time: str = "ts", by: tuple[str, ...] = ("event_type",), late: str | None = None) -> DataFrame:
    """Counts and sums by window; ``late`` is how long a window waits for late rows."""
    held = with_time(events, time, late) if late else events
    start = F.col("w.start").cast(events.schema[time].dataType)
    return held.groupBy(F.window(time, width, slide or width).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        start.alias("window_start"), *by, "n", "total"
    )


def run_once(view: DataFrame) -> DataFrame:
    """Drains a stream's present input and returns the whole view: each batch's result replaces the one before, in the shared folder."""
    spark = view.sparkSession
    root = f"{shared_dir(spark)}/view-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch-{number:09d}")

    query = view.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}-progress").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max((p["batchId"] for p in query.recentProgress), default=0)
    return spark.read.schema(view.schema).parquet(f"{root}/batch-{last:09d}")


def run_to_table(rows: DataFrame) -> DataFrame:
    """Drains a stream's present input into a Parquet table in the shared folder: rows that are final, each once."""
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    query = rows.writeStream.format("parquet").option("path", root).option("checkpointLocation", f"{root}-progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(root)


def retained(view: DataFrame, ttl: str, time: str = "window_start") -> DataFrame:
    """Rows no older than the newest less the time to live; older results are deleted, not only late input."""
    newest = view.agg(F.max(time).alias("_newest"))
    return view.crossJoin(F.broadcast(newest)).filter(F.col(time) >= F.col("_newest") - F.expr(f"interval {ttl}")).drop("_newest")


def append_refresh(events: DataFrame, path: str, checkpoint: str, pick) -> DataFrame:
    """An incremental materialised view: each batch's rows are appended to a Parquet table."""

    def add(batch: DataFrame, number: int) -> None:
        pick(batch).write.mode("append").parquet(path)

    query = events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return events.sparkSession.read.parquet(path)


def statistics(view: DataFrame, mode: str = "complete") -> DataFrame:
    """Drains a stream's present input and returns what its micro-batches read, as one row."""
    query = view.writeStream.format("noop").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sum(p["numInputRows"] for p in query.recentProgress)
    return view.sparkSession.createDataFrame([(rows,)], "input_rows bigint")
