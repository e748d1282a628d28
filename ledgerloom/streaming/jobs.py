"""Structured Streaming forms of the incremental computations over events; their batch twins have SQL.

Queries run in update mode with a watermark, so that state is freed; each batch is written to the shared folder under its
number, again where it is repeated, and a key's latest row counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

LATE = "2 hours"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def finished(df: DataFrame, keys: list[str]) -> DataFrame:
    """Run to the end of what there is; the latest row of each key."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{base}/rows").parquet(f"{base}/rows")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(*([F.max_by(F.struct(*rest), "batch").alias("r")] if rest else [])).select(*keys, *([f"r.{c}" for c in rest]))


def minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = events_stream(spark, sf_dir).groupBy(F.window("ts", "1 minute")).count()
    return finished(counts.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), F.col("count").alias("n")), ["minute"])


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(events_stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), ["event_type"])


def running_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running median and tail, approximate as a stream's have to be."""
    sketched = events_stream(spark, sf_dir).groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95], 1000).alias("p"))
    return finished(sketched.select("event_type", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95")), ["event_type"])


def first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of each day: a day's state goes when the watermark has passed it."""
    seen = events_stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "user_id", "event_type").count()
    keys = finished(seen.select("user_id", "event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "count"), ["user_id", "event_type", "day"])
    return keys.drop("count")
