"""Readers of the fixture tables as the library's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as usage telemetry: id, ts, vault_id, tool, label, latency_ms, success (null where unknown)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("vault_id"),
        F.col("event_type").alias("tool"),
        F.get_json_object("props", "$.k").alias("label"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
    )
