"""Spark session settings the engine is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution does the runtime work the jobs rely on: it broadcasts a
# join side only after measuring it, splits skewed join partitions, splits or
# merges the rebalanced hour partitions of the curated writer, and sizes
# shuffles to the data.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Small inputs still use the cores: writing many hours is one file each.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "32k",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
}


def build_session(
    app_name: str = "fleetmetrics",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or get) a session with the engine settings; ``conf`` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
