"""Metric catalogue, collection profile, report statistics.

Everything in this module is a lookup table whose entries must equal the
published metric names, statistics and rounding of the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROFILE_NAME = "operational-v1"

# Metric name, collection statistic, unit.
METRICS = (
    ("CPUUtilization", "Average", "Percent"),
    ("DatabaseConnections", "Average", "Count"),
    ("FreeableMemory", "Minimum", "Bytes"),
    ("ReadIOPS", "Average", "Count/Second"),
    ("WriteIOPS", "Average", "Count/Second"),
    ("ReadLatency", "Average", "Seconds"),
    ("WriteLatency", "Average", "Seconds"),
    ("ReadThroughput", "Average", "Bytes/Second"),
    ("WriteThroughput", "Average", "Bytes/Second"),
    ("DiskQueueDepth", "Average", "Count"),
    ("NetworkReceiveThroughput", "Average", "Bytes/Second"),
    ("NetworkTransmitThroughput", "Average", "Bytes/Second"),
    ("FreeStorageSpace", "Minimum", "Bytes"),
    ("FreeLocalStorage", "Minimum", "Bytes"),
    ("VolumeBytesUsed", "Average", "Bytes"),
    ("AuroraReplicaLag", "Maximum", "Milliseconds"),
    ("AuroraReplicaLagMaximum", "Maximum", "Milliseconds"),
    ("BinLogDiskUsage", "Maximum", "Bytes"),
    ("TransactionLogsDiskUsage", "Maximum", "Bytes"),
    ("SwapUsage", "Maximum", "Bytes"),
    ("FailedSQLServerAgentJobsCount", "Sum", "Count"),
    ("TempDbAvailableDataSpace", "Minimum", "Bytes"),
    ("TempDbAvailableLogSpace", "Minimum", "Bytes"),
    ("TempDbDataFileUsage", "Maximum", "Percent"),
    ("TempDbLogFileUsage", "Maximum", "Percent"),
    ("CPUCreditBalance", "Minimum", "Count"),
    ("BurstBalance", "Minimum", "Percent"),
    ("ReplicaLag", "Maximum", "Seconds"),
)

# The metrics collected for every instance.
BASE_INSTANCE_METRICS = (
    "CPUUtilization",
    "DatabaseConnections",
    "FreeableMemory",
    "ReadIOPS",
    "WriteIOPS",
    "ReadLatency",
    "WriteLatency",
    "ReadThroughput",
    "WriteThroughput",
    "DiskQueueDepth",
    "NetworkReceiveThroughput",
    "NetworkTransmitThroughput",
)

# Request dimension of a resource -> its type.
RESOURCE_DIMENSIONS = {
    "DBInstanceIdentifier": "db_instance",
    "DBClusterIdentifier": "db_cluster",
}

# Metric, aggregate, output column, decimals.
HEALTH_STATS = (
    ("CPUUtilization", "avg", "cpu_avg", 2),
    ("CPUUtilization", "max", "cpu_max", 2),
    ("FreeableMemory", "min", "freeable_memory_min_bytes", 0),
    ("DatabaseConnections", "avg", "connections_avg", 2),
    ("DatabaseConnections", "max", "connections_max", 2),
    ("ReadLatency", "avg", "read_latency_avg", 4),
    ("WriteLatency", "avg", "write_latency_avg", 4),
    ("ReadIOPS", "avg", "read_iops_avg", 2),
    ("WriteIOPS", "avg", "write_iops_avg", 2),
    ("DiskQueueDepth", "avg", "disk_queue_depth_avg", 2),
    ("AuroraReplicaLag", "max", "aurora_replica_lag_max", 2),
    ("FreeStorageSpace", "min", "free_storage_space_min_bytes", 0),
)

# The live report carries the same columns, all with four decimals.
LIVE_STATS = tuple((metric, agg, column, 4) for metric, agg, column, _ in HEALTH_STATS)

# Metric, aggregate, output column, decimals.
BASELINE_STATS = (
    ("CPUUtilization", "avg", "cpu_avg_baseline", 4),
    ("CPUUtilization", "stddev", "cpu_stddev_baseline", 4),
    ("DatabaseConnections", "avg", "connections_avg_baseline", 4),
    ("DatabaseConnections", "stddev", "connections_stddev_baseline", 4),
    ("ReadLatency", "avg", "read_latency_avg_baseline", 4),
    ("WriteLatency", "avg", "write_latency_avg_baseline", 4),
    ("ReadIOPS", "avg", "read_iops_avg_baseline", 4),
    ("WriteIOPS", "avg", "write_iops_avg_baseline", 4),
    ("DiskQueueDepth", "avg", "disk_queue_depth_avg_baseline", 4),
    ("AuroraReplicaLag", "avg", "aurora_replica_lag_avg_baseline", 4),
    ("AuroraReplicaLag", "max", "aurora_replica_lag_max_baseline", 4),
    ("FreeableMemory", "avg", "freeable_memory_avg_baseline_bytes", 4),
    ("FreeStorageSpace", "avg", "free_storage_space_avg_baseline_bytes", 4),
)

# Metric, aggregate, output column, decimals.
MONTHLY_STATS = (
    ("CPUUtilization", "avg", "cpu_avg", 4),
    ("CPUUtilization", "max", "cpu_max", 4),
    ("DatabaseConnections", "avg", "connections_avg", 4),
    ("DatabaseConnections", "max", "connections_max", 4),
    ("ReadLatency", "avg", "read_latency_avg", 4),
    ("WriteLatency", "avg", "write_latency_avg", 4),
    ("ReadIOPS", "avg", "read_iops_avg", 4),
    ("WriteIOPS", "avg", "write_iops_avg", 4),
    ("DiskQueueDepth", "avg", "disk_queue_depth_avg", 4),
    ("AuroraReplicaLag", "max", "aurora_replica_lag_max", 4),
    ("FreeableMemory", "min", "freeable_memory_min_bytes", 4),
    ("FreeStorageSpace", "min", "free_storage_space_min_bytes", 4),
    ("VolumeBytesUsed", "max", "volume_bytes_used_max", 4),
)

# Monthly columns compared with the month before.
COMPARED_COLUMNS = (
    "cpu_avg",
    "cpu_max",
    "connections_avg",
    "connections_max",
    "read_latency_avg",
    "write_latency_avg",
    "read_iops_avg",
    "write_iops_avg",
    "disk_queue_depth_avg",
)

BYTES_PER_GIB = 1024**3
SQL_TEXT_LIMIT = 1200
SQL_DISPLAY_LIMIT = 400
TRUNCATION_MARK = "…"


def stat_columns(stats: tuple[tuple[str, str, str, int], ...]) -> list[str]:
    return [column for _, _, column, _ in stats]


def metric_catalogue(spark: SparkSession) -> DataFrame:
    """The metric catalogue as a table of fixed size (metric_name, statistic, unit)."""
    return spark.createDataFrame(
        list(METRICS), "metric_name string, statistic string, unit string"
    )
