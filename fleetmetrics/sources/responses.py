"""Metric responses: pages of parallel arrays to raw payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import RESOURCE_DIMENSIONS
from ..functions.rounding import even_round
from ..functions.timestamps import iso_utc, instant_to_utc
from ..schemas import METRIC_RESPONSE, RAW_PAYLOAD

# Columns a request row must bring: what was asked for, of which resource, when.
REQUEST_COLUMNS = (
    "request_id",
    "query_id",
    "source_account_id",
    "region",
    "target_name",
    "resource_dimension",
    "resource_id",
    "engine",
    "cluster_identifier",
    "cluster_role",
    "metric_profile",
    "resource_profile",
    "metric_name",
    "statistic",
    "unit",
    "period_seconds",
    "start_time",
    "end_time",
    "collected_at",
)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Dumped response pages, one JSON document per file."""
    return (
        spark.read.schema(METRIC_RESPONSE)
        .option("multiLine", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(path)
    )


def response_points(pages: DataFrame) -> DataFrame:
    """One row per (request, query, timestamp): arrays paired up to the shorter one."""
    results = pages.select("request_id", F.explode("MetricDataResults").alias("r"))
    both = F.least(F.size("r.Timestamps"), F.size("r.Values"))
    pairs = F.arrays_zip(
        F.slice("r.Timestamps", F.lit(1), both).alias("t"),
        F.slice("r.Values", F.lit(1), both).alias("v"),
    )
    stamped = F.col("p.t")
    is_instant = pages.schema["MetricDataResults"].dataType.elementType["Timestamps"].dataType.elementType
    utc = instant_to_utc(stamped) if is_instant.typeName() == "timestamp" else stamped
    return (
        results.where(both > 0)
        .select("request_id", F.col("r.Id").alias("query_id"), F.explode(pairs).alias("p"))
        .select(
            "request_id",
            "query_id",
            iso_utc(utc).alias("timestamp"),
            even_round(F.col("p.v"), 4).alias("value"),
        )
    )


def payloads(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """One raw payload per requested metric, with its datapoints in time order.

    Results that span pages are put together; a metric without data still
    gives an empty payload; results nobody asked for are dropped. The list of
    one payload is bounded by its request window over the sampling period.
    """
    collected = (
        response_points(pages)
        .groupBy("request_id", "query_id")
        .agg(F.array_sort(F.collect_list(F.struct("timestamp", "value"))).alias("datapoints"))
    )
    empty = F.array().cast("array<struct<timestamp:string,value:double>>")
    points = F.coalesce("datapoints", empty)
    resource_type = F.create_map(
        *[F.lit(part) for pair in RESOURCE_DIMENSIONS.items() for part in pair]
    )[F.col("resource_dimension")]
    fixed = {
        "schema_version": F.lit("1.0"),
        "source": F.lit("Amazon CloudWatch"),
        "namespace": F.lit("AWS/RDS"),
        "resource_type": resource_type,
        "datapoint_count": F.size(points),
        "datapoints": points,
    }
    return (
        requests.select(*REQUEST_COLUMNS)
        .join(collected, ["request_id", "query_id"], "left")
        .withColumns(fixed)
        .select(*RAW_PAYLOAD.fieldNames())
    )


def as_raw(payload_rows: DataFrame, source_file: str = "") -> DataFrame:
    """Payloads in the shape of the raw scan, for flattening without a file in between."""
    return payload_rows.withColumns(
        {
            "datapoints": F.col("datapoints").cast(RAW_PAYLOAD["datapoints"].dataType),
            "source_file": F.lit(source_file),
            "path_account_id": F.lit(None).cast("string"),
            "path_region": F.lit(None).cast("string"),
        }
    )
