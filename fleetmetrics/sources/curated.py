"""The curated table: partitioned Parquet, written by whole hours, read by scope."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.validators import check_account_id, check_date, check_region, check_resource_id
from ..schemas import CURATED, PARTITION_COLUMNS

ROW_ORDER = ("metric_timestamp", "resource_id", "metric_name")
#: Reports ask for some resources and metrics: files tell which of them a row group cannot hold.
LOOKED_UP = ("resource_id", "metric_name")
#: Rows come in time order, so a row group holds a few sample times of a part of the fleet.
ROW_GROUP_BYTES = 32 << 20


def write_curated(rows: DataFrame, root: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Overwrite exactly the hours present in ``rows``.

    Rows are rebalanced by hour: an ordinary hour ends as one file, while an
    hour larger than the advisory partition size is split by adaptive execution
    into several files instead of passing through one task. Rows are sorted by
    time, resource and metric inside each file. Every row group carries a Bloom filter of its
    resources and one of its metrics, so a report on few resources skips groups whose range of
    names covers them but which hold none of their rows.
    """
    (
        rows.select(*CURATED.fieldNames())
        .hint("rebalance", *PARTITION_COLUMNS)
        .sortWithinPartitions(*PARTITION_COLUMNS, *ROW_ORDER)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .option("parquet.block.size", row_group_bytes)
        .options(**{f"parquet.bloom.filter.enabled#{column}": "true" for column in LOOKED_UP})
        # The smallest fitting of twelve sizes from 1 MB down: a small hour gets a small filter.
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .options(**{f"parquet.bloom.filter.candidates.number#{column}": 12 for column in LOOKED_UP})
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(root)
    )


def read_curated(spark: SparkSession, root: str) -> DataFrame:
    """The curated table with its explicit schema (partition text stays text)."""
    return spark.read.schema(CURATED).parquet(root)


def read_curated_or_none(spark: SparkSession, root: str) -> DataFrame | None:
    """The curated table, or None while nothing has been written."""
    try:
        return read_curated(spark, root)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """The curated table as optional enrichment: empty while there is none."""
    table = read_curated_or_none(spark, root)
    return empty_curated(spark) if table is None else table


def hours_of(spark: SparkSession, root: str, hours: DataFrame) -> DataFrame | None:
    """Curated rows of the given hours (partition values), or None before the first write.

    The least and greatest day of each account and region go into the partition filters, so an
    old sample of one account does not widen what is read of the others; the join keeps exactly
    the hours.
    """
    existing = read_curated_or_none(spark, root)
    if existing is None:
        return None
    spans = hours.groupBy("account_id", "region").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    within = [
        (F.col("account_id") == s["account_id"]) & (F.col("region") == s["region"]) & F.col("date").between(s["first"], s["last"])
        for s in spans.collect()
    ]
    inside = reduce(lambda a, b: a | b, within, F.lit(False))
    return existing.where(inside).join(hours, list(PARTITION_COLUMNS), "left_semi")


def register_curated(spark: SparkSession, table: str, root: str, hours: Sequence[Row] | None = None) -> None:
    """Make ``table`` an external table over ``root`` and add its new partitions.

    With the ``hours`` a refresh touched only those are looked at; without, the catalogue
    looks for partitions under the whole root.
    """
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CURATED.fields)
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet "
            f"PARTITIONED BY ({', '.join(PARTITION_COLUMNS)}) LOCATION '{root}'"
        )
        hours = None
    if hours is None:
        spark.sql(f"MSCK REPAIR TABLE {table}")
        return
    for first in range(0, len(hours), 200):
        added = " ".join(
            "PARTITION (" + ", ".join(f"{c}='{hour[c]}'" for c in PARTITION_COLUMNS) + ")" for hour in hours[first : first + 200]
        )
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")
    spark.catalog.refreshTable(table)


def empty_curated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CURATED)


def limit_resources(df: DataFrame, resource_ids: Sequence[str] | DataFrame | None) -> DataFrame:
    """Keep the named resources; ``None`` or an empty list keeps all.

    A list is for the few ids of one request; a table of ids (any size) is
    joined as a left-semi join.
    """
    if resource_ids is None:
        return df
    if isinstance(resource_ids, DataFrame):
        return df.join(resource_ids.select("resource_id"), "resource_id", "left_semi")
    if not resource_ids:
        return df
    for resource_id in resource_ids:
        check_resource_id(resource_id)
    return df.where(F.col("resource_id").isin(list(resource_ids)))


def scope(
    curated: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    start: str | date | None = None,
    end: str | date | None = None,
    resource_ids: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """Rows of one account, one region and an inclusive range of days.

    ``start`` alone is that day, ``end`` alone everything up to it, neither the whole
    history. The filters compare the bare partition columns, so they prune directories.
    Resource ids repeat across regions, and reports group by id: more than one region is
    refused, run the report once for each.
    """
    regions = {region} if isinstance(region, str) else set(region)
    if len(regions) != 1:
        raise ValueError("a report covers one region: resource ids repeat across regions")
    (only,) = regions
    scoped = curated.where(
        (F.col("account_id") == check_account_id(account_id)) & (F.col("region") == check_region(only))
    )
    if start is not None:
        first = check_date(start)
        last = check_date(end) if end is not None else first
        scoped = scoped.where(F.col("date") == first if first == last else F.col("date").between(first, last))
    elif end is not None:
        scoped = scoped.where(F.col("date") <= check_date(end))
    return limit_resources(scoped, resource_ids)
