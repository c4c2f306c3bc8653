"""Inventory and target sources: describe-page dumps to flat tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.validators import check_account_id
from ..operators.inventory import attach_roles
from ..schemas import CLUSTER_MEMBERS, CLUSTER_PAGE, CLUSTERS, INSTANCE_PAGE, INSTANCES, TARGETS


def read_cluster_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Dumped cluster pages, one JSON document per file, or JSON lines without ``multi_line``."""
    return _read_pages(spark, path, CLUSTER_PAGE, multi_line)


def read_instance_pages(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return _read_pages(spark, path, INSTANCE_PAGE, multi_line)


def _read_pages(spark: SparkSession, path: str, schema: Any, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("multiLine", str(multi_line).lower())
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .json(path)
    )


def _entries(pages: DataFrame, listing: str, entry: str) -> DataFrame:
    """Exploded page entries with their place in the whole listing.

    An array holds fewer than 2**31 entries, so places of different pages never meet. A
    dump of several pages must number them; one without a number counts as page 0.
    """
    place = F.shiftleft(F.coalesce("page_number", F.lit(0)).cast("long"), 31) + F.col("pos")
    return pages.select(
        "account_id", "region", "page_number", F.posexplode(listing).alias("pos", entry)
    ).withColumn("ordinal", place)


def clusters_from_pages(pages: DataFrame) -> DataFrame:
    """One row per described cluster."""
    return _entries(pages, "DBClusters", "c").select(
        "account_id",
        "region",
        "ordinal",
        F.col("c.DBClusterIdentifier").alias("identifier"),
        F.col("c.Engine").alias("engine"),
        F.col("c.EngineVersion").alias("engine_version"),
        F.col("c.Status").alias("status"),
    ).select(*CLUSTERS.fieldNames())


def members_from_pages(pages: DataFrame) -> DataFrame:
    """One row per cluster member, with its role."""
    writer = F.coalesce("m.IsClusterWriter", F.lit(False))
    return (
        _entries(pages, "DBClusters", "c")
        .select(
            "account_id",
            "region",
            F.col("ordinal").alias("cluster_ordinal"),
            F.col("c.DBClusterIdentifier").alias("cluster_identifier"),
            F.posexplode("c.DBClusterMembers").alias("member_pos", "m"),
        )
        .select(
            "account_id",
            "region",
            "cluster_ordinal",
            "cluster_identifier",
            F.col("member_pos").cast("long").alias("member_pos"),
            F.col("m.DBInstanceIdentifier").alias("identifier"),
            F.when(writer, "writer").otherwise("reader").alias("role"),
            F.col("m.PromotionTier").alias("promotion_tier"),
        )
        .select(*CLUSTER_MEMBERS.fieldNames())
    )


def instances_from_pages(pages: DataFrame, members: DataFrame) -> DataFrame:
    """One row per described instance, with cluster and role joined from the members."""
    entries = _entries(pages, "DBInstances", "i")
    flat = entries.select(
        "account_id",
        "region",
        "ordinal",
        F.col("i.DBInstanceIdentifier").alias("identifier"),
        F.col("i.DbiResourceId").alias("dbi_resource_id"),
        F.col("i.Engine").alias("engine"),
        F.col("i.EngineVersion").alias("engine_version"),
        F.col("i.DBInstanceClass").alias("instance_class"),
        F.col("i.AvailabilityZone").alias("availability_zone"),
        F.col("i.DBInstanceStatus").alias("status"),
        F.coalesce("i.MultiAZ", F.lit(False)).alias("multi_az"),
        F.col("i.StorageType").alias("storage_type"),
        F.coalesce("i.PerformanceInsightsEnabled", F.lit(False)).alias("performance_insights_enabled"),
        F.col("i.DBClusterIdentifier").alias("cluster_identifier"),
        F.lit(None).cast("string").alias("cluster_role"),
    )
    return attach_roles(flat.select(*INSTANCES.fieldNames()), members)


def _text(entry: Mapping[str, Any], key: str, section: str) -> str:
    value = entry.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{section}.{key} must be a non-empty string")
    return value.strip()


def targets_table(spark: SparkSession, entries: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Configured targets as a table; every entry is checked first."""
    rows = []
    for number, entry in enumerate(entries, start=1):
        section = f"targets[{number}]"
        enabled = entry.get("enabled", True)
        if not isinstance(enabled, bool):
            raise ValueError(f"{section}.enabled must be a boolean")
        regions = entry.get("regions")
        if (
            not isinstance(regions, list)
            or not regions
            or any(not isinstance(r, str) or not r.strip() for r in regions)
        ):
            raise ValueError(f"{section}.regions must be a non-empty list of strings")
        rows.append(
            (
                _text(entry, "name", section),
                check_account_id(_text(entry, "account_id", section)),
                _text(entry, "role_name", section),
                [r.strip() for r in regions],
                enabled,
            )
        )
    if not rows:
        raise ValueError("At least one target is required")
    return spark.createDataFrame(rows, TARGETS)


def enabled_targets(targets: DataFrame) -> DataFrame:
    return targets.where("enabled")


def query_targets(targets: DataFrame) -> DataFrame:
    """(target_name, account_id, region): where requests about an enabled target look, its first region."""
    return enabled_targets(targets).select(
        F.col("name").alias("target_name"), "account_id", F.get("regions", F.lit(0)).alias("region")
    )


def target_regions(targets: DataFrame) -> DataFrame:
    """One row per enabled target and region."""
    return enabled_targets(targets).select(
        F.col("name").alias("target_name"), "account_id", "role_name", F.explode("regions").alias("region")
    )
