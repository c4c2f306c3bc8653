"""Collection: what to request for a fleet, and landing what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.collection import cluster_metrics, explicit_metrics, instance_metrics, plan_rows
from ..operators.inventory import available
from ..sources.inventory import target_regions
from ..sources.raw import write_raw
from ..sources.responses import payloads
from ..catalog import PROFILE_NAME

_RESOURCE = (
    "target_name",
    "account_id",
    "region",
    "resource_dimension",
    "resource_id",
    "engine",
    "cluster_identifier",
    "cluster_role",
    "metric_profile",
    "resource_profile",
    "metrics",
)


def planned_resources(
    targets: DataFrame,
    clusters: DataFrame,
    instances: DataFrame,
    profile: str | None = PROFILE_NAME,
    metrics: list[str] | None = None,
) -> DataFrame:
    """One row per available resource in a target's regions, with its metric list.

    Clusters appear only under a profile, and only if they publish metrics of
    their own. ``metrics`` (instead of a profile) asks the same of every instance.
    """
    if (profile is None) == (not metrics):
        raise ValueError("Give either a metric profile or a metric list")
    where = target_regions(targets).select("target_name", "account_id", "region")
    selected = available(instances)
    chosen = instance_metrics(selected, profile) if profile else explicit_metrics(selected, metrics)
    instance_rows = chosen.withColumns(
        {"resource_dimension": F.lit("DBInstanceIdentifier"), "resource_id": F.col("identifier")}
    )
    planned = instance_rows.join(where, ["account_id", "region"]).select(*_RESOURCE)
    if not profile:
        return planned
    cluster_rows = (
        cluster_metrics(available(clusters), profile)
        .where(F.size("metrics") > 0)
        .withColumns(
            {
                "resource_dimension": F.lit("DBClusterIdentifier"),
                "resource_id": F.col("identifier"),
                "cluster_identifier": F.col("identifier"),
                "cluster_role": F.lit("cluster"),
            }
        )
    )
    return planned.unionByName(cluster_rows.join(where, ["account_id", "region"]).select(*_RESOURCE))


def collection_plan(
    targets: DataFrame,
    clusters: DataFrame,
    instances: DataFrame,
    profile: str | None = PROFILE_NAME,
    metrics: list[str] | None = None,
) -> DataFrame:
    """One row per metric request: resource, metric, statistic, unit."""
    return plan_rows(planned_resources(targets, clusters, instances, profile, metrics))


def collection_summary(
    targets: DataFrame, clusters: DataFrame, instances: DataFrame, plan: DataFrame, landed: DataFrame | None = None
) -> DataFrame:
    """Counts per target and region: clusters, instances, selected, requested and uploaded payloads.

    ``uploaded_count`` counts the payloads of ``landed`` (a scan of the raw layer), of the plan's
    targets only; without it, the requests of the plan, all of which a complete run uploads.
    """
    where = ["account_id", "region"]
    uploads = plan
    if landed is not None:
        account = F.coalesce(F.nullif(F.col("source_account_id"), F.lit("")), F.col("path_account_id"))
        region = F.coalesce(F.nullif(F.col("region"), F.lit("")), F.col("path_region"))
        uploads = landed.select("target_name", account.alias("account_id"), region.alias("region"))
    return (
        target_regions(targets)
        .join(clusters.groupBy(*where).agg(F.count("*").alias("cluster_count")), where, "left")
        .join(
            instances.groupBy(*where).agg(
                F.count("*").alias("instance_count"),
                F.count_if((F.col("identifier") != "") & (F.col("status") == "available")).alias(
                    "selected_instance_count"
                ),
            ),
            where,
            "left",
        )
        .join(
            uploads.groupBy("target_name", *where).agg(F.count("*").alias("uploaded_count")),
            ["target_name", *where],
            "left",
        )
        .select(
            "target_name",
            *where,
            *[
                F.coalesce(c, F.lit(0)).alias(c)
                for c in ("cluster_count", "instance_count", "selected_instance_count", "uploaded_count")
            ],
        )
    )


def resource_metric_counts(planned: DataFrame) -> DataFrame:
    """Per planned resource: how many metrics are asked for."""
    return planned.select("*", F.size("metrics").alias("metric_count"))


def land_responses(requests: DataFrame, pages: DataFrame, raw_root: str, compressed: bool = False) -> None:
    """Turn response pages into raw payloads and append them to the raw layer."""
    write_raw(payloads(requests, pages), raw_root, compressed)
