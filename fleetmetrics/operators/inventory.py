"""Inventory joins: roles, availability, load-enabled split, cluster extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import INSTANCES


def attach_roles(instances: DataFrame, members: DataFrame) -> DataFrame:
    """Give each instance its cluster role, and its cluster when it names none itself.

    An instance listed by several clusters takes the last listing.
    """
    listing = F.struct("cluster_ordinal", "member_pos")
    roles = (
        members.where(F.col("identifier") != "")
        .groupBy("account_id", "region", "identifier")
        .agg(
            F.max_by("cluster_identifier", listing).alias("member_of"),
            F.max_by("role", listing).alias("member_role"),
        )
    )
    joined = instances.drop("cluster_role").join(roles, ["account_id", "region", "identifier"], "left")
    own = F.nullif(F.col("cluster_identifier"), F.lit(""))
    # A listing under a cluster without a name still counts as a listing: "".
    listed = F.when(F.col("member_role").isNotNull(), F.coalesce("member_of", F.lit("")))
    return joined.withColumns(
        {"cluster_identifier": F.coalesce(own, listed), "cluster_role": F.col("member_role")}
    ).select(*INSTANCES.fieldNames())


def available(resources: DataFrame) -> DataFrame:
    """Resources that have an id and are in status ``available``."""
    return resources.where((F.col("identifier") != "") & (F.col("status") == "available"))


def load_enabled_split(requested: DataFrame, instances: DataFrame) -> DataFrame:
    """Every requested id with its load-source id, or NULL when it has none.

    ``has_load`` is true for a known instance with load collection switched on
    and a load-source id; unknown ids count as without. Ids repeat across accounts and
    regions: they are matched by ``account_id`` and ``region`` too where ``requested``
    carries them, otherwise limit ``instances`` to one. Of several listings the first counts.
    """
    on = [*[k for k in ("account_id", "region") if k in requested.columns], "resource_id"]
    enabled = (
        instances.where(F.col("performance_insights_enabled") & (F.col("dbi_resource_id") != ""))
        .withColumn("resource_id", F.col("identifier"))
        .groupBy(*on)
        .agg(F.min(F.struct("ordinal", "dbi_resource_id")).alias("first"))
        .select(*on, "first.dbi_resource_id")
    )
    return requested.join(enabled, on, "left").withColumn(
        "has_load", F.col("dbi_resource_id").isNotNull()
    )


def extend_with_clusters(
    ids: DataFrame, instances: DataFrame, keys: tuple[str, ...] = ("account_id", "region")
) -> DataFrame:
    """Add the cluster of each id to the set: distinct ids, per group of ``keys``.

    Volume use is published per cluster, so storage and month reports need the
    clusters of their instances in scope. Ids repeat across accounts and regions, so they
    bring these keys; where one account and region is meant anyway, limit ``instances`` to it
    and pass ``keys=()``.
    """
    missing = [k for k in keys if k not in ids.columns]
    if missing:
        raise ValueError(f"ids need the columns {missing}, or limit the instances and pass keys=()")
    clusters = instances.where(F.col("cluster_identifier") != "").select(
        *[k for k in keys if k in instances.columns],
        F.col("identifier").alias("resource_id"),
        "cluster_identifier",
    )
    on = [*[k for k in keys if k in instances.columns], "resource_id"]
    pairs = ids.select(*keys, "resource_id").distinct()
    added = pairs.join(clusters, on).select(*keys, F.col("cluster_identifier").alias("resource_id"))
    return pairs.unionByName(added).distinct()
