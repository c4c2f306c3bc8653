"""Keep the latest collection of every metric sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .flatten import POSITION

SAMPLE_KEY = ("account_id", "region", "resource_id", "metric_name", "metric_timestamp")


def deduplicate(rows: DataFrame) -> DataFrame:
    """One row per sample key: greatest ``collected_at``, first seen on a tie.

    "First seen" is the order of sorted file paths, compared segment by
    segment, then the position inside the file. Catalyst places a rank-1 group
    limit in front of the shuffle, so however many copies one key has, each map
    task sends at most one of them.
    """
    first_seen = [F.split("source_file", "/").asc()]
    if POSITION in rows.columns:
        first_seen.append(F.col(POSITION).asc())
    latest = Window.partitionBy(*SAMPLE_KEY).orderBy(F.col("collected_at").desc(), *first_seen)
    return (
        rows.withColumn("_rank", F.row_number().over(latest))
        .where(F.col("_rank") == 1)
        .drop("_rank", POSITION)
    )


def merge_hours(fresh: DataFrame, existing: DataFrame | None) -> DataFrame:
    """De-duplicated new rows together with what their hours already hold."""
    if existing is None:
        return fresh
    return deduplicate(fresh.unionByName(existing.select(*fresh.columns)))
