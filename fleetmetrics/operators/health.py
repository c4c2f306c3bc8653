"""Day health, live health, trailing baseline and their comparison."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..catalog import BASELINE_STATS, HEALTH_STATS, LIVE_STATS, stat_columns
from ..functions.rounding import sql_round
from ..functions.timestamps import utc_literal
from ..functions.validators import check_lookback_minutes
from .metrics import wide_stats

HEALTH_KEYS = ("resource_id", "engine", "cluster_role")

# Current column, baseline mean, baseline deviation, output.
DEVIATIONS = (
    ("cpu_avg", "cpu_avg_baseline", "cpu_stddev_baseline", "cpu_deviation"),
    ("connections_avg", "connections_avg_baseline", "connections_stddev_baseline", "connections_deviation"),
)


def health_snapshot(scoped: DataFrame) -> DataFrame:
    """Twelve statistics per (resource, engine, role) over the scoped rows.

    The curated table holds one collection statistic per metric, so a maximum
    here is the largest of the collected values.
    """
    return wide_stats(scoped, HEALTH_KEYS, HEALTH_STATS)


def baseline(scoped: DataFrame) -> DataFrame:
    """Thirteen statistics per resource over a trailing window."""
    return wide_stats(scoped, ("resource_id",), BASELINE_STATS)


def live_rows(curated: DataFrame, as_of: datetime, lookback_minutes: int) -> DataFrame:
    """Rows sampled in the last ``lookback_minutes`` up to and including ``as_of`` (UTC)."""
    check_lookback_minutes(lookback_minutes)
    start = as_of - timedelta(minutes=lookback_minutes)
    sampled = F.col("metric_timestamp")
    return curated.where(
        F.col("date").between(start.date(), as_of.date())
        & (sampled > utc_literal(start))
        & (sampled <= utc_literal(as_of))
    )


def live_window(curated: DataFrame, as_of: datetime, lookback_minutes: int) -> DataFrame:
    """The snapshot's columns per resource over a short window ending at ``as_of``."""
    return wide_stats(live_rows(curated, as_of, lookback_minutes), ("resource_id",), LIVE_STATS)


def requested_table(df: DataFrame, resource_ids: Sequence[str]) -> DataFrame:
    """Requested ids as rows (position, resource_id) in request order."""
    return df.sparkSession.createDataFrame(
        list(enumerate(resource_ids)), "position long, resource_id string"
    )


def fill_requested(requested: DataFrame, stats: DataFrame) -> DataFrame:
    """A row for every requested id, measured or not."""
    return requested.join(stats, "resource_id", "left")


def has_any_data(df: DataFrame) -> DataFrame:
    """Flag rows in which at least one health statistic is present."""
    return df.withColumn("has_data", F.coalesce(*stat_columns(HEALTH_STATS)).isNotNull())


def with_baseline(rows: DataFrame, baseline_rows: DataFrame) -> DataFrame:
    """Attach each resource's own baseline and the deviation from it.

    A resource without history keeps its row; its baseline and deviation are
    NULL, as is the deviation where the baseline does not vary.
    """
    joined = rows.join(baseline_rows, "resource_id", "left")
    return joined.withColumns(
        {
            out: F.when(F.col(spread) > 0, sql_round((F.col(now) - F.col(mean)) / F.col(spread), 4))
            for now, mean, spread, out in DEVIATIONS
        }
    )
