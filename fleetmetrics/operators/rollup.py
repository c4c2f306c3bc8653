"""Daily states of every metric: what reports over days add up instead of samples.

A state holds the count, the exact sums of the values and of their squares, the least and the
greatest value of one day, resource, engine, role and metric. All of it adds up in any order and
loses nothing, so a report over states equals the report over samples to the last digit. A day
has at most 288 samples of a metric at the usual cadence and one state.

States are kept by day: a refresh makes those of the days it touched anew, all others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from ..functions import exact
from ..functions.calendar import month_of
from ..sources.published import partition_filter
from .metrics import Stats, finished_stats, merged_states
from .monthly import active_days

KEYS = ("account_id", "region", "date", "resource_id", "engine", "cluster_role", "metric_name")
#: Folders of the rollup; a refresh replaces whole ones.
FOLDERS = ("account_id", "region", "date")
_WIDE = "DECIMAL(38,0)"


def daily_states(curated: DataFrame) -> DataFrame:
    """One state for each key; the parts are named as those of single values are."""
    parted = exact.with_product_parts(exact.with_parts(curated, "_part", "value"), "_square", "value", "value")
    sums = exact.sums("_part", "_part") + exact.sums("_square", "_square")
    extremes = ["count(value) AS n", "min(value) AS low", "max(value) AS high"]
    grouped = parted.groupBy(*KEYS).agg(*map(F.expr, sums + extremes))
    whole = {f"{s}_{i}": f"CAST({s}_{i} AS {_WIDE})" for s in ("_part", "_square") for i in range(exact.LIMBS)}
    return grouped.withColumns({name: F.expr(sql) for name, sql in whole.items()})


def write_states(states: DataFrame, root: str) -> None:
    """Replace the days that occur in ``states``; an ordinary day is one file."""
    (
        states.hint("rebalance", *FOLDERS)
        .sortWithinPartitions(*FOLDERS, "resource_id", "metric_name")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*FOLDERS)
        .parquet(root)
    )


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """The states under ``root``, with the types :func:`daily_states` gave them."""
    parts = ", ".join(
        f"{s}_{i} {'DOUBLE' if i == 'x' else _WIDE}" for s in ("_part", "_square") for i in (*range(exact.LIMBS), "x")
    )
    schema = (
        "resource_id STRING, engine STRING, cluster_role STRING, metric_name STRING, "
        f"{parts}, n BIGINT, low DOUBLE, high DOUBLE, account_id STRING, region STRING, date DATE"
    )
    return spark.read.schema(schema).parquet(root)


def refresh_days(spark: SparkSession, table: str, root: str, hours: Sequence[Row]) -> None:
    """Make the states of the days of ``hours`` anew from the published table."""
    if not hours:
        return
    days = sorted({tuple(h[c] for c in FOLDERS) for h in hours})
    write_states(daily_states(spark.table(table).where(partition_filter(days, FOLDERS))), root)


def wide_stats_of_states(states: DataFrame, keys: Sequence[str], stats: Stats, *extra: Column) -> DataFrame:
    """What ``wide_stats`` gives for the samples behind ``states``."""
    sums = merged_states(stats)
    grouped = states.groupBy(*keys).agg(*extra, *map(F.expr, sums))
    return finished_stats(grouped, stats, *grouped.columns[: len(grouped.columns) - len(sums)])


def monthly_of_states(scoped: DataFrame, stats: Stats) -> DataFrame:
    """The rows of ``monthly_aggregate`` from daily states."""
    months = scoped.withColumn("month", month_of(F.col("date")))
    return wide_stats_of_states(months, ("resource_id", "month", "engine", "cluster_role"), stats, active_days())
