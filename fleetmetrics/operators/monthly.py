"""Two-month aggregate and the month-over-month pairing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import COMPARED_COLUMNS, MONTHLY_STATS, stat_columns
from ..functions.calendar import month_day_count, month_of, previous_month, report_today
from ..functions.rounding import even_round
from .metrics import wide_stats

PARTIAL_COVERAGE_RATIO = 0.5
NOTABLE_CHANGE_PCT = 10


def active_days() -> Column:
    """Distinct days of a one-month group, as the population of a 31-bit set.

    Days of one month fit in an integer, so the distinct count is an ordinary
    mergeable aggregate: no second shuffle and no set per group.
    """
    day_bit = F.expr("shiftleft(1, dayofmonth(date) - 1)")
    return F.bit_count(F.bit_or(day_bit)).alias("active_days")


def monthly_aggregate(scoped: DataFrame) -> DataFrame:
    """Thirteen statistics and the active days per resource, month, engine, role."""
    months = scoped.withColumn("month", month_of(F.col("date")))
    return wide_stats(
        months, ("resource_id", "month", "engine", "cluster_role"), MONTHLY_STATS, active_days()
    )


def change_pct(current: Column, prior: Column) -> Column:
    """Percent change, unrounded; NULL when either is missing or prior is 0."""
    return F.when(prior != 0, (current - prior) / F.abs(prior) * 100)


def coverage_note(days: Column, days_in_month: int, in_progress: bool) -> Column:
    note = F.when(days == 0, "no_data")
    if in_progress:
        return note.otherwise("month_in_progress")
    return note.when(days < days_in_month * PARTIAL_COVERAGE_RATIO, "partial_month")


def compare_months(rows: DataFrame, month: str, today: date | None = None) -> DataFrame:
    """Pair each resource's ``month`` with the month before it.

    One conditional aggregate stands for the full outer join: a resource seen
    in either month gets a row. Where a resource changed role or engine inside
    a month, the row with the most active days speaks for it (then the
    greatest role, then the greatest engine).
    """
    prior_month = previous_month(month)
    days_in_month = month_day_count(month)
    in_progress = f"{today or report_today():%Y-%m}" == month
    stats = stat_columns(MONTHLY_STATS)
    payload = F.struct("active_days", "engine", "cluster_role", *stats)
    weight = F.struct("active_days", "cluster_role", "engine")

    def chosen(which: str) -> Column:
        return F.max_by(
            F.when(F.col("month") == which, payload), F.when(F.col("month") == which, weight)
        )

    paired = (
        rows.where(F.col("month").isin(month, prior_month) & (F.col("resource_id") != ""))
        .groupBy("resource_id")
        .agg(chosen(month).alias("now"), chosen(prior_month).alias("prev"))
    )
    days = F.coalesce("now.active_days", F.lit(0)).cast("int")

    def either(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"now.{name}"), F.lit("")), F.col(f"prev.{name}"))

    compared: list[Column] = []
    for column in stats:
        now, prev = F.col(f"now.{column}"), F.col(f"prev.{column}")
        compared.append(now.alias(column))
        if column in COMPARED_COLUMNS:
            compared.append(prev.alias(f"{column}_previous"))
            compared.append(change_pct(now, prev).alias(f"{column}_change_pct"))
    report = paired.select(
        "resource_id",
        F.lit(month).alias("month"),
        F.lit(prior_month).alias("previous_month"),
        either("engine").alias("engine"),
        either("cluster_role").alias("cluster_role"),
        days.alias("active_days"),
        F.lit(days_in_month).alias("days_in_month"),
        F.coalesce("prev.active_days", F.lit(0)).cast("int").alias("previous_active_days"),
        coverage_note(days, days_in_month, in_progress).alias("coverage_note"),
        *compared,
    )
    # Rounded in a second step: one reference per value keeps the plan small.
    return report.withColumns(
        {f"{c}_change_pct": even_round(F.col(f"{c}_change_pct"), 1) for c in COMPARED_COLUMNS}
    )


def with_notable(report: DataFrame) -> DataFrame:
    """Add ``<column>_notable``: a change of ten percent or more; NULL = no comparison."""
    return report.withColumns(
        {
            f"{column}_notable": F.abs(F.col(f"{column}_change_pct")) >= NOTABLE_CHANGE_PCT
            for column in COMPARED_COLUMNS
        }
    )
