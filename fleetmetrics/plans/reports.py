"""The reports: each is one declarative plan over the curated or load table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import default_report_month, month_bounds, previous_month
from ..functions.validators import check_date
from ..operators.health import (
    baseline,
    fill_requested,
    has_any_data,
    health_snapshot,
    live_window,
    requested_table,
    with_baseline,
)
from ..operators.inventory import load_enabled_split
from ..operators.monthly import compare_months, monthly_aggregate, with_notable
from ..operators.storage import storage_forecast as forecast_lines
from ..operators.storage import rolling_forecast, storage_history, with_gib
from ..operators.topsql import (
    attach_findings,
    average_load,
    load_window,
    normalize_findings,
    top_statements,
    total_load,
    with_share,
)
from ..sources.curated import empty_curated, scope

# Days of a whole history are counted from here, whatever its first day.
HISTORY_ANCHOR = date(1990, 1, 1)

Ids = Sequence[str] | DataFrame | None


def trailing_baseline(
    curated: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    day: str | date,
    resource_ids: Ids = None,
    baseline_days: int = 7,
) -> DataFrame:
    """Baseline over ``day - baseline_days`` .. ``day``, both included."""
    last = check_date(day)
    return baseline(
        scope(curated, account_id, region, last - timedelta(days=baseline_days), last, resource_ids)
    )


def health_on_date(
    curated: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    day: str | date,
    resource_ids: Ids = None,
    baseline_days: int = 7,
    history: DataFrame | None = None,
) -> DataFrame:
    """Day health of every resource next to its own trailing baseline.

    ``history`` is the table the baseline comes from when it is not ``curated``
    itself; an empty one leaves the baseline columns NULL.
    """
    snapshot = health_snapshot(scope(curated, account_id, region, day, None, resource_ids))
    past = trailing_baseline(
        curated if history is None else history, account_id, region, day, resource_ids, baseline_days
    )
    return with_baseline(snapshot, past).orderBy("resource_id")


def live_health(
    curated: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    resource_ids: Sequence[str] | DataFrame,
    as_of: datetime,
    lookback_minutes: int = 30,
    baseline_days: int = 7,
    history: DataFrame | None = None,
) -> DataFrame:
    """Recent health of each requested id, in ``position`` order, with its baseline.

    ``resource_ids`` is a list, or a table with ``position`` and ``resource_id``.
    Ids without data keep a row with ``has_data`` false.
    """
    requested = (
        resource_ids if isinstance(resource_ids, DataFrame) else requested_table(curated, resource_ids)
    )
    start = as_of - timedelta(minutes=lookback_minutes)
    recent = scope(curated, account_id, region, start.date(), as_of.date(), resource_ids)
    stats = live_window(recent, as_of, lookback_minutes)
    past = trailing_baseline(
        curated if history is None else history,
        account_id,
        region,
        as_of.date(),
        resource_ids,
        baseline_days,
    )
    return with_baseline(has_any_data(fill_requested(requested, stats)), past).orderBy("position")


def storage_forecast(
    curated: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    as_of: str | date | None = None,
    resource_ids: Ids = None,
    days: int | None = 30,
) -> DataFrame:
    """Storage trend and exhaustion day from ``as_of - days`` .. ``as_of``, by resource.

    Without ``days`` it is the whole history up to ``as_of``, or all of it.
    """
    if days is None:
        first, last = None, as_of
    elif as_of is None:
        raise ValueError("a window of days needs as_of")
    else:
        last = check_date(as_of)
        first = last - timedelta(days=days)
    history = storage_history(scope(curated, account_id, region, first, last, resource_ids))
    return with_gib(forecast_lines(history, first or HISTORY_ANCHOR)).orderBy("resource_id")


def storage_forecasts(
    curated: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    first: str | date,
    last: str | date,
    resource_ids: Ids = None,
    days: int = 30,
) -> DataFrame:
    """The storage forecast of every day from ``first`` to ``last``, from one pass over the samples."""
    since, until = check_date(first), check_date(last)
    scoped = scope(curated, account_id, region, since - timedelta(days=days), until, resource_ids)
    forecasts = rolling_forecast(storage_history(scoped), since, until, days)
    return with_gib(forecasts).orderBy("resource_id", "as_of")


def monthly_report(
    curated: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    month: str | None = None,
    resource_ids: Ids = None,
    today: date | None = None,
) -> DataFrame:
    """Month-over-month report; both months come from one contiguous scan."""
    month = month or default_report_month(today)
    first, _ = month_bounds(previous_month(month))
    _, last = month_bounds(month)
    rows = monthly_aggregate(scope(curated, account_id, region, first, last, resource_ids))
    return with_notable(compare_months(rows, month, today)).orderBy("resource_id")


def top_sql(
    sql_load: DataFrame,
    as_of: datetime,
    lookback_minutes: int = 10,
    k: int = 10,
    resource_ids: DataFrame | None = None,
    findings: DataFrame | None = None,
    samples_in_window: int | None = None,
) -> DataFrame:
    """Ranked statements per resource with load share and, if given, findings, in that order."""
    ranked = _ranked_statements(sql_load, as_of, lookback_minutes, k, resource_ids, samples_in_window)
    if findings is not None:
        ranked = attach_findings(ranked, normalize_findings(findings))
    return ranked.orderBy("resource_id", "rank")


def _ranked_statements(
    sql_load: DataFrame,
    as_of: datetime,
    lookback_minutes: int,
    k: int,
    resource_ids: DataFrame | None,
    samples_in_window: int | None = None,
) -> DataFrame:
    samples = load_window(sql_load, as_of, lookback_minutes)
    if resource_ids is not None:
        samples = samples.join(resource_ids.select("resource_id"), "resource_id", "left_semi")
    return with_share(top_statements(average_load(samples, samples_in_window), k))


def top_sql_overview(
    sql_load: DataFrame,
    curated: DataFrame,
    instances: DataFrame,
    account_id: str,
    region: str | Sequence[str],
    resource_ids: Sequence[str] | DataFrame,
    as_of: datetime,
    lookback_minutes: int = 10,
    k: int = 10,
) -> DataFrame:
    """Each requested id: live statistics, total ranked load, and why there is none.

    ``load_status`` is ``ok``, ``no_load_data`` (enabled, nothing recorded) or
    ``not_enabled``.
    """
    requested = (
        resource_ids if isinstance(resource_ids, DataFrame) else requested_table(curated, resource_ids)
    )
    regions = [region] if isinstance(region, str) else list(region)
    own = instances.where((F.col("account_id") == account_id) & F.col("region").isin(regions))
    split = load_enabled_split(requested, own)
    start = as_of - timedelta(minutes=lookback_minutes)
    recent = scope(curated, account_id, region, start.date(), as_of.date(), resource_ids)
    stats = live_window(recent, as_of, lookback_minutes)
    totals = total_load(_ranked_statements(sql_load, as_of, lookback_minutes, k, split.where("has_load")))
    joined = split.join(totals, "resource_id", "left").join(stats, "resource_id", "left")
    return joined.withColumn(
        "load_status",
        F.when(~F.col("has_load"), "not_enabled")
        .when(F.col("ranked_statements").isNull(), "no_load_data")
        .otherwise("ok"),
    ).orderBy("position")


__all__ = [
    "empty_curated",
    "health_on_date",
    "live_health",
    "monthly_report",
    "storage_forecast",
    "storage_forecasts",
    "top_sql",
    "top_sql_overview",
    "trailing_baseline",
]
