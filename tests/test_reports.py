from __future__ import annotations

import statistics
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fleetmetrics import health_on_date, live_health, monthly_report, sliding_health, storage_forecast
from fleetmetrics.functions.text import forecast_line, health_line, monthly_line
from fleetmetrics.operators.monthly import compare_months, monthly_aggregate
from fleetmetrics.operators.storage import storage_forecast as forecast_lines
from fleetmetrics.operators.storage import storage_history, with_gib
from fleetmetrics.plans import reports
from fleetmetrics.sources.curated import empty_curated

from .helpers import ACCOUNT, REGION, at, curated, history, rows_of

GB = 1024**3


# ---- day health -----------------------------------------------------------


def _week(spark):
    samples = []
    for day in range(13, 21):
        for hour in range(3):
            ts = at(f"2026-08-{day}T0{hour}:00:00")
            samples.append(("a", "mysql", "writer", "CPUUtilization", ts, 10 + day + hour))
            samples.append(("flat", "mysql", None, "CPUUtilization", ts, 5))
    samples.append(("a", "mysql", "reader", "DatabaseConnections", at("2026-08-20T05:00:00"), 7))
    samples.append(("other", "mysql", "writer", "ReadThroughput", at("2026-08-20T05:00:00"), 7))
    return curated(spark, samples)


def test_day_health_and_baseline(spark):
    rows = {
        (r.resource_id, r.cluster_role): r
        for r in health_on_date(_week(spark), ACCOUNT, REGION, "2026-08-20").collect()
    }
    writer = rows["a", "writer"]
    values = [10 + d + h for d in range(13, 21) for h in range(3)]
    assert (writer.cpu_avg, writer.cpu_max, writer.connections_avg) == (31.0, 32.0, None)
    assert writer.cpu_avg_baseline == round(sum(values) / len(values), 4)
    assert writer.cpu_stddev_baseline == round(statistics.stdev(values), 4)
    assert writer.cpu_deviation == pytest.approx((31 - writer.cpu_avg_baseline) / writer.cpu_stddev_baseline, abs=1e-4)
    # The baseline is per resource: both rows of a role change carry it.
    assert rows["a", "reader"].cpu_avg_baseline == writer.cpu_avg_baseline
    # One sample has no deviation, and neither has a constant history.
    assert rows["a", "reader"].connections_stddev_baseline is None
    assert rows["flat", None].cpu_stddev_baseline == 0.0 and rows["flat", None].cpu_deviation is None
    # A resource with unrelated metrics only still has its row.
    assert rows["other", "writer"].cpu_avg is None


def test_health_without_history_keeps_rows(spark):
    df = health_on_date(_week(spark), ACCOUNT, REGION, "2026-08-20", history=empty_curated(spark))
    rows = df.collect()
    assert len(rows) == 4 and all(r.cpu_avg_baseline is None and r.cpu_deviation is None for r in rows)
    text = {r.resource_id: r.line for r in health_line(df.where("cluster_role = 'writer'")).collect()}
    assert "cpu_avg=31.0, cpu_max=32.0, freeable_memory_min_bytes=None" in text["a"]
    assert "baseline" not in text["a"]


def test_health_for_named_resources_only(spark):
    week = _week(spark)
    assert rows_of(health_on_date(week, ACCOUNT, REGION, "2026-08-20", ["flat"]), "resource_id") == [("flat",)]
    assert health_on_date(week, ACCOUNT, REGION, "2026-08-20", []).count() == 4
    ids = spark.createDataFrame([("flat",), ("nobody",)], "resource_id string")
    assert rows_of(health_on_date(week, ACCOUNT, REGION, "2026-08-20", ids), "resource_id") == [("flat",)]
    with pytest.raises(ValueError):
        health_on_date(week, ACCOUNT, REGION, "2026-08-20", ["a'; --"])


# ---- live health ----------------------------------------------------------


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul"])
def test_live_health_has_a_row_for_every_requested_id_in_order(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _check_live_health(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _check_live_health(spark):
    now = at("2026-08-20T12:00:00")
    data = curated(
        spark,
        [
            ("a", "mysql", "writer", "CPUUtilization", now, 50),
            ("a", "mysql", "writer", "CPUUtilization", now - timedelta(minutes=29), 40),
            ("a", "mysql", "writer", "CPUUtilization", now - timedelta(minutes=30), 1000),
            ("a", "mysql", "writer", "CPUUtilization", now + timedelta(seconds=1), 1000),
        ],
    )
    rows = live_health(data, ACCOUNT, REGION, ["c", "a"], now).orderBy("position").collect()
    assert [(r.resource_id, r.has_data, r.cpu_avg, r.cpu_max) for r in rows] == [
        ("c", False, None, None),
        ("a", True, 45.0, 50.0),
    ]
    with pytest.raises(ValueError):
        live_health(data, ACCOUNT, REGION, ["a"], now, lookback_minutes=1441)


def test_sliding_health_stream_equals_batch(spark, tmp_path):
    start = at("2026-08-20T12:00:00")
    samples = [
        (f"r{i % 2}", "mysql", "writer", "CPUUtilization", start + timedelta(minutes=3 * i), i) for i in range(30)
    ]
    data = curated(spark, samples)
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    query = (
        sliding_health(stream)
        .writeStream.format("memory")
        .queryName("sliding_health_test")
        .outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    columns = ("window_start", "window_end", "resource_id", "cpu_avg", "cpu_max")
    expected = rows_of(sliding_health(data), *columns)
    assert rows_of(spark.table("sliding_health_test"), *columns) == expected
    first = [r for r in expected if r[0] == start and r[2] == "r0"][0]
    inside = [i for i in range(0, 30, 2) if 3 * i < 30]
    assert first[3:] == (sum(inside) / len(inside), max(inside))


# ---- storage --------------------------------------------------------------


def _days(values, start="2026-08-01", used=False):
    first = date.fromisoformat(start)
    return [
        ("db", (first + timedelta(days=i)).isoformat(), None if used else v, v if used else None)
        for i, v in enumerate(values)
    ]


def _forecast(spark, rows, **kwargs):
    return with_gib(forecast_lines(history(spark, rows), **kwargs)).collect()


@pytest.mark.parametrize("anchor", [date(1970, 1, 1), date(2026, 8, 1)])
def test_shrinking_space_gets_its_zero_day(spark, anchor):
    [row] = _forecast(spark, _days([g * 1e9 for g in (500, 490, 480, 470, 460)]), anchor=anchor)
    assert (row.history_days, row.days_until_exhaustion) == (5, 46)
    assert row.projected_exhaustion_date == date(2026, 9, 20)
    assert row.trend_bytes_per_day == -10e9 and row.forecast_note is None
    assert row.latest_value_gb == round(460e9 / GB, 2) and row.trend_gb_per_day == round(-10e9 / GB, 4)


def test_stable_space_has_no_zero_day(spark):
    [row] = _forecast(spark, _days([500.0, 500.0, 501.0, 500.0, 500.0]))
    assert row.trend_bytes_per_day >= 0 and row.projected_exhaustion_date is None


def test_two_points_are_not_enough(spark):
    [row] = _forecast(spark, _days([500.0, 490.0]))
    assert (row.forecast_note, row.trend_bytes_per_day, row.days_until_exhaustion) == ("insufficient_history", None, None)


def test_points_without_any_value_do_not_count(spark):
    assert _forecast(spark, [("db", "2026-08-01", None, None)]) == []


@pytest.mark.parametrize("step", [10e9, -10e9])
def test_cluster_volume_never_runs_out(spark, step):
    [row] = _forecast(spark, _days([500e9 + step * i for i in range(5)], used=True))
    assert row.storage_metric == "VolumeBytesUsed" and row.trend_bytes_per_day == step
    assert row.projected_exhaustion_date is None and row.days_until_exhaustion is None


def test_passed_zero_is_today_and_far_zero_has_no_date(spark):
    [row] = _forecast(spark, _days([100.0, 1.0, 0.0, 0.0]))
    assert row.days_until_exhaustion >= 0
    [row] = _forecast(spark, _days([1e13, 1e13 - 1, 1e13 - 2, 1e13 - 3]))
    assert row.days_until_exhaustion > 1e12 and row.projected_exhaustion_date is None


def test_forecast_matches_plain_least_squares(spark):
    values = [9e12, 8.9e12, 8.75e12, 8.8e12, 8.4e12, 8.39e12, 8.1e12]
    [row] = _forecast(spark, _days(values))
    xs = list(range(len(values)))
    mx, my = sum(xs) / len(xs), sum(values) / len(values)
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, values)) / sum((x - mx) ** 2 for x in xs)
    assert row.trend_bytes_per_day == pytest.approx(slope, rel=1e-12)
    assert row.days_until_exhaustion == round(-(my - slope * mx) / slope - xs[-1])


def test_history_takes_lowest_free_and_highest_used(spark):
    day = [at(f"2026-08-20T0{h}:00:00") for h in range(3)]
    data = curated(
        spark,
        [("i", "mysql", None, "FreeStorageSpace", ts, v) for ts, v in zip(day, (5, 3, 4))]
        + [("c", "aurora", "cluster", "VolumeBytesUsed", ts, v) for ts, v in zip(day, (5, 9, 4))]
        + [("x", "mysql", None, "CPUUtilization", day[0], 1)],
    )
    assert rows_of(storage_history(data), "resource_id", "free_storage_space_bytes", "volume_bytes_used") == [
        ("c", None, 9.0),
        ("i", 3.0, None),
    ]
    forecast = storage_forecast(data, ACCOUNT, REGION, "2026-08-20", ["i"])
    assert forecast_line(forecast).first().line == (
        "resource_id=i, storage_metric=FreeStorageSpace, history_days=1, latest_date=2026-08-20, "
        "latest_value_gb=0.0, trend_gb_per_day=None, projected_exhaustion_date=None, "
        "days_until_exhaustion=None, forecast_note=insufficient_history"
    )


# ---- month over month -----------------------------------------------------


def _month_rows(spark, samples):
    return monthly_aggregate(
        curated(spark, [(r, e, role, m, at(f"{d}T0{h}:00:00"), v) for r, e, role, m, d, h, v in samples])
    )


def _month(resource, month, metric, value, days=20, engine="mysql", role="writer"):
    return [(resource, engine, role, metric, f"{month}-{d:02d}", 1, value) for d in range(1, days + 1)]


TODAY = date(2026, 9, 10)


def _compare(spark, samples, month="2026-08", today=TODAY):
    return {r.resource_id: r for r in compare_months(_month_rows(spark, samples), month, today).collect()}


def test_month_change(spark):
    samples = (
        _month("a", "2026-07", "CPUUtilization", 40) + _month("a", "2026-08", "CPUUtilization", 44)
        + _month("a", "2026-07", "DatabaseConnections", 120) + _month("a", "2026-08", "DatabaseConnections", 60)
        + _month("a", "2026-06", "CPUUtilization", 1)
    )
    row = _compare(spark, samples)["a"]
    assert (row.cpu_avg, row.cpu_avg_previous, row.cpu_avg_change_pct) == (44.0, 40.0, 10.0)
    assert row.connections_avg_change_pct == -50.0
    assert (row.month, row.previous_month, row.days_in_month, row.active_days) == ("2026-08", "2026-07", 31, 20)
    assert row.coverage_note is None


def test_new_and_retired_resources_have_rows(spark):
    samples = _month("new", "2026-08", "CPUUtilization", 1) + _month("old", "2026-07", "CPUUtilization", 2)
    rows = _compare(spark, samples)
    assert (rows["new"].cpu_avg_previous, rows["new"].cpu_avg_change_pct) == (None, None)
    old = rows["old"]
    assert (old.active_days, old.previous_active_days, old.coverage_note) == (0, 20, "no_data")
    assert (old.engine, old.cpu_avg, old.cpu_avg_previous) == ("mysql", None, 2.0)


def test_no_change_from_zero(spark):
    samples = _month("a", "2026-07", "CPUUtilization", 0) + _month("a", "2026-08", "CPUUtilization", 5)
    assert _compare(spark, samples)["a"].cpu_avg_change_pct is None


def test_coverage_notes(spark):
    thin = _month("a", "2026-08", "CPUUtilization", 1, days=6)
    assert _compare(spark, thin)["a"].coverage_note == "partial_month"
    running = _month("a", "2026-08", "CPUUtilization", 1, days=5)
    assert _compare(spark, running, today=date(2026, 8, 5))["a"].coverage_note == "month_in_progress"
    # Fifteen of thirty days is half the month, which is enough.
    half = _month("a", "2026-06", "CPUUtilization", 1, days=15)
    assert _compare(spark, half, month="2026-06")["a"].coverage_note is None


def test_role_change_inside_a_month_is_decided_by_days(spark):
    samples = (
        _month("a", "2026-08", "CPUUtilization", 1, days=3, role="writer")
        + _month("a", "2026-08", "CPUUtilization", 9, days=20, role="reader")
    )
    row = _compare(spark, samples)["a"]
    assert (row.cluster_role, row.cpu_avg, row.active_days) == ("reader", 9.0, 20)


def test_active_days_count_any_metric_once_per_day(spark):
    samples = _month("a", "2026-08", "ReadThroughput", 1, days=31) + _month("a", "2026-08", "CPUUtilization", 1, days=4)
    row = _compare(spark, samples)["a"]
    assert (row.active_days, row.cpu_avg) == (31, 1.0)


def test_monthly_report_over_year_end_with_notable_and_text(spark):
    rows = _month("a", "2025-12", "CPUUtilization", 40) + _month("a", "2026-01", "CPUUtilization", 44)
    rows += _month("a", "2025-12", "ReadIOPS", 100) + _month("a", "2026-01", "ReadIOPS", 105)
    rows += _month("a", "2026-01", "FreeableMemory", 2 * GB)
    data = curated(spark, [(r, e, role, m, at(f"{d}T01:00:00"), v) for r, e, role, m, d, _, v in rows])
    report = monthly_report(data, ACCOUNT, REGION, today=date(2026, 2, 3))
    row = report.first()
    assert (row.month, row.previous_month) == ("2026-01", "2025-12")
    assert (row.cpu_avg_notable, row.read_iops_avg_notable, row.connections_avg_notable) == (True, False, None)
    assert monthly_line(report).first().line == (
        "resource_id=a, engine=mysql, cluster_role=writer, active_days=20, days_in_month=31, "
        "previous_active_days=20, coverage_note=None, cpu_avg=44.0 (prev=40.0, change=10.0%), "
        "cpu_max=44.0 (prev=40.0, change=10.0%), read_iops_avg=105.0 (prev=100.0, change=5.0%), "
        "freeable_memory_min_gb=2.0"
    )


def test_storage_filter_and_date_range_reach_the_scan(spark, tmp_path):
    from fleetmetrics.sources.curated import read_curated, write_curated

    write_curated(_week(spark), str(tmp_path))
    df = storage_forecast(read_curated(spark, str(tmp_path)), ACCOUNT, REGION, "2026-08-20")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(metric_name, [FreeStorageSpace,VolumeBytesUsed])" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.startswith("struct<resource_id:string,metric_name:string,value:double>")
    assert F is not None


def test_reports_come_in_their_order(spark):
    """Rows arrive sorted, not only with the right content."""
    names = [f"r{n:02d}" for n in (7, 3, 11, 0, 5, 9)]
    samples = [(n, "mysql", "writer", m, at(f"2026-0{month}-1{d}T00:00:00"), d)
               for n in names for m in ("CPUUtilization", "FreeStorageSpace") for month in (7, 8) for d in range(4)]
    rows = curated(spark, samples).repartition(5)
    where = (ACCOUNT, REGION)

    def order(df, *columns):
        return [tuple(r[c] for c in columns) for r in df.collect()]

    by_name = [(n,) for n in sorted(names)]
    assert order(reports.health_on_date(rows, *where, "2026-08-13"), "resource_id") == by_name
    assert order(reports.storage_forecast(rows, *where, "2026-08-13"), "resource_id") == by_name
    assert order(reports.monthly_report(rows, *where, "2026-08", today=date(2026, 9, 2)), "resource_id") == by_name
    days = reports.storage_forecasts(rows, *where, "2026-08-11", "2026-08-13")
    assert order(days, "resource_id", "as_of") == [(n, date(2026, 8, d)) for n in sorted(names) for d in (11, 12, 13)]
    asked = reports.live_health(rows, *where, names, at("2026-08-13T00:10:00"))
    assert order(asked, "position", "resource_id") == list(enumerate(names))
