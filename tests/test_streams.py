"""Live health as a stream, and forecasts of successive days from one pass."""

from __future__ import annotations

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from fleetmetrics.operators.storage import rolling_forecast, storage_forecast
from fleetmetrics.operators.flatten import flatten
from fleetmetrics.sources.raw import read_raw
from fleetmetrics.streaming.live import close_windows, live_health_stream, read_live_health, sliding_health

from .helpers import at, curated, history, payload, rows_of, write_payload


def land(root, name, metric, *samples, resource="a"):
    points = [{"timestamp": f"{when}Z", "value": value} for when, value in samples]
    write_payload(root, f"{name}.json", payload(datapoints=points, metric_name=metric, resource_id=resource))


def test_stream_writes_closed_windows_once_and_leaves_late_samples_out(spark, tmp_path):
    raw, sink, progress = tmp_path / "raw", str(tmp_path / "sink"), str(tmp_path / "progress")

    def run():
        live_health_stream(spark, str(raw), sink, progress, window="10 minutes", slide="10 minutes").awaitTermination()
        rows = spark.read.parquet(sink).where("resource_id = 'a'").orderBy("window_start")
        return [(r.window_start, r.cpu_avg, r.connections_max) for r in rows.collect()]

    land(raw, "1", "CPUUtilization", ("2026-08-19T06:01:00", 10), ("2026-08-19T06:02:00", 20))
    land(raw, "2", "CPUUtilization", ("2026-08-19T06:01:00", 10), ("2026-08-19T06:31:00", 50))  # one sample twice
    first = run()
    # The watermark is 06:16: the first window is closed, the one of 06:30 open.
    assert first == [(at("2026-08-19T06:00:00"), 15.0, None)]
    land(raw, "3", "DatabaseConnections", ("2026-08-19T06:05:00", 9), ("2026-08-19T06:17:00", 3))  # too late; in time
    land(raw, "4", "CPUUtilization", ("2026-08-19T07:30:00", 1))
    second = run()
    assert second == [
        (at("2026-08-19T06:00:00"), 15.0, None),
        (at("2026-08-19T06:10:00"), None, 3.0),
        (at("2026-08-19T06:30:00"), 50.0, None),
    ]
    assert run() == second


def test_stream_keeps_only_samples_of_open_windows(spark, tmp_path):
    raw, sink, progress = tmp_path / "raw", str(tmp_path / "sink"), str(tmp_path / "progress")
    day = [(f"2026-08-19T{h:02}:{m:02}:00", h) for h in range(24) for m in (1, 31)]
    land(raw, "1", "CPUUtilization", *day)
    live_health_stream(spark, str(raw), sink, progress).awaitTermination()
    kept = spark.read.parquet(f"{progress}/open_windows/after=0")
    # The watermark is 23:16: windows from 22:50 on are open.
    assert rows_of(kept, "metric_timestamp") == [(at("2026-08-19T23:01:00"),), (at("2026-08-19T23:31:00"),)]
    assert not [f for f in (tmp_path / "progress").rglob("*.delta")]
    assert read_live_health(spark, sink).count() == 46 * 6 + 3


def test_replayed_batch_and_sample_seen_before_change_nothing(spark, tmp_path):
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")
    held = {"window": "10 minutes", "slide": "10 minutes", "late_by": "15 minutes"}
    landings = [
        [("2026-08-19T06:01:00", 10), ("2026-08-19T06:31:00", 50)],
        [("2026-08-19T06:31:00", 90), ("2026-08-19T06:35:00", 70), ("2026-08-19T06:16:00", 5), ("2026-08-19T08:00:00", 1)],
        [("2026-08-19T09:00:00", 1)],
    ]
    for number, samples in enumerate(landings):
        land(tmp_path / f"raw{number}", "1", "CPUUtilization", *samples)
        rows = flatten(read_raw(spark, str(tmp_path / f"raw{number}")), "quarantine")
        for _ in range(2):
            close_windows(rows, number, sink, state, **held)
    windows = [(r.window_start, r.cpu_avg) for r in read_live_health(spark, sink).orderBy("window_start").collect()]
    # 06:16 is no newer than the watermark of the batch before, and the first value of 06:31 stays.
    assert windows == [(at("2026-08-19T06:00:00"), 10.0), (at("2026-08-19T06:30:00"), 60.0), (at("2026-08-19T08:00:00"), 1.0)]
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["after=1", "after=2"]


def test_windows_across_days_and_wide_values_cost_no_copies_in_the_shuffle(spark):
    start = at("2026-08-19T23:00:00")
    rows = [
        ("a", "mysql", "writer", metric, start + timedelta(minutes=7 * i, seconds=i), i * 1.5 - 3)
        for i in range(20) for metric in ("CPUUtilization", "Unknown", "ReadIOPS")[: 1 + i % 3]
    ]
    data = curated(spark, [*rows, ("b", "mysql", "writer", "Unknown", start, 1)])
    for long, step in ((30, 5), (30, 7), (1500, 240), (10, 10)):
        got = sliding_health(data, f"{long} minutes", f"{step} minutes")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "Expand" not in plan
        expected = {}
        for resource, _, _, metric, when, value in [*rows, ("b", "", "", "Unknown", start, 1)]:
            second = int((when - at("1970-01-01T00:00:00")).total_seconds())
            first = second // (step * 60) * step * 60
            while first > second - long * 60:
                expected.setdefault((resource, first), []).extend([value] if metric == "CPUUtilization" else [])
                first -= step * 60
        key = lambda r: (r.resource_id, int((r.window_start - at("1970-01-01T00:00:00")).total_seconds()))
        found = {key(r): (r.cpu_avg, r.cpu_max, r.window_end - r.window_start) for r in got.collect()}
        assert found == {
            k: (round(sum(v) / len(v), 4) if v else None, max(v, default=None), timedelta(minutes=long))
            for k, v in expected.items()
        }


def test_windows_of_one_value_are_not_divided(spark, monkeypatch):
    from fleetmetrics.functions import exact

    start = at("2026-08-19T23:00:00")
    values = (0.1, -0.0, -1e-30, 2.0**70 + 2.0**20, -17.25, 1e300)
    rows = [("a", "mysql", "writer", "CPUUtilization", start + timedelta(hours=i), v) for i, v in enumerate(values)]
    whole = sliding_health(curated(spark, rows), "30 minutes", "30 minutes").orderBy("window_start").collect()
    # Whole sums of a window with one value are never formed into a quotient.
    monkeypatch.setattr(exact, "mean", lambda *_: "CAST(raise_error('divided') AS DOUBLE)")
    single = sliding_health(curated(spark, rows), "30 minutes", "30 minutes").orderBy("window_start").collect()
    assert [str(r.cpu_avg) for r in single] == [str(r.cpu_avg) for r in whole]
    assert [str(r.cpu_avg) for r in whole] == ["0.1", "0.0", "0.0", str(2.0**70 + 2.0**20), "-17.25", "1e+300"]


def test_rolling_forecasts_equal_the_forecast_of_each_window(spark):
    random.seed(9)
    rows = []
    for name in ("a", "b", "c"):
        for day in range(80):
            if name == "b" and 20 < day < 60 or random.random() < 0.3:
                continue  # gaps, and a window without any point
            value = 5e12 - day * random.uniform(1e10, 2e10)
            when = str(date(2026, 1, 1) + timedelta(days=day))
            rows.append((name, when, value if name != "c" or day > 40 else None, None if name == "a" else 1e12 + day))
    table = history(spark, rows)
    first, last = date(2026, 1, 25), date(2026, 3, 21)
    rolled = rolling_forecast(table, first, last, days=20)
    by_day, columns = {}, [c for c in rolled.columns if c != "as_of"]
    for row in rows_of(rolled, "as_of", *columns):
        by_day.setdefault(row[0], []).append(row[1:])
    day = first
    while day <= last:
        window = table.where(F.col("date").between(day - timedelta(days=20), day))
        assert rows_of(storage_forecast(window, day - timedelta(days=20)), *columns) == by_day.get(day, [])
        day += timedelta(days=7)
    assert len(by_day) == (last - first).days + 1
