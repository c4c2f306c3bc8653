"""The published table: hours swapped whole, partitions chosen before listing, states of days."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetmetrics import curate, incremental_curate, read_curated
from fleetmetrics.catalog import BASELINE_STATS, MONTHLY_STATS
from fleetmetrics.operators import rollup
from fleetmetrics.operators.health import baseline
from fleetmetrics.operators.monthly import monthly_aggregate
from fleetmetrics.schemas import CURATED
from fleetmetrics.sources import published
from fleetmetrics.sources.curated import scope
from fleetmetrics.sources.raw import read_raw
from fleetmetrics.streaming.incremental import merge_batch

from .helpers import ACCOUNT, REGION, payload, rows_of, write_payload


def land(root, name, *samples, **changes):
    """One payload of (timestamp, value) samples."""
    points = [{"timestamp": f"{when}Z", "value": value} for when, value in samples]
    write_payload(root, f"account_id={ACCOUNT}/{name}.json", payload(datapoints=points, **changes))


def content(spark, table):
    return rows_of(published.read_published(spark, table), *CURATED.fieldNames())


@pytest.fixture
def table(spark, request):
    name = f"published_{random.randrange(1 << 40)}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stream_and_batch_publish_the_same_table(spark, tmp_path, table):
    raw, progress = tmp_path / "raw", str(tmp_path / "progress")
    land(raw, "a", ("2026-08-19T06:55:00", 1), ("2026-08-19T07:05:00", 2))
    for _ in range(2):
        incremental_curate(spark, str(raw), str(tmp_path / "live"), progress, table=table).awaitTermination()
    land(raw, "b", ("2026-08-19T07:05:00", 3), ("2026-08-20T00:00:00", 4), collected_at="2026-08-20T00:05:00Z")
    incremental_curate(spark, str(raw), str(tmp_path / "live"), progress, table=table).awaitTermination()
    curate(spark, str(raw), str(tmp_path / "plain"))
    expected = rows_of(read_curated(spark, str(tmp_path / "plain")), *CURATED.fieldNames())
    assert content(spark, table) == expected and len(expected) == 3
    stats = curate(spark, str(raw), str(tmp_path / "live"), publish_to=table)
    assert (stats["raw_datapoint_count"], stats["curated_row_count"], stats["duplicates_removed"]) == (4, 3, 1)
    assert content(spark, table) == expected
    assert not list((tmp_path / "live").glob("_staging/*"))


def test_a_refresh_killed_between_hours_leaves_whole_hours(spark, tmp_path, table, monkeypatch):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    hours = [f"2026-08-19T{h:02d}" for h in range(6)]
    land(raw, "old", *[(f"{h}:00:00", 1) for h in hours])
    merge_batch(read_raw(spark, str(raw)), out, table=table)
    before = content(spark, table)
    running = published.read_published(spark, table)
    running_plan = running.where("hour = '00'")
    land(raw, "new", *[(f"{h}:00:00", 2) for h in hours], *[(f"{h}:30:00", 3) for h in hours], collected_at="2026-08-19T09:00:00Z")
    swap, swapped = published.swap_hour, []

    def dies(*args):
        if len(swapped) == 3:
            raise RuntimeError("lost")
        swapped.append(args)
        swap(*args)

    monkeypatch.setattr(published, "swap_hour", dies)
    with pytest.raises(RuntimeError, match="lost"):
        merge_batch(read_raw(spark, str(raw)), out, table=table)
    monkeypatch.undo()
    by_hour = {}
    for row in published.read_published(spark, table).collect():
        by_hour.setdefault(row.hour, []).append(row.value)
    assert len(by_hour) == 6
    assert sorted(map(sorted, by_hour.values())) == [[1.0]] * 3 + [[2.0, 3.0]] * 3
    # A plan made before reads the files it was made with; they are still there.
    assert [r.value for r in running_plan.collect()] in ([1.0], [2.0, 3.0])
    assert len(before) == 6
    merge_batch(read_raw(spark, str(raw)), out, table=table)
    assert sorted(r.value for r in published.read_published(spark, table).collect()) == [2.0] * 6 + [3.0] * 6


def test_reports_list_only_the_days_in_scope(spark, tmp_path, table):
    raw = tmp_path / "raw"
    land(raw, "a", *[(f"2026-08-{d:02d}T06:00:00", d) for d in range(1, 29)])
    merge_batch(read_raw(spark, str(raw)), str(tmp_path / "out"), table=table)
    rows = scope(published.read_published(spark, table), ACCOUNT, REGION, "2026-08-05", "2026-08-07")
    assert sorted(r.value for r in rows.collect()) == [5.0, 6.0, 7.0]
    execution = rows._jdf.queryExecution()
    plan = execution.optimizedPlan().toString() + execution.executedPlan().toString()
    assert "PartitionFilters" in plan and "CatalogFileIndex" not in plan.split("PartitionFilters")[0].split("Location")[0]
    assert len(rows.inputFiles()) == 3
    hours = published.touched_hours(rows.where("value <> 6"))
    kept = published.published_hours(spark, table, hours)
    assert len(kept.inputFiles()) == 2 and sorted(r.value for r in kept.collect()) == [5.0, 7.0]
    assert published.published_hours(spark, table, []).count() == 0


def test_quoted_values_are_one_hour(spark, tmp_path, table):
    raw = tmp_path / "raw"
    land(raw, "a", ("2026-08-19T06:00:00", 1), region="o'region")
    merge_batch(read_raw(spark, str(raw)), str(tmp_path / "out"), table=table)
    merge_batch(read_raw(spark, str(raw)), str(tmp_path / "out"), table=table)
    assert [(r.region, r.value) for r in published.read_published(spark, table).collect()] == [("o'region", 1.0)]


def test_states_of_days_give_the_reports_of_samples(spark, tmp_path, table):
    raw, out, states = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "states")
    random.seed(3)
    for metric in ("CPUUtilization", "DatabaseConnections", "FreeableMemory", "FreeStorageSpace", "AuroraReplicaLag"):
        for resource, role in (("a", "writer"), ("b", "reader"), ("a", "reader")):
            points = [(f"2026-08-{d:02d}T0{h}:15:00", random.uniform(0, 1e12)) for d in range(1, 11) for h in range(3)]
            land(raw, f"{metric}-{resource}-{role}", *points, metric_name=metric, resource_id=resource, cluster_role=role)
    with pytest.raises(ValueError, match="table"):
        merge_batch(read_raw(spark, str(raw)), out, rollup_root=states)
    merge_batch(read_raw(spark, str(raw)), out, table=table, rollup_root=states)

    def check():
        rows, kept = published.read_published(spark, table), rollup.read_states(spark, states)
        direct = baseline(rows)
        assert rows_of(rollup.wide_stats_of_states(kept, ("resource_id",), BASELINE_STATS), *direct.columns) == rows_of(
            direct, *direct.columns
        )
        months = monthly_aggregate(rows)
        assert rows_of(rollup.monthly_of_states(kept, MONTHLY_STATS), *months.columns) == rows_of(months, *months.columns)

    check()
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "states").rglob("*.parquet")}
    land(raw, "late", ("2026-08-04T02:20:00", 5.5), resource_id="a")
    merge_batch(read_raw(spark, str(raw)).where(F.col("source_file").endswith("late.json")), out, table=table, rollup_root=states)
    check()
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "states").rglob("*.parquet")}
    changed = {p.parent.name for p in set(written.items()) ^ set(now.items()) for p in [p[0]]}
    assert changed == {"date=2026-08-04"}


def scanned_rows(df):
    """The answer, and how many rows the scan gave for it."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().get("numOutputRows").get().value()


def test_a_report_on_one_resource_skips_row_groups_that_cannot_hold_it(spark, tmp_path):
    from fleetmetrics.sources.curated import write_curated

    from .helpers import at, curated

    # One hour, sixty sample times; every group of rows spans the names from a to z.
    samples = []
    for minute in range(60):
        when = at(f"2026-08-19T06:{minute:02d}:00")
        samples += [(f"{letter}{n:03d}", "mysql", "writer", "CPUUtilization", when, n) for letter in "az" for n in range(50)]
        if minute == 31:
            samples += [("m-one", "mysql", "writer", "CPUUtilization", when, 7), ("m-one", "mysql", "writer", "BurstBalance", when, 9)]
    write_curated(curated(spark, samples).coalesce(1), str(tmp_path / "fine"), row_group_bytes=8 << 10)
    table = read_curated(spark, str(tmp_path / "fine"))
    rows, scanned = scanned_rows(table.where("resource_id = 'm-one'").select("metric_name", "value"))
    assert sorted(map(tuple, rows)) == [("BurstBalance", 9.0), ("CPUUtilization", 7.0)]
    assert 2 <= scanned < len(samples) / 4
    rows, scanned = scanned_rows(table.where("metric_name = 'BurstBalance'").select("resource_id", "value"))
    assert [tuple(r) for r in rows] == [("m-one", 9.0)] and scanned < len(samples) / 4
    rows, scanned = scanned_rows(table.where("resource_id = 'm-two'").select("value"))
    assert rows == [] and scanned < len(samples) / 4
    assert scanned_rows(table.select("value"))[1] == len(samples)
