from __future__ import annotations

import json
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fleetmetrics import curate, incremental_curate, read_curated
from fleetmetrics.operators.dedup import deduplicate
from fleetmetrics.operators.flatten import POSITION, REASON, flatten, rejects
from fleetmetrics.plans.curate import refresh_statistics
from fleetmetrics.schemas import CURATED
from fleetmetrics.sources.curated import register_curated, scope, write_curated
from fleetmetrics.sources.raw import object_counts, read_raw
from fleetmetrics.sources.published import touched_hours
from fleetmetrics.streaming import incremental
from fleetmetrics.streaming.incremental import merge_batch

from .helpers import ACCOUNT, COLLECTED, REGION, VALUE, at, curated, payload, rows_of, write_payload

PLACE = f"account_id={ACCOUNT}/region={REGION}/metric=CPUUtilization/date=2026-08-19"


def raw_of(spark, root):
    return read_raw(spark, str(root))


def test_flatten_copies_the_header_to_every_datapoint(spark, tmp_path):
    points = [
        {"timestamp": "2026-08-19T06:55:00Z", "value": 42.5},
        {"timestamp": "2026-08-19T16:00:00+09:00", "value": "0"},
    ]
    write_payload(tmp_path, f"{PLACE}/a.json", payload(datapoints=points))
    rows = flatten(raw_of(spark, tmp_path)).orderBy(POSITION).collect()
    assert [(r.metric_timestamp, r.value, r.hour) for r in rows] == [
        (at("2026-08-19T06:55:00"), 42.5, "06"),
        (at("2026-08-19T07:00:00"), 0.0, "07"),
    ]
    first = rows[0]
    assert (first.account_id, first.region, first.source_file) == (ACCOUNT, REGION, f"{PLACE}/a.json")
    assert (first.period_seconds, first.collected_at, first.date) == (300, at(COLLECTED[:-1]), date(2026, 8, 19))


def test_path_stands_in_for_missing_account_and_region_but_never_wins(spark, tmp_path):
    other = "account_id=999999999999/region=eu-west-1"
    write_payload(tmp_path, f"{other}/gone.json", payload(source_account_id=..., region=""))
    write_payload(tmp_path, f"{other}/both.json", payload())
    got = {r.source_file: (r.account_id, r.region) for r in flatten(raw_of(spark, tmp_path)).collect()}
    assert got == {f"{other}/gone.json": ("999999999999", "eu-west-1"), f"{other}/both.json": (ACCOUNT, REGION)}


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({"source_account_id": ...}, "Missing source_account_id"),
        ({"source_account_id": "  "}, "Empty source_account_id"),
        ({"region": ...}, "Missing region"),
        ({"resource_id": None}, "Missing resource_id"),
        ({"resource_id": "\t "}, "Empty resource_id"),
        ({"metric_name": ""}, "Empty metric_name"),
        ({"collected_at": ...}, "Missing collected_at"),
        ({"collected_at": "soon"}, "Invalid collected_at"),
        ({"datapoints": "oops"}, "datapoints must be a list"),
        ({"datapoints": [{"value": 1}]}, "Missing datapoint.timestamp"),
        ({"datapoints": [{"timestamp": "2026-08-19T06:55:00Z"}]}, "Missing datapoint.value"),
        ({"datapoints": [{"timestamp": "2026-08-19T06:55:00Z", "value": " "}]}, "Empty datapoint.value"),
        ({"datapoints": [{"timestamp": "2026-08-19T06:55:00Z", "value": "much"}]}, "Invalid datapoint.value"),
    ],
)
def test_bad_payloads_are_named_with_reason_and_file(spark, tmp_path, changes, reason):
    write_payload(tmp_path, "in/bad.json", payload(**changes))
    write_payload(tmp_path, "in/good.json", payload())
    raw = raw_of(spark, tmp_path)
    with pytest.raises(Exception, match=rf"{reason}: in/bad\.json"):
        flatten(raw).collect()
    assert [r.source_file for r in flatten(raw, "quarantine").collect()] == ["in/good.json"]
    assert [(r.source_file, r[REASON]) for r in rejects(raw).collect()] == [("in/bad.json", reason)]


def test_unreadable_document_is_rejected(spark, tmp_path):
    write_payload(tmp_path, "bad.json", "{not json")
    assert [r[REASON] for r in rejects(raw_of(spark, tmp_path)).collect()] == ["Malformed payload"]


def test_file_names_with_special_characters(spark, tmp_path):
    write_payload(tmp_path, "a b/c+d %41é.json", payload())
    assert [r.source_file for r in flatten(raw_of(spark, tmp_path)).collect()] == ["a b/c+d %41é.json"]


def test_dedup_keeps_latest_then_first_seen(spark):
    key = ("r", "mysql", "writer", "CPUUtilization", at("2026-08-19T06:55:00"))
    base = curated(spark, [(*key, 0)])

    def copy(value, collected, file, pos):
        return base.withColumns(
            {
                "value": F.lit(float(value)),
                "collected_at": F.lit(at(collected)).cast("timestamp_ntz"),
                "source_file": F.lit(file),
                POSITION: F.lit(pos),
            }
        )

    old = copy(1, "2026-08-19T07:00:00", "a/0.json", 0)
    tied = [
        copy(2, "2026-08-19T07:05:00", "a-b/1.json", 0),
        copy(3, "2026-08-19T07:05:00", "a/1.json", 1),
        copy(4, "2026-08-19T07:05:00", "a/1.json", 0),
    ]
    for _ in range(3):
        parts = [old, *tied]
        random.shuffle(parts)
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        assert [r.value for r in deduplicate(rows).collect()] == [4.0]


def _fill(root, n=40):
    """Files of several collections whose points overlap between them."""
    for i in range(n):
        points = [
            {"timestamp": f"2026-08-19T{(i + k) % 24:02d}:{(5 * k) % 60:02d}:00Z", "value": i * 10 + k}
            for k in range(6)
        ]
        document = payload(
            resource_id=f"db-{i % 3}",
            collected_at=f"2026-08-19T12:{i:02d}:00Z",
            datapoints=[] if i % 10 == 9 else points,
        )
        write_payload(root, f"{PLACE}/r{i:03d}.json", document)


def test_end_to_end_counts_layout_and_repeat(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    _fill(raw)
    stats = curate(spark, str(raw), str(out), file_stats=True)
    assert stats["raw_payload_count"] == 40 and stats["no_data_payload_count"] == 4
    assert stats["raw_datapoint_count"] == 216
    assert stats["duplicates_removed"] == 216 - stats["curated_row_count"] > 0
    first = rows_of(read_curated(spark, str(out)), *CURATED.fieldNames())
    assert len(first) == stats["curated_row_count"]
    files = sorted(p.relative_to(out).parent.as_posix() for p in out.rglob("*.parquet"))
    assert len(files) == len(set(files)) == stats["parquet_file_count"] == stats["partition_count"]
    assert all(f.startswith(f"account_id={ACCOUNT}/region={REGION}/date=2026-08-19/hour=") for f in files)
    curate(spark, str(raw), str(out))
    assert rows_of(read_curated(spark, str(out)), *CURATED.fieldNames()) == first


def test_files_are_sorted_by_time_resource_metric(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    _fill(raw)
    curate(spark, str(raw), str(out))
    import pyarrow.parquet as pq

    for path in out.rglob("*.parquet"):
        table = pq.ParquetFile(path).read()
        keys = list(zip(*[table[c].to_pylist() for c in ("metric_timestamp", "resource_id", "metric_name")]))
        assert keys == sorted(keys)
        assert "account_id" not in table.column_names


def test_a_large_hour_is_split_over_files(spark, tmp_path):
    sample = curated(spark, [("x", "e", "w", "CPUUtilization", at("2026-08-19T06:00:00"), 1)])
    ids = spark.range(0, 40_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("resource_id"))
    rows = ids.join(F.broadcast(sample.drop("resource_id")))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
    try:
        write_curated(rows, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128m")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
    assert len(list((tmp_path / "out").rglob("*.parquet"))) > 1
    assert read_curated(spark, str(tmp_path / "out")).count() == 40_000


def test_empty_root_is_an_error(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    with pytest.raises(ValueError, match="No raw JSON files"):
        curate(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    with pytest.raises(ValueError, match="No raw JSON files"):
        curate(spark, str(tmp_path / "raw"), str(tmp_path / "out"), partitioned_only=True)


def test_objects_without_an_account_partition_are_skipped_and_counted(spark, tmp_path):
    write_payload(tmp_path / "raw", f"{PLACE}/new.json", payload())
    write_payload(tmp_path / "raw", "region=x/old.json", payload(source_account_id=...))
    write_payload(tmp_path / "raw", f"{PLACE}/note.txt", "no payload")
    counts = object_counts(spark, str(tmp_path / "raw")).first()
    assert (counts.partitioned_count, counts.skipped_count) == (1, 1)
    stats = curate(spark, str(tmp_path / "raw"), str(tmp_path / "out"), partitioned_only=True)
    assert (stats["raw_payload_count"], stats["skipped_object_count"]) == (1, 1)
    streamed = str(tmp_path / "streamed")
    incremental_curate(
        spark, str(tmp_path / "raw"), streamed, str(tmp_path / "progress"), partitioned_only=True
    ).awaitTermination()
    assert read_curated(spark, streamed).count() == 1


def test_collection_dates_narrow_the_listing(spark, tmp_path):
    write_payload(tmp_path, f"{PLACE}/in.json", payload())
    write_payload(tmp_path, PLACE.replace("08-19", "08-18") + "/out.json", "{broken")
    raw = read_raw(spark, str(tmp_path), collection_dates=["2026-08-19"])
    assert [r.source_file for r in flatten(raw).collect()] == [f"{PLACE}/in.json"]


def test_quarantine_keeps_the_good_and_writes_the_bad(spark, tmp_path):
    write_payload(tmp_path / "raw", "good.json", payload())
    write_payload(tmp_path / "raw", "bad.json", payload(resource_id=""))
    curate(
        spark, str(tmp_path / "raw"), str(tmp_path / "out"), on_error="quarantine",
        quarantine_root=str(tmp_path / "bad"),
    )
    assert read_curated(spark, str(tmp_path / "out")).count() == 1
    assert [r[REASON] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["Empty resource_id"]


def test_rejects_are_counted_and_never_lost(spark, tmp_path):
    bad = [{"timestamp": "2026-08-19T01:00:00Z", "value": 1.0}, {"timestamp": "2026-08-19T01:05:00Z", "value": "x"}]
    write_payload(tmp_path / "raw", "mixed.json", payload(datapoints=bad))
    write_payload(tmp_path / "raw", "bad.json", payload(resource_id=""))
    raw, out, refused = (str(tmp_path / name) for name in ("raw", "out", "refused"))
    with pytest.raises(ValueError, match="quarantine_root"):
        curate(spark, raw, out, on_error="quarantine")
    with pytest.raises(ValueError, match="quarantine_root"):
        incremental_curate(spark, raw, out, str(tmp_path / "progress"), on_error="quarantine")
    for _ in range(2):
        stats = curate(spark, raw, out, on_error="quarantine", quarantine_root=refused)
        assert (stats["curated_row_count"], stats["rejected_count"], stats["duplicates_removed"]) == (1, 2, 0)
        assert spark.read.parquet(refused).count() == 2
    counted = refresh_statistics(raw_of(spark, tmp_path / "raw")).first()
    assert (counted.raw_datapoint_count, counted.rejected_count, counted.duplicates_removed) == (1, 2, 0)
    incremental_curate(
        spark, raw, out, str(tmp_path / "progress"), on_error="quarantine", quarantine_root=f"{refused}-live"
    ).awaitTermination()
    assert spark.read.parquet(f"{refused}-live").count() == 2


def test_curated_scope_prunes_partitions_and_keeps_text_types(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    _fill(raw)
    curate(spark, str(raw), str(out), table="curated_metrics")
    df = read_curated(spark, str(out))
    assert {(r.account_id, r.hour) for r in df.where("hour = '06'").collect()} == {(ACCOUNT, "06")}
    plan = scope(df, ACCOUNT, REGION, "2026-08-19")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all(name in filters for name in ("account_id", "region", "date"))
    assert spark.table("curated_metrics").count() == df.count()
    register_curated(spark, "curated_metrics", str(out))
    with pytest.raises(ValueError):
        scope(df, "1'; --", REGION, "2026-08-19")


def test_incremental_equals_batch_after_any_arrivals(spark, tmp_path):
    raw, staged = tmp_path / "raw", tmp_path / "staged"
    _fill(staged)
    names = sorted(p.name for p in staged.rglob("*.json"))
    random.Random(7).shuffle(names)
    batch_out, stream_out, progress = (str(tmp_path / n) for n in ("batch", "stream", "progress"))
    for part in (names[:15], names[15:18], names[18:]):
        for name in part:
            write_payload(raw, f"{PLACE}/{name}", (staged / PLACE / name).read_text())
        incremental_curate(spark, str(raw), stream_out, progress).awaitTermination()
    curate(spark, str(raw), batch_out)
    expected = rows_of(read_curated(spark, batch_out), *CURATED.fieldNames())
    assert rows_of(read_curated(spark, stream_out), *CURATED.fieldNames()) == expected
    # Replaying a batch, and running without new files, change nothing.
    merge_batch(read_raw(spark, str(raw)), stream_out)
    incremental_curate(spark, str(raw), stream_out, progress).awaitTermination()
    assert rows_of(read_curated(spark, stream_out), *CURATED.fieldNames()) == expected


def test_timestamps_are_naive(spark, tmp_path):
    write_payload(tmp_path / "raw", "a.json", payload())
    curate(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    row = read_curated(spark, str(tmp_path / "out")).first()
    assert row.metric_timestamp == datetime(2026, 8, 19, 5, 5)


def test_refresh_by_collection_date_equals_whole_refresh(spark, tmp_path):
    raw = tmp_path / "raw"
    for day, other in (("2026-08-19", "2026-08-18"), ("2026-08-20", "2026-08-19")):
        for i in range(3):
            # Each day's payloads also bring samples of the day before.
            points = [
                {"timestamp": f"{other}T23:{10 * i + 5:02d}:00Z", "value": i},
                {"timestamp": f"{day}T23:0{i}:00Z", "value": 10 + i},
            ]
            document = payload(collected_at=f"{day}T23:30:00Z", datapoints=points)
            write_payload(raw, f"{PLACE.replace('2026-08-19', day)}/{i}.json", document)
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    curate(spark, str(raw), whole)
    for day in ("2026-08-19", "2026-08-20"):
        stats = curate(spark, str(raw), parts, collection_dates=[day])
        assert (stats["raw_payload_count"], stats["curated_row_count"]) == (3, 6)
    expected = rows_of(read_curated(spark, whole), *CURATED.fieldNames())
    assert len(expected) == 12
    assert rows_of(read_curated(spark, parts), *CURATED.fieldNames()) == expected


def test_missing_history_is_empty(spark, tmp_path):
    from fleetmetrics.sources.curated import read_history

    table = read_history(spark, str(tmp_path / "never"))
    assert table.schema.fieldNames() == CURATED.fieldNames() and table.isEmpty()


@pytest.mark.parametrize("multi_line", [True, False])
def test_whole_documents_tell_null_from_missing(spark, tmp_path, multi_line):
    from fleetmetrics.operators.flatten import accepted, headers, judged

    documents = {
        "list": payload(), "missing": payload(datapoints=...), "null": payload(datapoints=None),
        "object": payload(datapoints={"timestamp": "x"}), "text": payload(datapoints="none"),
        "entries": payload(datapoints=[7, {"timestamp": "2026-08-19T01:00:00Z", "value": "1e3"}, {"value": True}]),
        "late": payload(datapoints=None, resource_id=""), "broken": '{"resource_id": "a"', "array": "[1, 2]",
    }
    for name, document in documents.items():
        text = document if isinstance(document, str) else json.dumps(document, indent=2 if multi_line else None)
        write_payload(tmp_path, f"{PLACE}/{name}.json", text)
    raw = read_raw(spark, str(tmp_path), multi_line=multi_line, variant=True)
    rows = judged(headers(raw))
    reasons = {}
    for row in rows.where(F.col(REASON).isNotNull()).collect():
        reasons.setdefault(row.source_file.split("/")[-1][:-5], []).append(row[REASON])
    not_a_list = ["datapoints must be a list"]
    assert {k: sorted(v) for k, v in reasons.items()} == {
        "null": not_a_list, "object": not_a_list, "text": not_a_list, "late": ["Empty resource_id"],
        "broken": ["Malformed payload"], "array": ["Malformed payload"],
        "entries": ["Missing datapoint.timestamp", "Missing datapoint.timestamp"],
    }
    got = {(r.source_file.split("/")[-1], r.value) for r in accepted(rows).collect()}
    assert got == {("list.json", VALUE), ("entries.json", 1000.0)}
    assert "missing" not in reasons  # a missing list is an empty one
    with pytest.raises(Exception, match="must be a list|Malformed|Missing|Empty"):
        curate(spark, str(tmp_path), str(tmp_path / "out"), variant=True, multi_line=multi_line)


def test_touched_hours_are_asked_without_ranking_the_copies(spark, tmp_path, monkeypatch):
    plans = []

    def asked(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return touched_hours(rows)

    monkeypatch.setattr(incremental, "touched_hours", asked)
    copies = [payload(collected_at=f"2026-08-19T05:12:{second}Z") for second in (30, 31)]
    for number, document in enumerate((*copies, payload(resource_id=" "))):
        write_payload(tmp_path / "raw", f"{number}.json", document)
    stats = str(tmp_path / "stats")
    incremental.merge_batch(
        read_raw(spark, str(tmp_path / "raw")), str(tmp_path / "out"), "quarantine", str(tmp_path / "refused"), stats_root=stats
    )
    assert len(plans) == 1 and "Window" not in plans[0]
    [row] = incremental.read_batch_stats(spark, stats).collect()
    assert (row.raw_datapoint_count, row.curated_row_count, row.duplicates_removed) == (2, 1, 1)
    assert (row.touched_hour_count, row.rejected_count) == (1, 1)
