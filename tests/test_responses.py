from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrameWriter, functions as F

from fleetmetrics import curate, land_responses, read_curated
from fleetmetrics.operators.flatten import flatten
from fleetmetrics.schemas import METRIC_RESPONSE
from fleetmetrics.sources.raw import list_objects, read_raw, write_raw
from fleetmetrics.sources.responses import as_raw, payloads, read_responses

from .helpers import ACCOUNT, REGION, rows_of


def _requests(spark, *metrics):
    schema = (
        "request_id string, query_id string, source_account_id string, region string, target_name string, "
        "resource_dimension string, resource_id string, engine string, cluster_identifier string, "
        "cluster_role string, metric_profile string, resource_profile string, metric_name string, "
        "statistic string, unit string, period_seconds int, start_time string, end_time string, collected_at string"
    )
    rows = [
        ("r1", f"m{i}", ACCOUNT, REGION, "t", "DBInstanceIdentifier", "db-1", "mysql", None, None, "p", "q", metric,
         "Average", "Count", 300, "2026-08-19T06:00:00Z", "2026-08-19T07:00:00Z", "2026-08-19T07:00:00Z")
        for i, metric in enumerate(metrics)
    ]
    return spark.createDataFrame(rows, schema)


def _t(minute):
    return datetime(2026, 8, 19, 6, minute, tzinfo=timezone.utc)


def _pages(spark):
    return spark.createDataFrame(
        [
            ("r1", [("m0", [_t(10), _t(5)], [1.00005, 2.0]), ("zz", [_t(1)], [9.0])], "more"),
            ("r1", [("m0", [_t(0), _t(59)], [3.0]), ("m1", [], [])], None),
        ],
        METRIC_RESPONSE,
    )


def test_pages_are_joined_paired_sorted_and_rounded(spark):
    rows = {r.metric_name: r for r in payloads(_requests(spark, "ReadIOPS", "WriteIOPS", "CPUUtilization"), _pages(spark)).collect()}
    assert [(p.timestamp, p.value) for p in rows["ReadIOPS"].datapoints] == [
        ("2026-08-19T06:00:00Z", 3.0), ("2026-08-19T06:05:00Z", 2.0), ("2026-08-19T06:10:00Z", round(1.00005, 4)),
    ]
    assert rows["ReadIOPS"].datapoint_count == 3 and rows["ReadIOPS"].resource_type == "db_instance"
    # Asked for without an answer: an empty payload. Answered without being asked for: nothing.
    assert (rows["WriteIOPS"].datapoint_count, rows["CPUUtilization"].datapoints) == (0, [])
    assert len(rows) == 3


def test_landed_payloads_are_read_back_the_same(spark, tmp_path):
    requests, pages = _requests(spark, "ReadIOPS", "WriteIOPS"), _pages(spark)
    land_responses(requests, pages, str(tmp_path / "raw"))
    directories = {p.parent.relative_to(tmp_path / "raw").as_posix() for p in (tmp_path / "raw").rglob("part-*.txt")}
    assert f"account_id={ACCOUNT}/region={REGION}/metric=ReadIOPS/date=2026-08-19" in directories
    columns = ("account_id", "region", "resource_id", "metric_name", "metric_timestamp", "value", "collected_at")
    direct = rows_of(flatten(as_raw(payloads(requests, pages))), *columns)
    assert rows_of(flatten(read_raw(spark, str(tmp_path / "raw"), multi_line=False)), *columns) == direct
    stats = curate(spark, str(tmp_path / "raw"), str(tmp_path / "out"), multi_line=False)
    assert (stats["raw_payload_count"], stats["no_data_payload_count"], stats["curated_row_count"]) == (2, 1, 3)
    assert rows_of(read_curated(spark, str(tmp_path / "out")), *columns) == direct


def test_compressed_landing_is_small_and_read_back_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("fleetmetrics.sources.raw.COMPRESSED_FILE_ROWS", 400)
    one = payloads(_requests(spark, "ReadIOPS", "WriteIOPS"), _pages(spark))
    many = one.crossJoin(spark.range(1000)).withColumn("resource_id", F.concat("resource_id", "id")).drop("id")
    plain, packed = tmp_path / "plain", tmp_path / "packed"
    write_raw(many, str(plain))
    write_raw(many, str(packed), compressed=True)
    sizes = [[f.stat().st_size for f in root.rglob("part-*")] for root in (plain, packed)]
    assert sum(sizes[1]) * 5 < sum(sizes[0]) and len(sizes[1]) >= 6
    columns = ("account_id", "region", "resource_id", "metric_name", "metric_timestamp", "value", "collected_at")
    rows = [rows_of(flatten(read_raw(spark, str(root), multi_line=False)), *columns) for root in (plain, packed)]
    assert rows[0] == rows[1] and len(rows[0]) == 3000
    assert list_objects(spark, str(packed)).count() == len(sizes[1])


def test_landing_keeps_files_open_and_loses_nothing_past_their_number(spark, tmp_path, monkeypatch):
    key, seen, plain_text = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.text

    def text(writer, *args, **kwargs):
        seen.append(spark.conf.get(key, None))
        return plain_text(writer, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "text", text)
    metrics = [f"Metric{i}" for i in range(40)]
    rows = payloads(_requests(spark, *metrics), _pages(spark)).crossJoin(spark.range(50)).drop("id")
    before = spark.conf.get(key, None)
    for files in (100, 3):  # more directories than open files: the rest is sorted
        monkeypatch.setattr("fleetmetrics.sources.raw.OPEN_FILES", files)
        root = str(tmp_path / f"raw{files}")
        write_raw(rows.coalesce(1), root, compressed=True)
        landed = read_raw(spark, root, multi_line=False)
        in_place = F.col("source_file").contains(F.concat(F.lit("/metric="), "metric_name", F.lit("/")))
        assert landed.select("metric_name").distinct().count() == 40
        assert landed.where(in_place).count() == 2000 == landed.count()
        assert spark.conf.get(key, None) == before
    assert seen == ["100", "3"]
    spark.conf.set(key, "7")
    try:
        write_raw(rows.limit(1), str(tmp_path / "again"))
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.unset(key)


def test_dumped_pages_are_read(spark, tmp_path):
    page = {"request_id": "r1", "MetricDataResults": [{"Id": "m0", "Timestamps": ["2026-08-19T15:05:00+09:00"], "Values": [5]}]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=2))
    [row] = payloads(_requests(spark, "ReadIOPS"), read_responses(spark, str(tmp_path))).collect()
    assert [(p.timestamp, p.value) for p in row.datapoints] == [("2026-08-19T06:05:00Z", 5.0)]
