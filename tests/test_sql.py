"""SQL table functions give the rows of the DataFrame reports."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetmetrics import create_report_functions
from fleetmetrics.functions.rounding import even_round, even_round_text
from fleetmetrics.plans import reports

from .helpers import ACCOUNT, REGION, curated, rows_of

WHERE = f"'{ACCOUNT}', '{REGION}'"
AS_OF = datetime(2026, 8, 20, 12)


@pytest.fixture(scope="module")
def fleet(spark):
    random.seed(13)
    metrics = ["CPUUtilization", "DatabaseConnections", "FreeableMemory", "FreeStorageSpace", "VolumeBytesUsed", "ReadLatency"]
    samples = [
        (name, engine, role, metric, AS_OF - timedelta(hours=7 * step), random.choice([0, random.uniform(0, 64 * 2**40)]))
        for name, engine, role in (("a", "mysql", "writer"), ("a", "mysql", "reader"), ("b", None, None), ("", "x", "y"))
        for metric in metrics
        for step in range(150)
    ]
    rows = curated(spark, samples).cache()
    load = spark.createDataFrame(
        [(r, AS_OF - timedelta(minutes=m), f"q{m % 13}", "s" * random.choice([5, 1300]), random.random()) for r in "ab" for m in range(40)],
        "resource_id string, sample_ts timestamp_ntz, sql_id string, sql_text string, active_sessions double",
    )
    rows.createOrReplaceTempView("sql_curated")
    load.createOrReplaceTempView("sql_load")
    create_report_functions(spark, "sql_curated", "sql_load")
    return rows, load


def same(spark, call, frame):
    got = spark.sql(f"SELECT * FROM {call}")
    assert set(got.columns) == set(frame.columns)
    assert rows_of(got, *frame.columns) == rows_of(frame, *frame.columns)
    return got


def test_functions_equal_reports(spark, fleet):
    rows, load = fleet
    where = (ACCOUNT, REGION)
    same(spark, f"fleet_health({WHERE}, DATE '2026-08-19', 7)", reports.health_on_date(rows, *where, "2026-08-19"))
    same(spark, f"fleet_storage({WHERE}, DATE '2026-08-19', 30)", reports.storage_forecast(rows, *where, "2026-08-19"))
    for month, today in (("2026-08", date(2026, 8, 21)), ("2026-08", date(2026, 9, 2)), ("2026-07", date(2026, 9, 2))):
        frame = reports.monthly_report(rows, *where, month, today=today)
        same(spark, f"fleet_months({WHERE}, '{month}', DATE '{today}')", frame)
    same(spark, f"fleet_top_sql(TIMESTAMP_NTZ '{AS_OF}', 30, 10)", reports.top_sql(load, AS_OF, 30))
    live = reports.live_health(rows, *where, ["a", "b"], AS_OF, 1440).where("has_data").drop("position", "has_data")
    asked = f"(SELECT * FROM fleet_live({WHERE}, TIMESTAMP_NTZ '{AS_OF}', 1440, 7) WHERE resource_id IN ('a', 'b'))"
    same(spark, asked, live)


def test_arguments_are_markers_and_reach_the_filters(spark, fleet):
    got = spark.sql(
        "SELECT * FROM fleet_health(:account, :region, :day, :days)",
        args={"account": ACCOUNT, "region": REGION, "day": date(2026, 8, 19), "days": 7},
    )
    assert got.count() == 4
    assert spark.sql(f"SELECT * FROM fleet_health('x', '{REGION}', DATE '2026-08-19', 7)").count() == 0


def test_rounding_text_equals_rounding_column(spark):
    values = [0.15, 0.25, 2.5, -0.05, 1.005, 1e17, -3.14159, 0.0, 123456.78905, None, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for decimals in (0, 1, 2, 4):
        both = df.select(even_round(F.col("x"), decimals), F.expr(even_round_text("x", decimals))).collect()
        assert all(a == b for a, b in both)
