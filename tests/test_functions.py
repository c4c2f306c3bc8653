from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetmetrics.functions import calendar, validators
from fleetmetrics.functions.rounding import even_round, sql_round, sql_round_text
from fleetmetrics.functions.text import number_text, show_table
from fleetmetrics.functions.timestamps import iso_utc, parse_utc


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul", "America/New_York"])
def test_parse_utc_does_not_depend_on_the_session_zone(spark, zone):
    cases = {
        "2026-08-19T15:55:00+09:00": datetime(2026, 8, 19, 6, 55),
        "2026-08-19T06:55:00": datetime(2026, 8, 19, 6, 55),
        "2026-08-19T06:55:00Z": datetime(2026, 8, 19, 6, 55),
        "2026-08-19T06:55:00.123456Z": datetime(2026, 8, 19, 6, 55, 0, 123456),
        "2026-08-19": datetime(2026, 8, 19),
        "2026-11-01T01:30:00-04:00": datetime(2026, 11, 1, 5, 30),
        "2026-11-01T01:30:00-05:00": datetime(2026, 11, 1, 6, 30),
        "yesterday": None,
        "T06:55:00Z": None,
        "": None,
    }
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(list(cases.items()), "s string, t timestamp_ntz")
        got = dict(df.select("s", parse_utc(F.col("s")).alias("p")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == cases


def test_iso_text_shows_microseconds_only_when_present(spark):
    df = spark.createDataFrame(
        [(datetime(2026, 8, 19, 6, 55),), (datetime(2026, 8, 19, 6, 55, 0, 5),)], "t timestamp_ntz"
    )
    assert [r[0] for r in df.select(iso_utc(F.col("t"))).collect()] == [
        "2026-08-19T06:55:00Z",
        "2026-08-19T06:55:00.000005Z",
    ]


_TIES = st.builds(lambda n, d: n / 10**d, st.integers(-10**7, 10**7), st.integers(0, 5))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(_TIES, st.floats(-1e9, 1e9)), min_size=200, max_size=400))
def test_even_round_equals_python_round(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for decimals in (0, 1, 2, 4):
        for x, got in df.select("x", even_round(F.col("x"), decimals)).collect():
            assert got == round(x, decimals) or (got == 0 == round(x, decimals)), (x, decimals)


def test_sql_round_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.005,), (0.125,), (None,)], "x double")
    whole = [r[0] for r in df.select(sql_round(F.col("x"), 0)).collect()]
    two = [r[0] for r in df.select(sql_round(F.col("x"), 2)).collect()]
    assert whole == [3.0, -3.0, 1.0, 0.0, None]
    assert two == [2.5, -2.5, 1.0, 0.13, None]


def test_rounding_leaves_doubles_without_a_fraction(spark):
    values = [70368744177663.234375, 4503599627370497.0, -1e300, 8589934592.33335]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    by_text = [r[0] for r in df.select(F.expr(sql_round_text("x", 4))).collect()]
    assert by_text == [r[0] for r in df.select(sql_round(F.col("x"), 4)).collect()]
    assert by_text[1:3] == values[1:3] and by_text[0] == values[0]
    assert by_text[3] == pytest.approx(8589934592.3334, abs=1e-9)


def test_number_text_is_plain(spark):
    df = spark.createDataFrame([(44.0,), (1.5e10,), (0.0001,), (12.25,), (None,)], "x double")
    assert [r[0] for r in df.select(number_text(F.col("x"))).collect()] == [
        "44.0", "15000000000.0", "0.0001", "12.25", None,
    ]


@pytest.mark.parametrize(
    "kind, good, bad",
    [
        ("account_id", "012345678901", ["12345", "01234567890a", "012345678901\n", "0123456789012"]),
        ("region", "ap-northeast-2", ["ap-northeast", "us-gov-west-1", "AP-northeast-2", "x'; drop"]),
        ("month", "2026-07", ["2026-13", "2026-00", "2026-7", "2026-07-01"]),
        ("resource_id", "orders_a-1", ["a b", "a'b", "", "a;b"]),
        ("dbi_resource_id", "db-ABC123", ["db-abc", "ABC", "db-"]),
    ],
)
def test_shapes(spark, kind, good, bad):
    assert validators.check(good, kind) == good
    for value in bad:
        with pytest.raises(ValueError):
            validators.check(value, kind)
    df = spark.createDataFrame([(v,) for v in [good, *bad]], "v string")
    assert [r[0] for r in df.select(validators.has_shape(F.col("v"), kind)).collect()] == [True] + [False] * len(bad)


def test_dates_must_exist():
    assert validators.check_date("2026-02-28") == date(2026, 2, 28)
    for bad in ("2026-13-45", "2026-02-30", "26-01-01", "2026-01-01\n"):
        with pytest.raises(ValueError):
            validators.check_date(bad)


def test_lookback_bounds():
    assert validators.check_lookback_minutes(1440) == 1440
    for bad in (0, -5, 1441):
        with pytest.raises(ValueError):
            validators.check_lookback_minutes(bad)


def test_calendar_edges(spark):
    assert calendar.previous_month("2026-01") == "2025-12"
    assert calendar.month_bounds("2024-02") == (date(2024, 2, 1), date(2024, 2, 29))
    assert calendar.month_day_count("2026-02") == 28
    assert calendar.default_report_month(date(2026, 1, 5)) == "2025-12"
    df = spark.createDataFrame([("2026-01",), ("2024-03",)], "m string")
    assert [r[0] for r in df.select(calendar.previous_month_of(F.col("m"))).collect()] == ["2025-12", "2024-02"]
    with pytest.raises(ValueError):
        calendar.previous_month("2026-13")


def test_show_table(spark, capsys):
    show_table(spark.createDataFrame([("a", None, 1.5e10)], "k string, n int, x double"), 20)
    assert "|a  |   |15000000000.0|" in capsys.readouterr().out
    show_table(spark.createDataFrame([], "k string"), 20)
    assert capsys.readouterr().out == "(no rows)\n"


def test_number_text_survives_extremes(spark):
    df = spark.createDataFrame([(1e300,), (float("inf"),)], "x double")
    assert all(isinstance(r[0], str) and not math.isnan(len(r[0])) for r in df.select(number_text(F.col("x"))).collect())
