"""Exact sums against rational arithmetic, whatever the order and size of the values."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fleetmetrics.functions import exact
from fleetmetrics.operators.health import baseline
from fleetmetrics.operators.monthly import monthly_aggregate
from fleetmetrics.operators.storage import storage_forecast
from fleetmetrics.plans import reports

from .helpers import ACCOUNT, REGION, at, curated, history

GIB, TIB = 1 << 30, 1 << 40


def aggregated(df):
    df = exact.with_product_parts(exact.with_parts(df, "_v", "y"), "_vv", "y", "y")
    df = exact.with_product_parts(df, "_xv", "x", "y")
    columns = exact.sums("_v", "s") + exact.sums("_vv", "q") + exact.sums("_xv", "p")
    columns += ["count(y) AS n", "sum(x) AS sx", "sum(x * x) AS sxx", "max(x) AS last"]
    grouped = df.groupBy("g").agg(*map(F.expr, columns))
    return grouped.selectExpr(
        "g",
        exact.mean("s", "n") + " AS mean",
        exact.deviation("s", "q", "n") + " AS deviation",
        exact.line("p", "s", "n", "sx", "sxx", "last") + " AS line",
    )


@pytest.fixture(scope="module")
def groups():
    random.seed(7)
    made = {
        0: [8 * GIB + random.random() for _ in range(60)],
        1: [64.0 * TIB + random.randrange(4) for _ in range(500)],
        2: [random.choice([-1, 1]) * random.random() * 10 ** random.randrange(-6, 14) for _ in range(200)],
        3: [0.1] * 10,
        4: [random.uniform(0, 1e-3) for _ in range(50)],
        5: [1e16, 1.0, -1e16] * 5,
        6: [42.0],
    }
    return {g: [(g, 20_000 + x, y) for x, y in enumerate(ys)] for g, ys in made.items()}


def nearest(value: Fraction) -> float:
    return value.numerator / value.denominator


def test_means_deviations_and_lines_equal_rational_arithmetic(spark, groups):
    rows = [r for part in groups.values() for r in part]
    got = {r.g: r for r in aggregated(spark.createDataFrame(rows, "g int, x long, y double")).collect()}
    for g, part in groups.items():
        n, ys, xs = len(part), [Fraction(y) for _, _, y in part], [x for _, x, _ in part]
        assert got[g].mean == pytest.approx(nearest(sum(ys) / n), rel=2.5e-16, abs=1e-30)
        rise = n * sum(x * y for x, y in zip(xs, ys)) - sum(xs) * sum(ys)
        run = n * sum(x * x for x in xs) - sum(xs) ** 2
        if n == 1:
            assert got[g].deviation is None and got[g].line.slope is None
            continue
        spread = (n * sum(y * y for y in ys) - sum(ys) ** 2) / (n * (n - 1))
        assert got[g].deviation == pytest.approx(math.sqrt(spread), rel=1e-15)
        assert got[g].line.slope == pytest.approx(nearest(rise / run), rel=1e-15)
        if rise:
            zero = Fraction(sum(xs), n) - sum(ys) * run / (n * rise) - max(xs)
            assert got[g].line.zero == pytest.approx(nearest(zero), rel=1e-14)


def test_large_means_keep_every_digit(spark, groups):
    rows = groups[0] + groups[1]
    got = {r.g: r.mean for r in aggregated(spark.createDataFrame(rows, "g int, x long, y double")).collect()}
    for g in (0, 1):
        assert got[g] == nearest(sum(Fraction(y) for _, _, y in groups[g]) / len(groups[g]))


def test_order_and_partitions_do_not_show(spark, groups):
    rows = [r for part in groups.values() for r in part]
    answers = set()
    for seed, parts in ((1, 1), (2, 3), (3, 7), (4, 13)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g int, x long, y double").repartition(parts)
        answers.add(str(sorted(aggregated(df).collect())))
    assert len(answers) == 1


def test_values_without_parts_and_missing_ones(spark):
    rows = [(1, 1, float("nan")), (1, 2, 5.0), (2, 1, float("inf")), (2, 2, 1.0), (3, 1, 1e40), (3, 2, 1e40), (4, 1, None)]
    rows += [(5, 1, 3.0), (5, 2, None), (5, 3, 5.0)]
    got = {r.g: r for r in aggregated(spark.createDataFrame(rows, "g int, x long, y double")).collect()}
    assert math.isnan(got[1].mean) and math.isnan(got[1].deviation)
    assert got[2].mean == float("inf")
    assert got[3].mean == pytest.approx(1e40)
    assert got[4].mean is None and got[4].deviation is None
    assert got[5].mean == 4.0 and got[5].deviation == pytest.approx(math.sqrt(2))


def test_baseline_and_months_of_large_byte_metrics(spark):
    memory = [8.0 * GIB, 8.0 * GIB, 8.0 * GIB + 1]
    space = [64.0 * TIB] * 5
    samples = [("a", "mysql", "writer", "FreeableMemory", at(f"2026-08-0{d + 1}T00:00:00"), v) for d, v in enumerate(memory)]
    samples += [("a", "mysql", "writer", "FreeStorageSpace", at(f"2026-08-0{d + 1}T00:05:00"), v) for d, v in enumerate(space)]
    row = baseline(curated(spark, samples)).first()
    assert row.freeable_memory_avg_baseline_bytes == round(nearest(sum(map(Fraction, memory)) / 3), 4) == 8589934592.3333
    assert row.free_storage_space_avg_baseline_bytes == 70368744177664.0
    assert monthly_aggregate(curated(spark, samples)).first().free_storage_space_min_bytes == 70368744177664.0
    report = reports.health_on_date(curated(spark, samples), ACCOUNT, REGION, "2026-08-03").first()
    assert report.freeable_memory_avg_baseline_bytes == 8589934592.3333


def test_slope_of_a_large_volume(spark):
    days = [("a", f"2026-08-{d + 1:02d}", 64.0 * TIB - d * 123_456_789_012.25, None) for d in range(10)]
    row = storage_forecast(history(spark, days)).first()
    assert row.trend_bytes_per_day == -123456789012.25
    zero = Fraction(64 * TIB) / Fraction(123_456_789_012.25) - 9
    assert row.days_until_exhaustion == round(zero)
