"""Conditional metric aggregates: the long metric table to one wide row per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exact
from ..functions.rounding import sql_round_text

Stats = Sequence[tuple[str, str, str, int]]


def of_metric(metric: str) -> Column:
    """``value`` where the row belongs to ``metric``, else NULL."""
    return F.when(F.col("metric_name") == metric, F.col("value"))


def _metrics(stats: Stats, *aggregates: str) -> list[str]:
    """Metrics of which one of the aggregates is asked."""
    return list(dict.fromkeys(metric for metric, aggregate, _, _ in stats if aggregate in aggregates))


def _names(metric: str) -> tuple[str, str, str]:
    """Names of the metric's sum, sum of squares and count."""
    return f"sum_{metric}", f"squares_{metric}", f"count_{metric}"


def value_steps(stats: Stats) -> list[dict[str, str]]:
    """Projections that add the parts of ``value`` (and of its square) that the sums of ``stats`` need."""
    steps = exact.parts_steps("_part", "value") if _metrics(stats, "avg", "stddev") else []
    return steps + (exact.product_steps("_square", "value", "value") if _metrics(stats, "stddev") else [])


def with_value_parts(df: DataFrame, stats: Stats) -> DataFrame:
    return exact.with_steps(df, value_steps(stats))


def _of(metric: str, column: str = "value") -> str:
    return f"CASE WHEN metric_name = '{metric}' THEN {column} END"


def mergeable_stats(stats: Stats) -> list[str]:
    """Aggregates over :func:`with_value_parts` whose partial results add up in any order."""
    return _aggregates(stats, lambda metric: f"count({_of(metric)})", {"min": "value", "max": "value"})


def merged_states(stats: Stats) -> list[str]:
    """The same aggregates over daily states (:mod:`.rollup`) in place of samples."""
    return _aggregates(
        stats, lambda metric: f"coalesce(sum({_of(metric, 'n')}), 0)", {"min": "low", "max": "high"}
    )


def _aggregates(stats: Stats, counted: Callable[[str], str], extremes: dict[str, str]) -> list[str]:
    columns: list[str] = []
    for metric in _metrics(stats, "avg", "stddev"):
        total, _, count = _names(metric)
        columns += exact.sums("_part", total, f"metric_name = '{metric}'")
        columns.append(f"{counted(metric)} AS {count}")
    for metric in _metrics(stats, "stddev"):
        columns += exact.sums("_square", _names(metric)[1], f"metric_name = '{metric}'")
    return columns + [f"{a}({_of(m, extremes[a])}) AS {c}" for m, a, c, _ in stats if a in extremes]


def finishing(stats: Stats) -> tuple[list[str], list[str]]:
    """Two projections of aggregated rows: means, deviations and extremes, and the same rounded.

    Rounded in a second step: one reference per value keeps the plan small.
    """

    def value(metric: str, aggregate: str, column: str) -> str:
        total, squares, count = _names(metric)
        if aggregate == "avg":
            return f"{exact.mean(total, count)} AS {column}"
        if aggregate == "stddev":
            return f"{exact.deviation(total, squares, count)} AS {column}"
        return column

    rounded = [f"{sql_round_text(c, decimals)} AS {c}" for _, _, c, decimals in stats]
    return [value(m, a, c) for m, a, c, _ in stats], rounded


def finished_stats(grouped: DataFrame, stats: Stats, *kept: str) -> DataFrame:
    """``kept`` columns of aggregated rows, and the statistics, rounded."""
    values, rounded = finishing(stats)
    return grouped.selectExpr(*kept, *values).selectExpr(*kept, *rounded)


def stats_by_metric(df: DataFrame, keys: Sequence[str], stats: Stats) -> DataFrame:
    """:func:`wide_stats` for many groups of few rows each: summed metric by metric, then put side by side.

    A group costs the buffers of the metrics it has, not those of all. Rows already dealt out by
    some of ``keys`` are not shuffled again. The average of one value is that value: whole sums are
    divided for groups of several only. For averages and extremes.
    """
    kinds = {"avg": f"CASE WHEN n = 1 THEN low ELSE {exact.mean('total', 'n')} END", "min": "low", "max": "high"}
    by_metric = (
        exact.with_parts(df, "_part", "value")
        .groupBy(*keys, "metric_name")
        .agg(*map(F.expr, (*exact.sums("_part", "total"), "count(value) AS n", "min(value) AS low", "max(value) AS high")))
        .selectExpr(*keys, "metric_name", *[f"{kinds[kind]} AS {kind}" for kind in dict.fromkeys(a for _, a, _, _ in stats)])
    )
    wide = by_metric.groupBy(*keys).agg(*[F.expr(f"max({_of(m, a)}) AS {c}") for m, a, c, _ in stats])
    return wide.selectExpr(*keys, *finishing(stats)[1])


def wide_stats_sql(source: str, keys: Sequence[str], stats: Stats, *extra: str) -> str:
    """:func:`wide_stats` of the query ``source`` as a SQL text; ``extra`` are named aggregates."""
    kept = [*keys, *[e.rsplit(" AS ", 1)[1] for e in extra]]
    parted = exact.steps_sql(source, value_steps(stats))
    grouped = f"SELECT {', '.join([*keys, *extra, *mergeable_stats(stats)])} FROM ({parted}) GROUP BY {', '.join(keys)}"
    values, rounded = finishing(stats)
    return f"SELECT {', '.join([*kept, *rounded])} FROM (SELECT {', '.join([*kept, *values])} FROM ({grouped}))"


def wide_stats(df: DataFrame, keys: Sequence[str], stats: Stats, *extra: Column) -> DataFrame:
    """``keys``, ``extra`` and all ``stats`` of each group, from one hash aggregate.

    Every statistic has a fixed-size buffer, so map tasks send one row per
    group they saw, and a group holding a third of all rows costs the reducer
    no more than any other. Sums are exact (:mod:`..functions.exact`): the order
    in which partial results meet cannot show. No filter on metric names is
    added: a resource with other metrics only must still give a row.
    """
    sums = mergeable_stats(stats)
    grouped = with_value_parts(df, stats).groupBy(*keys).agg(*extra, *map(F.expr, sums))
    return finished_stats(grouped, stats, *grouped.columns[: len(grouped.columns) - len(sums)])
