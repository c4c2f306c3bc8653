"""The reports as SQL table functions, for users who write SQL.

``create_report_functions`` defines them over a curated table and a load table of the session::

    SELECT * FROM fleet_health('012345678901', 'ap-northeast-2', DATE '2026-08-19', 7)

Bodies are made of the same texts as the DataFrame reports (sums, roundings, statistics), and
arguments are part of the query, so filters on account, region and days prune partitions
as they do there. Rows come unordered: the caller's ``ORDER BY`` decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..catalog import (
    BASELINE_STATS,
    BYTES_PER_GIB,
    COMPARED_COLUMNS,
    HEALTH_STATS,
    LIVE_STATS,
    MONTHLY_STATS,
    SQL_TEXT_LIMIT,
    TRUNCATION_MARK,
    stat_columns,
)
from ..functions import exact
from ..functions.rounding import even_round_text, sql_round_text
from ..operators.health import DEVIATIONS, HEALTH_KEYS
from ..operators.metrics import wide_stats_sql
from ..operators.monthly import NOTABLE_CHANGE_PCT, PARTIAL_COVERAGE_RATIO
from ..operators.storage import FREE, MIN_HISTORY_POINTS, USED

_WHERE = "account_id = in_account AND region = in_region"


def _with_baseline(rows: str, curated: str, day: str, days: str, extra: Sequence[str] = ()) -> str:
    """``rows`` (a query with ``resource_id``) next to the trailing baseline of each."""
    past = wide_stats_sql(
        f"SELECT * FROM {curated} WHERE {_WHERE} AND date BETWEEN {day} - {days} AND {day}", ("resource_id",), BASELINE_STATS
    )
    score = ", ".join(
        f"CASE WHEN {spread} > 0 THEN ({now} - {mean}) / {spread} END AS {out}" for now, mean, spread, out in DEVIATIONS
    )
    scored = f"SELECT r.*, {', '.join('b.' + c for c in stat_columns(BASELINE_STATS))}, {score} "
    scored += f"FROM ({rows}) r LEFT JOIN ({past}) b ON r.resource_id = b.resource_id"
    rounded = ", ".join(f"{sql_round_text(out, 4)} AS {out}" for *_, out in DEVIATIONS)
    return f"SELECT * EXCEPT ({', '.join(out for *_, out in DEVIATIONS)}), {rounded} FROM ({scored})"


def _health(curated: str) -> str:
    day = wide_stats_sql(f"SELECT * FROM {curated} WHERE {_WHERE} AND date = in_day", HEALTH_KEYS, HEALTH_STATS)
    return _with_baseline(day, curated, "in_day", "in_days")


def _live(curated: str) -> str:
    # Every resource with recent samples: a list of requested ones is joined by the caller.
    since = "in_as_of - make_dt_interval(0, 0, in_minutes)"
    recent = f"SELECT * FROM {curated} WHERE {_WHERE} AND date BETWEEN CAST({since} AS DATE) AND CAST(in_as_of AS DATE)"
    recent += f" AND metric_timestamp > {since} AND metric_timestamp <= in_as_of"
    return _with_baseline(wide_stats_sql(recent, ("resource_id",), LIVE_STATS), curated, "CAST(in_as_of AS DATE)", "in_days")


def _storage(curated: str) -> str:
    history = f"""SELECT resource_id, date, min(CASE WHEN metric_name = '{FREE}' THEN value END) AS free,
        max(CASE WHEN metric_name = '{USED}' THEN value END) AS used FROM {curated}
        WHERE {_WHERE} AND date BETWEEN in_as_of - in_days AND in_as_of AND metric_name IN ('{FREE}', '{USED}')
        GROUP BY resource_id, date"""
    points = f"""SELECT resource_id, date, coalesce(free, used) AS bytes, free IS NOT NULL AS of_free,
        CAST(date_diff(date, in_as_of - in_days) AS BIGINT) AS x FROM ({history})
        WHERE resource_id <> '' AND coalesce(free, used) IS NOT NULL"""
    parted = exact.steps_sql(points, exact.parts_steps("_y", "bytes") + exact.product_steps("_xy", "x", "bytes"))
    sums = ", ".join(exact.sums("_y", "y") + exact.sums("_xy", "xy"))
    fitted = f"""SELECT resource_id, CAST(count(*) AS INT) AS history_days, max(date) AS latest_date, max(x) AS last_x,
        max_by(bytes, x) AS latest_value_bytes, max_by(of_free, x) AS is_free, sum(x) AS sum_x, sum(x * x) AS sum_xx, {sums}
        FROM ({parted}) GROUP BY resource_id"""
    line = exact.line("xy", "y", "history_days", "sum_x", "sum_xx", "last_x")
    lines = f"SELECT *, coalesce(line.slope, 0D) AS slope, rint(line.zero) AS zero_in FROM (SELECT *, {line} AS line FROM ({fitted}))"
    rounded = f"""SELECT *, CASE WHEN history_days >= {MIN_HISTORY_POINTS} THEN {even_round_text('slope', 2)} END AS trend_bytes_per_day,
        CASE WHEN history_days >= {MIN_HISTORY_POINTS} AND is_free AND slope < 0
             THEN try_cast(greatest(zero_in, 0D) AS BIGINT) END AS days_until_exhaustion,
        latest_value_bytes / {BYTES_PER_GIB}D AS value_gib FROM ({lines})"""
    in_gib = f"SELECT *, trend_bytes_per_day / {BYTES_PER_GIB}D AS trend_gib FROM ({rounded})"
    return f"""SELECT resource_id, CASE WHEN is_free THEN '{FREE}' ELSE '{USED}' END AS storage_metric, history_days, latest_date,
        latest_value_bytes, trend_bytes_per_day,
        CASE WHEN days_until_exhaustion <= date_diff(DATE '9999-12-31', latest_date)
             THEN date_add(latest_date, try_cast(days_until_exhaustion AS INT)) END AS projected_exhaustion_date,
        days_until_exhaustion, CASE WHEN history_days < {MIN_HISTORY_POINTS} THEN 'insufficient_history' END AS forecast_note,
        {even_round_text('value_gib', 2)} AS latest_value_gb, {even_round_text('trend_gib', 4)} AS trend_gb_per_day FROM ({in_gib})"""


def _top_sql(load: str) -> str:
    since = "in_as_of - make_dt_interval(0, 0, in_minutes)"
    samples = f"SELECT * FROM {load} WHERE sample_ts > {since} AND sample_ts <= in_as_of"
    parted = exact.steps_sql(samples, exact.parts_steps("_part", "active_sessions"))
    summed = f"""SELECT resource_id, sql_id, sql_text, count(active_sessions) AS known, {', '.join(exact.sums('_part', 'sessions'))}
        FROM ({parted}) GROUP BY resource_id, sql_id, sql_text"""
    counted = f"SELECT resource_id, count(DISTINCT sample_ts) AS samples FROM ({samples}) GROUP BY resource_id"
    loads = f"""SELECT s.resource_id, sql_id, sql_text, CASE WHEN known > 0 THEN {exact.mean('sessions', 'samples')} END AS average
        FROM ({summed}) s JOIN ({counted}) c ON s.resource_id = c.resource_id"""
    averaged = f"SELECT resource_id, sql_id, sql_text, {even_round_text('average', 4)} AS avg_active_sessions FROM ({loads})"
    ranked = f"""SELECT *, row_number() OVER (PARTITION BY resource_id
        ORDER BY avg_active_sessions DESC, sql_id, sql_text) AS rank FROM ({averaged})"""
    total = "CAST(sum(try_cast(avg_active_sessions AS DECIMAL(28,4))) OVER (PARTITION BY resource_id) AS DOUBLE)"
    shared = f"""SELECT resource_id, sql_id, avg_active_sessions, rank,
        CASE WHEN char_length(sql_text) > {SQL_TEXT_LIMIT} THEN concat(substring(sql_text, 1, {SQL_TEXT_LIMIT}), '{TRUNCATION_MARK}')
             ELSE sql_text END AS sql_text,
        coalesce(char_length(sql_text) > {SQL_TEXT_LIMIT}, false) AS sql_text_truncated,
        avg_active_sessions / nullif(greatest({total}, 0D), 0D) AS load_share FROM ({ranked}) WHERE rank <= in_k"""
    return f"""SELECT resource_id, sql_id, sql_text, avg_active_sessions, rank, sql_text_truncated,
        {even_round_text('load_share', 4)} AS load_share FROM ({shared})"""


def _months(curated: str) -> str:
    first = "CAST(concat(in_month, '-01') AS DATE)"
    before = f"date_format(add_months({first}, -1), 'yyyy-MM')"
    scoped = f"""SELECT *, date_format(date, 'yyyy-MM') AS month FROM {curated}
        WHERE {_WHERE} AND date BETWEEN add_months({first}, -1) AND last_day({first})"""
    days = "bit_count(bit_or(shiftleft(1, dayofmonth(date) - 1))) AS active_days"
    stats = wide_stats_sql(scoped, ("resource_id", "month", "engine", "cluster_role"), MONTHLY_STATS, days)
    names = stat_columns(MONTHLY_STATS)
    payload = f"struct(active_days, engine, cluster_role, {', '.join(names)})"
    weight = "struct(active_days, cluster_role, engine)"

    def chosen(which: str) -> str:
        return f"max_by(CASE WHEN {which} THEN {payload} END, CASE WHEN {which} THEN {weight} END)"

    # Aggregates may not mix arguments with columns, so rows are marked before.
    marked = f"SELECT *, month = in_month AS is_now FROM ({stats}) WHERE resource_id <> ''"
    paired = f"""SELECT resource_id, {chosen('is_now')} AS now, {chosen('NOT is_now')} AS prev
        FROM ({marked}) GROUP BY resource_id"""
    columns = []
    for name in names:
        columns.append(f"now.{name} AS {name}")
        if name in COMPARED_COLUMNS:
            columns.append(f"prev.{name} AS {name}_previous")
            columns.append(
                f"CASE WHEN prev.{name} <> 0 THEN (now.{name} - prev.{name}) / abs(prev.{name}) * 100 END AS {name}_change_pct"
            )
    compared = f"""SELECT resource_id, in_month AS month, {before} AS previous_month,
        coalesce(nullif(now.engine, ''), prev.engine) AS engine,
        coalesce(nullif(now.cluster_role, ''), prev.cluster_role) AS cluster_role,
        CAST(coalesce(now.active_days, 0) AS INT) AS active_days, dayofmonth(last_day({first})) AS days_in_month,
        CAST(coalesce(prev.active_days, 0) AS INT) AS previous_active_days, {', '.join(columns)} FROM ({paired})"""
    rounded = ", ".join(f"{even_round_text(f'{c}_change_pct', 1)} AS {c}_change_pct" for c in COMPARED_COLUMNS)
    steps = f"SELECT * EXCEPT ({', '.join(f'{c}_change_pct' for c in COMPARED_COLUMNS)}), {rounded} FROM ({compared})"
    notable = ", ".join(f"abs({c}_change_pct) >= {NOTABLE_CHANGE_PCT} AS {c}_notable" for c in COMPARED_COLUMNS)
    return f"""SELECT *, {notable}, CASE WHEN active_days = 0 THEN 'no_data'
        WHEN date_format(in_today, 'yyyy-MM') = in_month THEN 'month_in_progress'
        WHEN active_days < days_in_month * {PARTIAL_COVERAGE_RATIO} THEN 'partial_month' END AS coverage_note FROM ({steps})"""


def report_functions(curated: str, load: str) -> dict[str, tuple[str, str]]:
    """Name -> (parameters, body) of every function."""
    place = "in_account STRING, in_region STRING"
    return {
        "fleet_health": (f"{place}, in_day DATE, in_days INT", _health(curated)),
        "fleet_live": (f"{place}, in_as_of TIMESTAMP_NTZ, in_minutes INT, in_days INT", _live(curated)),
        "fleet_storage": (f"{place}, in_as_of DATE, in_days INT", _storage(curated)),
        "fleet_months": (f"{place}, in_month STRING, in_today DATE", _months(curated)),
        "fleet_top_sql": ("in_as_of TIMESTAMP_NTZ, in_minutes INT, in_k INT", _top_sql(load)),
    }


def create_report_functions(spark: SparkSession, curated: str, load: str) -> list[str]:
    """Define the functions in the session over two tables or views; return their names."""
    made = report_functions(curated, load)
    for name, (parameters, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {body}")
    return list(made)
