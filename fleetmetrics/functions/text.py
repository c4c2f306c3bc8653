"""Report lines: rows as ``key=value, ...`` text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..catalog import BYTES_PER_GIB, COMPARED_COLUMNS
from .rounding import even_round


def number_text(x: Column) -> Column:
    """A double as plain decimal text (never ``1.5E10``), with at least one decimal."""
    shown = x.cast("string")
    digits = F.regexp_replace(x.try_cast("decimal(38,10)").cast("string"), r"0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    return F.when(F.contains(shown, F.lit("E")), F.coalesce(plain, shown)).otherwise(shown)


def _text(df: DataFrame, column: str) -> Column:
    is_double = df.schema[column].dataType.typeName() == "double"
    return number_text(F.col(column)) if is_double else F.col(column).cast("string")


def pair(label: str, text: Column) -> Column:
    """``label=text``; NULL (and so left out of a line) when there is no text."""
    return F.concat(F.lit(f"{label}="), text)


def pair_or_none(label: str, text: Column) -> Column:
    """``label=text``, spelling a missing value as ``None``."""
    return F.concat(F.lit(f"{label}="), F.coalesce(text, F.lit("None")))


def line(df: DataFrame, columns: Sequence[str], keep_missing: Sequence[str] = ()) -> Column:
    """The given columns of a row as one line; only ``keep_missing`` show ``None``."""
    return F.concat_ws(
        ", ",
        *[(pair_or_none if c in keep_missing else pair)(c, _text(df, c)) for c in columns],
    )


def health_line(df: DataFrame) -> DataFrame:
    """Add ``line`` with every column of a health row; absent baselines are left out."""
    own = [c for c in df.columns if "baseline" not in c and not c.endswith("_deviation")]
    history = [c for c in df.columns if "baseline" in c]
    return df.withColumn("line", line(df, [*own, *history], keep_missing=own))


def forecast_line(df: DataFrame) -> DataFrame:
    """Add ``line`` for a forecast row that carries its GiB columns."""
    columns = (
        "resource_id",
        "storage_metric",
        "history_days",
        "latest_date",
        "latest_value_gb",
        "trend_gb_per_day",
        "projected_exhaustion_date",
        "days_until_exhaustion",
        "forecast_note",
    )
    return df.withColumn("line", line(df, columns, keep_missing=columns))


def _change(column: str) -> Column:
    """``column=now (prev=..., change=...%)``, whatever of it is known."""
    change = F.concat(F.lit(", change="), number_text(F.col(f"{column}_change_pct")), F.lit("%"))
    previous = F.concat(
        F.lit(" (prev="),
        number_text(F.col(f"{column}_previous")),
        F.coalesce(change, F.lit("")),
        F.lit(")"),
    )
    return F.concat(pair(column, number_text(F.col(column))), F.coalesce(previous, F.lit("")))


def monthly_line(df: DataFrame) -> DataFrame:
    """Add ``line`` for a month-over-month row; metrics without data are left out."""
    header = (
        "resource_id",
        "engine",
        "cluster_role",
        "active_days",
        "days_in_month",
        "previous_active_days",
        "coverage_note",
    )
    in_gib = (
        ("freeable_memory_min_bytes", "freeable_memory_min_gb"),
        ("free_storage_space_min_bytes", "free_storage_space_min_gb"),
        ("volume_bytes_used_max", "volume_bytes_used_max_gb"),
    )
    return df.withColumn(
        "line",
        F.concat_ws(
            ", ",
            *[pair_or_none(c, _text(df, c)) for c in header],
            *[_change(c) for c in COMPARED_COLUMNS],
            pair("aurora_replica_lag_max", number_text(F.col("aurora_replica_lag_max"))),
            *[
                pair(label, number_text(even_round(F.col(c) / BYTES_PER_GIB, 2)))
                for c, label in in_gib
            ],
        ),
    )


def top_sql_line(df: DataFrame) -> DataFrame:
    """Add ``line`` for a ranked statement."""
    start = F.concat(
        F.lit("["), F.col("resource_id"), F.lit("] Top SQL #"), F.col("rank").cast("string"), F.lit(": ")
    )
    body = line(
        df,
        ("avg_active_sessions", "sql_id", "sql_text_truncated", "sql_text"),
        keep_missing=("avg_active_sessions", "sql_id", "sql_text_truncated", "sql_text"),
    )
    return df.withColumn("line", F.concat(start, body))


def table_text(df: DataFrame) -> DataFrame:
    """Every cell of a report as the text shown for it; NULL is blank."""
    return df.select(*[F.coalesce(_text(df, c), F.lit("")).alias(c) for c in df.columns])


def show_table(df: DataFrame, rows: int) -> None:
    """Print up to ``rows`` rows of a report as an aligned table."""
    if df.isEmpty():
        print("(no rows)")
        return
    table_text(df).show(rows, truncate=False)
