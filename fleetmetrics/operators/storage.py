"""Daily storage history and the straight-line exhaustion forecast."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalog import BYTES_PER_GIB
from ..functions import exact
from ..functions.rounding import even_round, with_even_round
from .metrics import of_metric

FREE, USED = "FreeStorageSpace", "VolumeBytesUsed"
MIN_HISTORY_POINTS = 3
_LAST_DAY = date(9999, 12, 31)


def storage_history(scoped: DataFrame) -> DataFrame:
    """Lowest free space and highest used volume per resource and day.

    Only two metrics are asked for, and that filter reaches the Parquet scan.
    """
    return (
        scoped.where(F.col("metric_name").isin(FREE, USED))
        .groupBy("resource_id", "date")
        .agg(
            F.min(of_metric(FREE)).alias("free_storage_space_bytes"),
            F.max(of_metric(USED)).alias("volume_bytes_used"),
        )
    )


def storage_points(history: DataFrame) -> DataFrame:
    """One point per resource and day: free space if known, else used volume."""
    free, used = F.col("free_storage_space_bytes"), F.col("volume_bytes_used")
    known = (F.col("resource_id") != "") & F.col("date").isNotNull()
    return history.where(known & F.coalesce(free, used).isNotNull()).select(
        "resource_id",
        "date",
        F.coalesce(free, used).alias("bytes"),
        F.when(free.isNotNull(), FREE).otherwise(USED).alias("storage_metric"),
    )


def storage_forecast(history: DataFrame, anchor: date = date(1970, 1, 1)) -> DataFrame:
    """Least-squares line per resource and, for shrinking free space, its zero day.

    Days are counted from ``anchor`` (pass the start of the window), so the fit
    is one mergeable aggregate of exact sums and needs no per-resource first day. The zero of
    the fitted line, not the latest value, sets the day; cluster volume never
    gets one. The line is NULL below three points; a date beyond the calendar
    is NULL while its day count stays.
    """
    points = with_line_parts(storage_points(history), anchor)
    fitted = points.groupBy("resource_id").agg(*line_sums())
    return finished_forecast(fitted)


def rolling_forecast(history: DataFrame, first: date, last: date, days: int = 30) -> DataFrame:
    """The forecast of ``as_of - days`` .. ``as_of`` for every ``as_of`` from ``first`` to ``last``.

    One pass instead of one fit a day: each point adds its sums on its own day and takes them
    back ``days + 1`` later, and a running sum over the days of a resource holds what is in the
    window. Sums are whole numbers, so nothing of a point stays behind, and every row equals the
    forecast of its window alone. A window without a point gives no row.
    """
    anchor = first - timedelta(days=days)
    points = storage_points(history).where(F.col("date").between(anchor, last))
    latest = F.struct("date", "x", "bytes", (F.col("storage_metric") == FREE).alias("is_free"))
    parted = with_line_parts(points, anchor).withColumn("latest", latest)
    sums = [f"{s}_{i}" for s in ("y", "xy") for i in range(exact.LIMBS)]
    moves = F.array(
        F.struct(F.col("x").alias("day"), F.lit(1).alias("sign"), "latest"),
        F.struct((F.col("x") + days + 1).alias("day"), F.lit(-1).alias("sign"), F.lit(None).alias("latest")),
    )
    signed = parted.select("resource_id", "x", *[F.col(f"_{s}") for s in (*sums, "xy_x")], F.explode(moves).alias("move"))
    sign, x = F.col("move.sign"), F.col("x")
    whole = {"history_days": F.lit(1), "sum_x": x, "sum_xx": x * x, "odd": F.col("_xy_x").isNotNull().cast("int")}
    whole |= {s: F.coalesce(F.col(f"_{s}"), F.lit(0)) for s in sums}
    moved = signed.select(
        "resource_id",
        F.col("move.day").alias("day"),
        F.col("move.latest").alias("latest"),
        F.lit(False).alias("asked"),
        *[(sign * c).cast("decimal(38,0)").alias(n) for n, c in whole.items()],
    )
    asked = points.select("resource_id").distinct().select(
        "resource_id",
        F.explode(F.sequence(F.lit(days).cast("long"), F.lit((last - anchor).days).cast("long"))).alias("day"),
    )
    asked = asked.withColumn("asked", F.lit(True))
    per_day = (
        moved.unionByName(asked, allowMissingColumns=True)
        .groupBy("resource_id", "day")
        .agg(F.max("latest").alias("latest"), F.max("asked").alias("asked"), *[F.sum(n).alias(n) for n in whole])
    )
    so_far = Window.partitionBy("resource_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    running = per_day.select(
        "resource_id",
        F.date_add(F.lit(anchor), F.col("day").cast("int")).alias("as_of"),
        "asked",
        F.last("latest", ignorenulls=True).over(so_far).alias("latest"),
        *[F.coalesce(F.sum(n).over(so_far), F.lit(0)).cast("decimal(38,0)").alias(n) for n in whole],
    )
    unknown = F.when(F.col("odd") > 0, F.lit(float("nan")))
    return finished_forecast(
        running.where(F.col("asked") & (F.col("history_days") > 0)).withColumns(
            {
                "history_days": F.col("history_days").cast("int"),
                "latest_date": F.col("latest.date"),
                "last_x": F.col("latest.x"),
                "latest_value_bytes": F.col("latest.bytes"),
                "is_free": F.col("latest.is_free"),
                "y_x": unknown,
                "xy_x": unknown,
            }
        ),
        "as_of",
    )


def with_line_parts(points: DataFrame, anchor: date) -> DataFrame:
    """Points with the day number ``x`` and the exact parts of ``bytes`` and of ``x * bytes``."""
    points = points.withColumn("x", F.date_diff("date", F.lit(anchor)).cast("long"))
    points = exact.with_parts(points, "_y", "bytes")
    return exact.with_product_parts(points, "_xy", "x", "bytes")


def line_sums() -> list[Column]:
    """Aggregates of a group of points that the line and the latest point follow from."""
    return [
        F.count("*").cast("int").alias("history_days"),
        F.max("date").alias("latest_date"),
        F.max("x").alias("last_x"),
        F.max_by("bytes", "x").alias("latest_value_bytes"),
        F.max_by(F.col("storage_metric") == FREE, F.col("x")).alias("is_free"),
        F.sum("x").alias("sum_x"),
        F.sum(F.col("x") * F.col("x")).alias("sum_xx"),
        *map(F.expr, exact.sums("_y", "y") + exact.sums("_xy", "xy")),
    ]


def finished_forecast(fitted: DataFrame, *keys: str) -> DataFrame:
    """The forecast of each row of :func:`line_sums`; ``keys`` come along."""
    line = exact.line("xy", "y", "history_days", "sum_x", "sum_xx", "last_x")
    fitted = fitted.withColumn("line", F.expr(line)).withColumns({"slope": F.col("line.slope"), "zero_in": F.col("line.zero")})
    enough = F.col("history_days") >= MIN_HISTORY_POINTS
    fitted = fitted.withColumns({"slope": F.coalesce("slope", F.lit(0.0)), "zero_in": even_round(F.col("zero_in"))})
    fitted = with_even_round(fitted.withColumn("trend", F.col("slope")), "trend", 2)
    days = F.greatest(F.col("zero_in"), F.lit(0.0)).try_cast("long")
    room = F.date_diff(F.lit(_LAST_DAY), "latest_date")
    return (
        fitted.withColumn(
            "days_until_exhaustion",
            F.when(enough & F.col("is_free") & (F.col("slope") < 0), days),
        )
        .select(
            "resource_id",
            *keys,
            F.when(F.col("is_free"), FREE).otherwise(USED).alias("storage_metric"),
            "history_days",
            "latest_date",
            "latest_value_bytes",
            F.when(enough, F.col("trend")).alias("trend_bytes_per_day"),
            F.when(
                F.col("days_until_exhaustion") <= room,
                F.date_add("latest_date", F.col("days_until_exhaustion").try_cast("int")),
            ).alias("projected_exhaustion_date"),
            "days_until_exhaustion",
            F.when(~enough, "insufficient_history").alias("forecast_note"),
        )
    )


def with_gib(forecast: DataFrame) -> DataFrame:
    """Add the latest value and the trend in GiB (two and four decimals)."""
    return forecast.withColumns(
        {
            "latest_value_gb": even_round(F.col("latest_value_bytes") / BYTES_PER_GIB, 2),
            "trend_gb_per_day": even_round(F.col("trend_bytes_per_day") / BYTES_PER_GIB, 4),
        }
    )
