"""Flatten payloads to one row per datapoint, with required-value checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timestamps import parse_utc
from ..schemas import CURATED
from ..sources.raw import CORRUPT, LIST_TYPE

REASON = "reject_reason"
POSITION = "point_pos"

_COPIED = (
    "target_name",
    "engine",
    "cluster_identifier",
    "cluster_role",
    "metric_profile",
    "resource_profile",
    "statistic",
    "unit",
    "period_seconds",
)


def missing_or_blank(column: Column, label: str) -> Column:
    """"Missing <label>" for NULL, "Empty <label>" for blank text, else NULL."""
    return F.when(column.isNull(), F.lit(f"Missing {label}")).when(
        column.rlike(r"(?U)^\s*$"), F.lit(f"Empty {label}")
    )


def _first_reason(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


def headers(raw: DataFrame) -> DataFrame:
    """One row per payload: resolved header, datapoints, and a reject reason.

    Account and region come from the payload and fall back on the path when
    the payload has none (NULL or empty; blank text does not fall back).
    """
    account = F.coalesce(F.nullif(F.col("source_account_id"), F.lit("")), F.col("path_account_id"))
    region = F.coalesce(F.nullif(F.col("region"), F.lit("")), F.col("path_region"))
    collected = F.col("collected_at")
    malformed = (
        F.when(
            F.col(CORRUPT).isNotNull() & F.col("resource_id").isNotNull() & F.col("datapoints").isNull(),
            F.lit("datapoints must be a list"),
        ).when(F.col(CORRUPT).isNotNull(), F.lit("Malformed payload"))
        if CORRUPT in raw.columns
        else F.lit(None).cast("string")
    )
    reason = _first_reason(
        malformed,
        missing_or_blank(account, "source_account_id"),
        missing_or_blank(region, "region"),
        missing_or_blank(F.col("resource_id"), "resource_id"),
        missing_or_blank(F.col("metric_name"), "metric_name"),
        missing_or_blank(collected, "collected_at"),
        F.when(parse_utc(collected).isNull(), F.lit("Invalid collected_at")),
        *_list_reasons(raw),
    )
    return raw.select(
        account.alias("account_id"),
        region.alias("region"),
        "resource_id",
        "metric_name",
        parse_utc(collected).alias("collected_at"),
        "source_file",
        *_COPIED,
        F.coalesce("datapoints", F.array().cast(raw.schema["datapoints"].dataType)).alias("datapoints"),
        reason.alias(REASON),
    )


def _list_reasons(raw: DataFrame) -> list[Column]:
    """A missing list is an empty one; anything else than a list, JSON ``null`` too, is refused."""
    if LIST_TYPE not in raw.columns:
        return []
    return [F.when(~F.col(LIST_TYPE).startswith("ARRAY"), F.lit("datapoints must be a list"))]


def points(header_rows: DataFrame, strict: bool = False) -> DataFrame:
    """One row per datapoint of each payload, with position and reject reason.

    With ``strict`` a bad datapoint raises while its values are computed; that
    way each timestamp is parsed once, not once more for a filter.
    """
    exploded = header_rows.select(
        "*", F.posexplode("datapoints").alias(POSITION, "point")
    ).drop("datapoints")
    if not strict:
        return _checked(exploded)
    stamp, number, bad_stamp, bad_number = _point_values()
    at_file = F.concat(F.lit(": "), F.col("source_file"))
    columns = {
        "metric_timestamp": F.coalesce(
            stamp, F.raise_error(F.concat(bad_stamp, at_file)).cast("timestamp_ntz")
        ),
        "value": F.coalesce(number, F.raise_error(F.concat(bad_number, at_file)).cast("double")),
    }
    return exploded.withColumns(columns).drop("point")


def _point_values() -> tuple[Column, Column, Column, Column]:
    """Sample time and value of ``point``, and what is wrong with either if it is NULL."""
    when, value = F.col("point.timestamp"), F.col("point.value")
    bad_stamp = F.coalesce(
        missing_or_blank(when, "datapoint.timestamp"), F.lit("Invalid datapoint.timestamp")
    )
    bad_number = F.coalesce(missing_or_blank(value, "datapoint.value"), F.lit("Invalid datapoint.value"))
    return parse_utc(when), value.try_cast("double"), bad_stamp, bad_number


def _checked(exploded: DataFrame) -> DataFrame:
    stamp, number, bad_stamp, bad_number = _point_values()
    reason = _first_reason(
        F.col(REASON), F.when(stamp.isNull(), bad_stamp), F.when(number.isNull(), bad_number)
    )
    return exploded.withColumns({"metric_timestamp": stamp, "value": number, REASON: reason}).drop("point")


def judged(header_rows: DataFrame) -> DataFrame:
    """Everything a set of payloads holds, good and bad, from one pass over it.

    A row per datapoint of an accepted payload, with its own reason if it is refused, and one row
    without a position for each refused payload. :func:`accepted` and :func:`refused` part them.
    """
    open_lists = F.when(F.col(REASON).isNull(), F.col("datapoints"))
    exploded = header_rows.withColumn("datapoints", open_lists).select(
        "*", F.posexplode_outer("datapoints").alias(POSITION, "point")
    )
    held = exploded.where(F.col(POSITION).isNotNull() | F.col(REASON).isNotNull())
    return _checked(held.drop("datapoints"))


def accepted(judged_rows: DataFrame) -> DataFrame:
    """The curated rows among :func:`judged` ones."""
    return curated_rows(judged_rows.where(F.col(REASON).isNull()))


def refused(judged_rows: DataFrame) -> DataFrame:
    """One row per refused payload or datapoint among :func:`judged` ones."""
    columns = ("source_file", "account_id", "region", "resource_id", "metric_name", REASON, POSITION)
    return judged_rows.where(F.col(REASON).isNotNull()).select(*columns)


def fail_on_reject(rows: DataFrame) -> DataFrame:
    """Stop the job at the first rejected row, naming its reason and its file."""
    message = F.concat(F.col(REASON), F.lit(": "), F.col("source_file"))
    return rows.where(
        F.when(F.col(REASON).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    )


def curated_rows(point_rows: DataFrame) -> DataFrame:
    """Datapoints in curated column order, plus partition columns and position."""
    derived = point_rows.withColumns(
        {
            "date": F.to_date("metric_timestamp"),
            "hour": F.date_format("metric_timestamp", "HH"),
        }
    )
    return derived.select(*CURATED.fieldNames(), POSITION)


def flatten(raw: DataFrame, on_error: str = "fail") -> DataFrame:
    """Payloads to curated rows.

    ``on_error="fail"`` raises at the first violation; ``"quarantine"`` keeps
    the valid rows only (see :func:`rejects` for the others).
    """
    return rows_of(headers(raw), on_error)


def rows_of(header_rows: DataFrame, on_error: str = "fail") -> DataFrame:
    """Curated rows of payload headers, refusing or leaving out the bad ones."""
    if on_error not in ("fail", "quarantine"):
        raise ValueError(f"on_error must be 'fail' or 'quarantine', got {on_error!r}")
    if on_error == "fail":
        return curated_rows(points(fail_on_reject(header_rows), strict=True))
    valid = header_rows.where(F.col(REASON).isNull())
    return curated_rows(points(valid).where(F.col(REASON).isNull()))


def check_quarantine(on_error: str, quarantine_root: str | None) -> None:
    """Refused rows must land somewhere: nothing is left out without a trace."""
    if on_error == "quarantine" and not quarantine_root:
        raise ValueError("on_error='quarantine' needs a quarantine_root")


def rejects(raw: DataFrame) -> DataFrame:
    """Everything :func:`flatten` refuses: one row per bad payload or bad datapoint."""
    return refused(judged(headers(raw)))
