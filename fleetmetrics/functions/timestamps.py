"""UTC timestamp parsing and formatting that do not depend on the session zone."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F

_OFFSET = r":\d{2}.*[+-]\d{2}(:?\d{2})?$"


def utc_literal(moment: datetime) -> Column:
    """A naive UTC (or any aware) ``datetime`` as a TIMESTAMP_NTZ literal."""
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_to_instant(ts: Column) -> Column:
    """A naive UTC timestamp as the TIMESTAMP instant it stands for."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ts))


def instant_to_utc(ts: Column) -> Column:
    """A TIMESTAMP instant as the naive UTC timestamp (TIMESTAMP_NTZ)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), epoch)


def parse_utc(text: Column) -> Column:
    """ISO-8601 text (extended form) to naive UTC; no offset means UTC; NULL when unreadable."""
    missing = (
        F.when(F.endswith(text, F.lit("Z")), "")
        .when(F.char_length(text) == 10, "T00:00:00Z")
        .when(text.rlike(_OFFSET), "")
        .otherwise("Z")
    )
    dated = (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    return F.when(dated, instant_to_utc(F.concat(text, missing).try_cast("timestamp")))


def iso_utc(ts: Column) -> Column:
    """Naive UTC timestamp to ISO text with ``Z``; microseconds only when present."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole,
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("Z"),
    )
