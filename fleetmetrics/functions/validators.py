"""Argument checks for report parameters, and the same shapes as column predicates."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, functions as F

# Accepted shapes of request parameters.
PATTERNS = {
    "account_id": r"\d{12}",
    "region": r"[a-z]{2}-[a-z]+-\d",
    "date": r"\d{4}-\d{2}-\d{2}",
    "month": r"\d{4}-(0[1-9]|1[0-2])",
    "resource_id": r"[A-Za-z0-9_-]+",
    "dbi_resource_id": r"db-[A-Z0-9]+",
}

MIN_LOOKBACK_MINUTES = 1
MAX_LOOKBACK_MINUTES = 24 * 60


def check(value: str, kind: str) -> str:
    """Return ``value`` if the whole of it has the shape ``kind``, else raise."""
    if not isinstance(value, str) or not re.fullmatch(PATTERNS[kind], value, re.ASCII):
        raise ValueError(f"{kind} is invalid: {value!r}")
    return value


def check_account_id(value: str) -> str:
    return check(value, "account_id")


def check_region(value: str) -> str:
    return check(value, "region")


def check_month(value: str) -> str:
    return check(value, "month")


def check_resource_id(value: str) -> str:
    return check(value, "resource_id")


def check_dbi_resource_id(value: str) -> str:
    return check(value, "dbi_resource_id")


def check_date(value: str | date) -> date:
    """Return a real calendar date; accepts a ``date`` or ``YYYY-MM-DD`` text."""
    if isinstance(value, date):
        return value
    check(value, "date")
    try:
        return date.fromisoformat(value)
    except ValueError as error:
        raise ValueError(f"date is invalid: {value!r}") from error


def check_lookback_minutes(value: int) -> int:
    if not MIN_LOOKBACK_MINUTES <= value <= MAX_LOOKBACK_MINUTES:
        raise ValueError(
            f"lookback_minutes must be between {MIN_LOOKBACK_MINUTES} and "
            f"{MAX_LOOKBACK_MINUTES}, got {value}"
        )
    return value


def is_lookback(minutes: Column) -> Column:
    """Column predicate of :func:`check_lookback_minutes`; false for NULL."""
    return F.coalesce(minutes.between(MIN_LOOKBACK_MINUTES, MAX_LOOKBACK_MINUTES), F.lit(False))


def has_shape(column: Column, kind: str) -> Column:
    """Column predicate: the whole text has the shape ``kind``."""
    return column.rlike(rf"\A(?:{PATTERNS[kind]})\z")
