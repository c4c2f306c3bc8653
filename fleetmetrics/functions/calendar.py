"""Calendar arithmetic on report months (text ``YYYY-MM``), on the driver and as columns."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F

from .validators import check_month

# "Last month" is a question of the operators' calendar, not of UTC.
REPORT_UTC_OFFSET_HOURS = 9


def _first_day(month: str) -> date:
    check_month(month)
    return date.fromisoformat(f"{month}-01")


def previous_month(month: str) -> str:
    return f"{_first_day(month) - timedelta(days=1):%Y-%m}"


def month_bounds(month: str) -> tuple[date, date]:
    first = _first_day(month)
    return first, first.replace(day=month_day_count(month))


def month_day_count(month: str) -> int:
    first = _first_day(month)
    return monthrange(first.year, first.month)[1]


def report_today(offset_hours: int = REPORT_UTC_OFFSET_HOURS) -> date:
    shifted = datetime.now(timezone.utc) + timedelta(hours=offset_hours)
    return shifted.date()


def default_report_month(today: date | None = None) -> str:
    """The last finished month as seen on ``today``."""
    day = report_today() if today is None else today
    return previous_month(f"{day:%Y-%m}")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def previous_month_of(month: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), -1), "yyyy-MM")
