"""Analytics over database-fleet metrics, as Spark DataFrame functions."""

from .plans.collection import collection_plan, collection_summary, land_responses
from .plans.curate import curate
from .plans.reports import (
    health_on_date,
    live_health,
    monthly_report,
    storage_forecast,
    storage_forecasts,
    top_sql,
    top_sql_overview,
)
from .plans.requests import resolve_requests
from .plans.sql import create_report_functions
from .session import build_session
from .sources.curated import read_curated
from .sources.published import read_published
from .streaming.incremental import incremental_curate, read_batch_stats
from .streaming.live import live_health_stream, sliding_health

__all__ = [
    "build_session",
    "collection_plan",
    "collection_summary",
    "create_report_functions",
    "curate",
    "health_on_date",
    "incremental_curate",
    "land_responses",
    "live_health",
    "live_health_stream",
    "monthly_report",
    "read_batch_stats",
    "read_curated",
    "read_published",
    "resolve_requests",
    "sliding_health",
    "storage_forecast",
    "storage_forecasts",
    "top_sql",
    "top_sql_overview",
]
