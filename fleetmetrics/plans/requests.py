"""Request lines to settled scopes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from ..operators.requests import parse_requests, resolve_scope, scope_resources


def resolve_requests(
    requests: DataFrame,
    targets: DataFrame,
    members: DataFrame,
    instances: DataFrame,
    today: date | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scopes, resources): one row per request, and the resource ids of each ``scope`` they name."""
    parsed = parse_requests(requests, today)
    return (
        resolve_scope(parsed, targets, members, instances),
        scope_resources(parsed, targets, members, instances),
    )
