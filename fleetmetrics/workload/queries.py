"""Registered queries: one per operator or report, each over whole given tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalog import BASELINE_STATS, MONTHLY_STATS
from ..functions.calendar import month_bounds, previous_month
from ..functions.text import forecast_line, health_line, monthly_line, table_text, top_sql_line
from ..functions.validators import PATTERNS, has_shape, is_lookback
from ..operators.collection import unsupported_metrics, with_request_errors
from ..operators.dedup import deduplicate
from ..operators.flatten import REASON, flatten, headers, judged, points
from ..operators.inventory import attach_roles, available, extend_with_clusters, load_enabled_split
from ..operators.monthly import compare_months, monthly_aggregate, with_notable
from ..operators.names import resolve_names
from ..operators.health import baseline, health_snapshot
from ..operators.requests import parse_requests, resolve_scope, scope_resources
from ..operators.rollup import daily_states, monthly_of_states, read_states, wide_stats_of_states, write_states
from ..operators.storage import storage_history
from ..operators.topsql import normalize_finding_documents, normalize_findings, total_load, truncate_statements, with_display_text
from ..plans import reports
from ..plans.collection import collection_plan as plan_collection
from ..plans.collection import collection_summary as summarize_collection
from ..plans.collection import planned_resources, resource_metric_counts
from ..plans.curate import curate, refresh_statistics
from ..plans.sql import create_report_functions
from ..sources.curated import empty_curated, read_curated, read_history, register_curated, scope, write_curated
from ..sources.inventory import (
    clusters_from_pages,
    instances_from_pages,
    members_from_pages,
    read_cluster_pages,
    read_instance_pages,
)
from ..sources.published import read_published
from ..sources.raw import list_objects, path_value, read_raw, write_raw
from ..sources.responses import as_raw, payloads
from ..streaming.incremental import incremental_curate, read_batch_stats
from ..streaming.live import live_health_stream, read_live_health, sliding_health
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]

_WEEK_BEFORE = t.SNAPSHOT_DAY - timedelta(days=7)
_STORAGE_START = t.STORAGE_AS_OF - timedelta(days=30)
_MONTH_RANGE = (month_bounds(previous_month(t.REPORT_MONTH))[0], month_bounds(t.REPORT_MONTH)[1])
TODAY = date(2024, 2, 1)


def dedup_latest(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicate(t.repeated_samples(spark, sf)).select(
        "resource_id", "metric_name", "metric_timestamp", "value", "collected_at", "source_file"
    )


def required_guard(spark: SparkSession, sf: str) -> DataFrame:
    return points(headers(t.flawed_payloads(spark, sf))).select(
        "source_file", "account_id", "resource_id", "value", REASON
    )


def flatten_valid(spark: SparkSession, sf: str) -> DataFrame:
    return flatten(t.flawed_payloads(spark, sf), on_error="quarantine").select(
        "source_file", "account_id", "region", "date", "hour", "resource_id", "metric_name", "metric_timestamp", "value"
    )


def curate_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = payloads(t.response_requests(spark, sf), t.response_pages(spark, sf))
    return refresh_statistics(as_raw(rows))


def response_datapoints(spark: SparkSession, sf: str) -> DataFrame:
    rows = payloads(t.response_requests(spark, sf), t.response_pages(spark, sf))
    return rows.select(
        "resource_id",
        "start_time",
        "metric_name",
        "statistic",
        "unit",
        "datapoint_count",
        F.posexplode_outer("datapoints").alias("pos", "point"),
    ).select(
        "resource_id",
        "start_time",
        "metric_name",
        "statistic",
        "unit",
        "datapoint_count",
        "pos",
        F.col("point.timestamp").alias("point_timestamp"),
        F.col("point.value").alias("point_value"),
    )


def _scratch(spark: SparkSession) -> str:
    """A new directory under the cluster's shared checkpoint folder (in local mode, any folder)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="fleetmetrics-")
    return f"{shared.rstrip('/')}/fleetmetrics-{uuid.uuid4().hex}"


def _curated_view(spark: SparkSession, root: str) -> DataFrame:
    return read_curated(spark, root).select(
        "account_id", "region", "date", "hour", "resource_id", "metric_name", "metric_timestamp", "value", "engine"
    )


def curate_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    base = _scratch(spark)
    write_raw(payloads(t.response_requests(spark, sf), t.response_pages(spark, sf)), f"{base}/raw", compressed=True)
    curate(spark, f"{base}/raw", f"{base}/curated", multi_line=False)
    return _curated_view(spark, f"{base}/curated")


def incremental_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    base = _scratch(spark)
    rows = payloads(t.response_requests(spark, sf), t.response_pages(spark, sf))
    write_raw(rows, f"{base}/raw", compressed=True)
    incremental_curate(
        spark, f"{base}/raw", f"{base}/curated", f"{base}/progress", multi_line=False
    ).awaitTermination()
    return _curated_view(spark, f"{base}/curated")


def published_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Two landings merged into a published table; the second brings more samples of hours it has."""
    base = _scratch(spark)
    table = f"published_{uuid.uuid4().hex}"
    rows = payloads(t.response_requests(spark, sf), t.response_pages(spark, sf))
    for landing in (~t.sent_late(), t.sent_late()):
        write_raw(rows.where(landing), f"{base}/raw", compressed=True)
        incremental_curate(
            spark, f"{base}/raw", f"{base}/curated", f"{base}/progress", multi_line=False, table=table
        ).awaitTermination()
    return read_published(spark, table).select(_curated_view(spark, f"{base}/curated").columns)


def observed_batches(spark: SparkSession, sf: str) -> DataFrame:
    """What each batch of a stream over two landings read, refused and kept."""
    base = _scratch(spark)
    flawed = t.flawed_documents(spark, sf)
    for landing in ("source_account_id IS NOT NULL", "source_account_id IS NULL"):
        write_raw(flawed.where(landing), f"{base}/raw", compressed=True)
        incremental_curate(
            spark, f"{base}/raw", f"{base}/curated", f"{base}/progress", "quarantine", multi_line=False,
            quarantine_root=f"{base}/refused", stats_root=f"{base}/stats",
        ).awaitTermination()
    return read_batch_stats(spark, f"{base}/stats").drop("raw_file_count", "raw_bytes")


def variant_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose datapoints are a list, missing, null or something else, and broken ones."""
    root = f"{_scratch(spark)}/raw"
    t.loose_documents(spark, sf).write.text(f"{root}/account_id={t.ACCOUNT}")
    rows = judged(headers(read_raw(spark, root, multi_line=False, variant=True)))
    return rows.groupBy(REASON).agg(F.count("*").alias("rows"), F.sum("value").cast("decimal(28,2)").alias("total"))


def findings_variant(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_finding_documents(t.finding_documents(spark, sf)).drop("position")


def live_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Live health kept up by a stream over two landings, the second of them late."""
    base = _scratch(spark)
    rows = payloads(t.response_requests(spark, sf), t.response_pages(spark, sf))
    for landing in (~t.sent_late(), t.sent_late()):
        write_raw(rows.where(landing), f"{base}/raw", compressed=True)
        live_health_stream(
            spark, f"{base}/raw", f"{base}/health", f"{base}/progress", multi_line=False
        ).awaitTermination()
    return read_live_health(spark, f"{base}/health")


def _states(spark: SparkSession, samples: DataFrame) -> DataFrame:
    root = f"{_scratch(spark)}/states"
    write_states(daily_states(samples), root)
    return read_states(spark, root)


def baseline_from_states(spark: SparkSession, sf: str) -> DataFrame:
    states = _states(spark, t.events_as_curated(spark, sf))
    week = scope(states, t.ACCOUNT, t.REGION, _WEEK_BEFORE, t.SNAPSHOT_DAY)
    return wide_stats_of_states(week, ("resource_id",), BASELINE_STATS)


def monthly_from_states(spark: SparkSession, sf: str) -> DataFrame:
    states = scope(_states(spark, t.orders_as_curated(spark, sf)), t.ACCOUNT, t.REGION, *_MONTH_RANGE)
    return with_notable(compare_months(monthly_of_states(states, MONTHLY_STATS), t.REPORT_MONTH, TODAY))


def _week(spark: SparkSession, sf: str) -> DataFrame:
    return t.events_as_curated(spark, sf, _WEEK_BEFORE, t.SNAPSHOT_DAY)


def snapshot(spark: SparkSession, sf: str) -> DataFrame:
    day = t.events_as_curated(spark, sf, t.SNAPSHOT_DAY, t.SNAPSHOT_DAY)
    return health_snapshot(scope(day, t.ACCOUNT, t.REGION, t.SNAPSHOT_DAY))


def week_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return baseline(scope(_week(spark, sf), t.ACCOUNT, t.REGION, _WEEK_BEFORE, t.SNAPSHOT_DAY))


def health_vs_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return reports.health_on_date(
        t.events_as_curated(spark, sf, t.SNAPSHOT_DAY, t.SNAPSHOT_DAY),
        t.ACCOUNT,
        t.REGION,
        t.SNAPSHOT_DAY,
        history=_week(spark, sf),
    )


def health_text(spark: SparkSession, sf: str) -> DataFrame:
    day = t.events_as_curated(spark, sf, t.SNAPSHOT_DAY, t.SNAPSHOT_DAY)
    rows = health_snapshot(scope(day, t.ACCOUNT, t.REGION, t.SNAPSHOT_DAY))
    return health_line(rows).select("resource_id", "line")


def live_window(spark: SparkSession, sf: str) -> DataFrame:
    requested = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"), F.concat(F.lit("u"), "c_custkey").alias("resource_id")
    )
    return reports.live_health(
        t.events_as_curated(spark, sf, t.AS_OF.date() - timedelta(days=1), t.AS_OF.date()),
        t.ACCOUNT,
        t.REGION,
        requested,
        t.AS_OF,
        t.LOOKBACK_MINUTES,
        history=_week(spark, sf),
    )


def sliding_live_health(spark: SparkSession, sf: str) -> DataFrame:
    return sliding_health(t.events_as_curated(spark, sf))


def history_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return storage_history(scope(t.storage_as_curated(spark, sf), t.ACCOUNT, t.REGION))


def storage_forecast(spark: SparkSession, sf: str) -> DataFrame:
    series = t.storage_as_curated(spark, sf, _STORAGE_START, t.STORAGE_AS_OF)
    return reports.storage_forecast(series, t.ACCOUNT, t.REGION, t.STORAGE_AS_OF)


def storage_forecast_full(spark: SparkSession, sf: str) -> DataFrame:
    return reports.storage_forecast(t.storage_as_curated(spark, sf), t.ACCOUNT, t.REGION, days=None)


def storage_forecast_daily(spark: SparkSession, sf: str) -> DataFrame:
    first = t.STORAGE_AS_OF - timedelta(days=29)
    return reports.storage_forecasts(t.storage_as_curated(spark, sf), t.ACCOUNT, t.REGION, first, t.STORAGE_AS_OF)


def storage_text(spark: SparkSession, sf: str) -> DataFrame:
    return forecast_line(storage_forecast(spark, sf)).select("resource_id", "line")


def month_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.orders_as_curated(spark, sf, *_MONTH_RANGE)
    return monthly_aggregate(scope(rows, t.ACCOUNT, t.REGION, *_MONTH_RANGE))


def monthly_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.orders_as_curated(spark, sf, *_MONTH_RANGE)
    return reports.monthly_report(rows, t.ACCOUNT, t.REGION, t.REPORT_MONTH, today=TODAY)


def monthly_text(spark: SparkSession, sf: str) -> DataFrame:
    return monthly_line(monthly_report(spark, sf)).select("resource_id", "line")


def _window_load(spark: SparkSession, sf: str) -> DataFrame:
    return t.sql_load(spark, sf, t.AS_OF.date() - timedelta(days=1), t.AS_OF.date())


def top_sql(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_sql(_window_load(spark, sf), t.AS_OF, t.LOOKBACK_MINUTES)


def top_sql_all_time(spark: SparkSession, sf: str) -> DataFrame:
    """Ten heaviest statements per instance over every sample there is."""
    from ..operators.topsql import average_load, top_statements

    return top_statements(average_load(t.sql_load(spark, sf)), 10)


def top_sql_total_load(spark: SparkSession, sf: str) -> DataFrame:
    return total_load(top_sql(spark, sf))


def top_sql_text(spark: SparkSession, sf: str) -> DataFrame:
    return top_sql_line(top_sql(spark, sf)).select("resource_id", "rank", "line")


def _sql_report(spark: SparkSession, sf: str, curated: DataFrame, call: str, **args: object) -> DataFrame:
    """A report through its SQL table function, over views of whole tables."""
    # Views of one report hold its columns only; the functions name those of all.
    whole = empty_curated(spark).unionByName(curated, allowMissingColumns=True)
    whole.createOrReplaceTempView("fleet_curated")
    t.sql_load(spark, sf).createOrReplaceTempView("fleet_load")
    create_report_functions(spark, "fleet_curated", "fleet_load")
    return spark.sql(f"SELECT * FROM {call}", args={"account": t.ACCOUNT, "region": t.REGION, **args})


def sql_health(spark: SparkSession, sf: str) -> DataFrame:
    samples = t.events_as_curated(spark, sf)
    return _sql_report(spark, sf, samples, "fleet_health(:account, :region, :day, 7)", day=t.SNAPSHOT_DAY)


def sql_live(spark: SparkSession, sf: str) -> DataFrame:
    call = "fleet_live(:account, :region, :as_of, :minutes, 7)"
    return _sql_report(spark, sf, t.events_as_curated(spark, sf), call, as_of=t.AS_OF, minutes=t.LOOKBACK_MINUTES)


def sql_storage(spark: SparkSession, sf: str) -> DataFrame:
    call = "fleet_storage(:account, :region, :day, 30)"
    return _sql_report(spark, sf, t.storage_as_curated(spark, sf), call, day=t.STORAGE_AS_OF)


def sql_months(spark: SparkSession, sf: str) -> DataFrame:
    call = "fleet_months(:account, :region, :month, :today)"
    return _sql_report(spark, sf, t.orders_as_curated(spark, sf), call, month=t.REPORT_MONTH, today=TODAY)


def sql_top_sql(spark: SparkSession, sf: str) -> DataFrame:
    call = "fleet_top_sql(:as_of, :minutes, 10)"
    return _sql_report(spark, sf, t.events_as_curated(spark, sf), call, as_of=t.AS_OF, minutes=t.LOOKBACK_MINUTES)


def top_sql_overview(spark: SparkSession, sf: str) -> DataFrame:
    users = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("position"), F.concat(F.lit("u"), "c_custkey").alias("resource_id")
    )
    known = t.instances(spark, sf).withColumns(
        {
            "account_id": F.lit(t.ACCOUNT),
            "region": F.lit(t.REGION),
            "identifier": F.concat(F.lit("u"), "ordinal"),
        }
    )
    days = (t.AS_OF.date() - timedelta(days=1), t.AS_OF.date())
    return reports.top_sql_overview(
        _window_load(spark, sf),
        t.events_as_curated(spark, sf, *days),
        known,
        t.ACCOUNT,
        t.REGION,
        users,
        t.AS_OF,
        t.LOOKBACK_MINUTES,
    ).select(
        "position",
        "resource_id",
        "has_load",
        "load_status",
        "total_active_sessions",
        "ranked_statements",
        "load_note",
        "cpu_avg",
        "connections_max",
    )


def sql_truncate(spark: SparkSession, sf: str) -> DataFrame:
    texts = t.table(spark, sf, "documents").select("doc_id", F.col("text").alias("sql_text"))
    return with_display_text(truncate_statements(texts))


def findings_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_findings(t.findings(spark, sf)).drop("position")


def findings_join(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_sql(
        _window_load(spark, sf), t.AS_OF, t.LOOKBACK_MINUTES, findings=t.findings(spark, sf)
    )


def load_split(spark: SparkSession, sf: str) -> DataFrame:
    return load_enabled_split(t.instance_ids(spark, sf), t.instances(spark, sf))


def role_join(spark: SparkSession, sf: str) -> DataFrame:
    return attach_roles(t.instances(spark, sf), t.cluster_members(spark, sf))


def available_instances(spark: SparkSession, sf: str) -> DataFrame:
    return available(role_join(spark, sf)).select("identifier", "status", "cluster_role")


def cluster_extend(spark: SparkSession, sf: str) -> DataFrame:
    return extend_with_clusters(t.instance_ids(spark, sf), role_join(spark, sf), keys=())


def cluster_extend_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Every instance and cluster of the fleet, each in its account and region."""
    known = role_join(spark, sf)
    return extend_with_clusters(known.withColumnRenamed("identifier", "resource_id"), known)


def described_members(spark: SparkSession, sf: str) -> DataFrame:
    return members_from_pages(_cluster_pages(spark, sf)).drop("cluster_ordinal", "member_pos")


def _cluster_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster pages written as JSON documents and read back."""
    root = f"{_scratch(spark)}/clusters"
    t.cluster_pages(spark, sf).write.json(root)
    return read_cluster_pages(spark, root, multi_line=False)


def described_instances(spark: SparkSession, sf: str) -> DataFrame:
    root = f"{_scratch(spark)}/instances"
    t.instance_pages(spark, sf).write.json(root)
    pages = read_instance_pages(spark, root, multi_line=False)
    return instances_from_pages(pages, members_from_pages(_cluster_pages(spark, sf))).drop("ordinal")


def described_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clusters_from_pages(_cluster_pages(spark, sf)).drop("ordinal")


def names(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_names(t.loose_names(spark, sf), t.cluster_members(spark, sf), t.instances(spark, sf))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return parse_requests(t.request_lines(spark, sf), TODAY)


def _scope_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (
        requests(spark, sf),
        t.targets(spark, sf),
        t.cluster_members(spark, sf),
        t.instances(spark, sf),
    )


def scopes(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_scope(*_scope_inputs(spark, sf))


def scope_ids(spark: SparkSession, sf: str) -> DataFrame:
    return scope_resources(*_scope_inputs(spark, sf))


def collection_plan(spark: SparkSession, sf: str) -> DataFrame:
    return plan_collection(t.targets(spark, sf), t.clusters(spark, sf), role_join(spark, sf))


def resource_counts(spark: SparkSession, sf: str) -> DataFrame:
    planned = planned_resources(t.targets(spark, sf), t.clusters(spark, sf), role_join(spark, sf))
    return resource_metric_counts(planned).drop("metrics")


def collection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summarize_collection(
        t.targets(spark, sf), t.clusters(spark, sf), role_join(spark, sf), collection_plan(spark, sf)
    )


def landed_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary with uploads counted in the raw layer, where every planned payload was landed."""
    root = f"{_scratch(spark)}/raw"
    plan = collection_plan(spark, sf)
    write_raw(t.planned_payloads(plan), root, compressed=True)
    landed = read_raw(spark, root, multi_line=False)
    return summarize_collection(t.targets(spark, sf), t.clusters(spark, sf), role_join(spark, sf), plan, landed)


def raw_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The folders of a raw layer that also holds objects of an older layout, by their names alone."""
    root = f"{_scratch(spark)}/raw"
    write_raw(payloads(t.response_requests(spark, sf), t.response_pages(spark, sf)), root, compressed=True)
    t.table(spark, sf, "nation").select(F.to_json(F.struct("n_name"))).write.text(f"{root}/older")
    name = F.col("name")
    return list_objects(spark, root).where("length > 0").select(
        name.startswith("account_id=").alias("partitioned"),
        *[path_value(name, key).alias(key) for key in ("account_id", "region", "metric", "date")],
    ).distinct()


def payload_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the raw layer by the region they name themselves."""
    root = f"{_scratch(spark)}/raw"
    write_raw(payloads(t.response_requests(spark, sf), t.response_pages(spark, sf)), root, compressed=True)
    documents = read_raw(spark, root, multi_line=False)
    return documents.groupBy("region", "metric_name").agg(
        F.count("*").alias("documents"), F.sum("datapoint_count").alias("datapoints")
    )


def registered_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of each registered hour, through the catalogue."""
    root, table = f"{_scratch(spark)}/curated", f"registered_{uuid.uuid4().hex}"
    write_curated(t.events_as_curated(spark, sf), root)
    register_curated(spark, table, root)
    return spark.table(table).groupBy("account_id", "region", "date", "hour").agg(F.count("*").alias("samples"))


def health_without_history(spark: SparkSession, sf: str) -> DataFrame:
    """Day health while there is no curated table to take a baseline from."""
    day = t.events_as_curated(spark, sf, t.SNAPSHOT_DAY, t.SNAPSHOT_DAY)
    nothing = read_history(spark, f"{_scratch(spark)}/never-written")
    return reports.health_on_date(day, t.ACCOUNT, t.REGION, t.SNAPSHOT_DAY, history=nothing)


def validated_values(spark: SparkSession, sf: str) -> DataFrame:
    """Which shapes the texts of orders have, and which part numbers are lookbacks."""
    texts = t.parameter_texts(spark, sf)
    flags = {kind: has_shape(F.col("value"), kind) for kind in PATTERNS}
    return texts.withColumns({**flags, "lookback": is_lookback(F.col("value").try_cast("long"))})


def shown_instances(spark: SparkSession, sf: str) -> DataFrame:
    return table_text(role_join(spark, sf))


def request_check(spark: SparkSession, sf: str) -> DataFrame:
    asked = t.events(spark, sf).select(
        "event_id",
        t.event_dimension().alias("resource_dimension"),
        F.when(F.col("event_type") == "error", "ErrorCount").otherwise(t.event_metric()).alias("metric_name"),
    )
    return with_request_errors(asked)


def metric_allow_list(spark: SparkSession, sf: str) -> DataFrame:
    asked = t.events(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") == "error", "ErrorCount").otherwise(t.event_metric()).alias("metric_name"),
    )
    return unsupported_metrics(asked).select("event_id", "metric_name")


QUERIES: dict[str, Query] = {
    "dedup_latest": dedup_latest,
    "required_guard": required_guard,
    "flatten_valid": flatten_valid,
    "curate_stats": curate_stats,
    "response_datapoints": response_datapoints,
    "curate_roundtrip": curate_roundtrip,
    "incremental_roundtrip": incremental_roundtrip,
    "published_roundtrip": published_roundtrip,
    "live_stream": live_stream,
    "variant_guard": variant_guard,
    "findings_variant": findings_variant,
    "observed_batches": observed_batches,
    "baseline_from_states": baseline_from_states,
    "monthly_from_states": monthly_from_states,
    "health_snapshot": snapshot,
    "baseline": week_baseline,
    "health_vs_baseline": health_vs_baseline,
    "health_text": health_text,
    "live_window": live_window,
    "sliding_live_health": sliding_live_health,
    "storage_history": history_per_day,
    "storage_forecast": storage_forecast,
    "storage_forecast_full": storage_forecast_full,
    "storage_forecast_daily": storage_forecast_daily,
    "storage_text": storage_text,
    "monthly_aggregate": month_rows,
    "monthly_report": monthly_report,
    "monthly_text": monthly_text,
    "top_sql": top_sql,
    "top_sql_all_time": top_sql_all_time,
    "top_sql_total_load": top_sql_total_load,
    "top_sql_text": top_sql_text,
    "top_sql_overview": top_sql_overview,
    "sql_health": sql_health,
    "sql_live": sql_live,
    "sql_storage": sql_storage,
    "sql_months": sql_months,
    "sql_top_sql": sql_top_sql,
    "sql_truncate": sql_truncate,
    "findings_normalized": findings_normalized,
    "findings_join": findings_join,
    "load_enabled_split": load_split,
    "role_join": role_join,
    "available_instances": available_instances,
    "cluster_extend": cluster_extend,
    "resolve_names": names,
    "parse_requests": requests,
    "resolve_scope": scopes,
    "scope_resources": scope_ids,
    "collection_plan": collection_plan,
    "resource_metric_counts": resource_counts,
    "collection_summary": collection_summary,
    "metric_allow_list": metric_allow_list,
    "request_check": request_check,
    "landed_summary": landed_summary,
    "raw_objects": raw_objects,
    "payload_regions": payload_regions,
    "registered_hours": registered_hours,
    "health_without_history": health_without_history,
    "validated_values": validated_values,
    "shown_instances": shown_instances,
    "cluster_extend_keyed": cluster_extend_keyed,
    "described_clusters": described_clusters,
    "described_members": described_members,
    "described_instances": described_instances,
}
