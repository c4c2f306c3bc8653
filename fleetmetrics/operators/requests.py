"""Report requests as a table: parse the request lines, then resolve what they name."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import default_report_month
from ..functions.validators import PATTERNS
from ..sources.inventory import query_targets
from .names import KEY, PLACE, best_tiers, expand_hits, name_hits, normalize

# Request words and default windows.
COMMANDS = ("health", "storage", "topsql", "report")
DEFAULT_LIVE_MINUTES = 30
DEFAULT_STORAGE_DAYS = 30
DEFAULT_TOPSQL_MINUTES = 10
_LENGTH = r"\A(\d+)(m|h|d)\z"

# Modes that query whole accounts without a resource list, and modes that also
# need the clusters of the resolved instances.
LISTING_MODES = ("live", "topsql")
CLUSTER_MODES = ("storage", "report")


def parse_requests(requests: DataFrame, today: date | None = None) -> DataFrame:
    """(request_id, target, mode, value, status) of each request line.

    Lines read ``health|storage|topsql|report <target> [argument]``; further
    words are ignored. ``status`` is ``ok``, ``bad_usage`` or ``bad_argument``.
    """
    words = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", 4)
    command, argument = F.col("command"), F.col("argument")
    number, unit = F.col("number"), F.col("unit")
    default = (
        F.when(command == "report", default_report_month(today))
        .when(command == "storage", f"{DEFAULT_STORAGE_DAYS}d")
        .when(command == "topsql", f"{DEFAULT_TOPSQL_MINUTES}m")
        .otherwise(f"{DEFAULT_LIVE_MINUTES}m")
    )
    split = (
        requests.select("request_id", words.alias("words"))
        .select(
            "request_id",
            F.get("words", F.lit(0)).alias("command"),
            F.get("words", F.lit(1)).alias("target"),
            F.get("words", F.lit(2)).alias("argument"),
        )
        .withColumn("argument", F.coalesce(argument, default))
        .withColumns(
            {
                "number": F.regexp_extract(argument, _LENGTH, 1),
                "unit": F.regexp_extract(argument, _LENGTH, 2),
                "is_date": argument.rlike(rf"\A{PATTERNS['date']}\z"),
                "is_month": argument.rlike(rf"\A{PATTERNS['month']}\z"),
            }
        )
    )
    minutes = (number.try_cast("decimal(36,0)") * F.when(unit == "h", 60).otherwise(1)).cast("string")
    value = (
        F.when(command == "report", F.when(F.col("is_month"), argument))
        .when(command == "storage", F.when(unit == "d", number))
        .when(unit.isin("m", "h"), minutes)
        .when((command == "health") & F.col("is_date"), argument)
    )
    valued = split.withColumns(
        {
            "mode": F.when(command != "health", command).when(F.col("is_date"), "date").otherwise("live"),
            "value": value,
            "usable": F.coalesce(command.isin(*COMMANDS) & F.col("target").isNotNull(), F.lit(False)),
        }
    )
    status = (
        F.when(~F.col("usable"), "bad_usage").when(F.col("value").isNull(), "bad_argument").otherwise("ok")
    )
    good = F.col("status") == "ok"
    parsed = valued.withColumn("status", status).select(
        "request_id",
        F.struct(
            *[F.when(good, F.col(c)).alias(c) for c in ("target", "mode", "value")], "status"
        ).alias("parsed"),
    )
    # Inlining a one-row array keeps later filters from being pushed into, and
    # so repeating, the parsing expressions.
    return parsed.select("request_id", F.inline(F.array("parsed")))


def _by_target_name(parsed: DataFrame, targets: DataFrame, instances: DataFrame) -> DataFrame:
    """Parsed requests with ``name`` and the enabled target of exactly that name, if there is one.

    Of several targets with one name the smallest account and region counts. ``stocked`` is
    true where the target has an instance. Refused lines name nothing; they look under a key
    of their own, so that they spread over tasks.
    """
    stocked = instances.where(F.col("identifier") != "").select(*PLACE, F.lit(True).alias("stocked")).distinct()
    named = (
        query_targets(targets)
        .groupBy(F.col("target_name").alias("lookup"))
        .agg(F.min(F.struct(*PLACE)).alias("at"))
        .select("lookup", "at.*")
        .join(stocked, PLACE, "left")
        .select("lookup", F.col("account_id").alias("named_account"), F.col("region").alias("named_region"), "stocked")
    )
    keyed = parsed.withColumn("lookup", F.coalesce("target", F.concat(F.lit("\0"), "request_id")))
    return keyed.join(named, "lookup", "left").withColumn("name", normalize(F.col("lookup")))


def _scope_key() -> Column:
    """What a request's resource list depends on: the same text for requests that share one list."""
    account, mode, name = F.col("named_account"), F.col("mode"), F.col("name")
    return (
        F.when(
            account.isNotNull() & mode.isin(*LISTING_MODES),
            F.concat(F.lit("account:"), account, F.lit(":"), "named_region"),
        )
        .when(account.isNull() & mode.isin(*CLUSTER_MODES), F.concat(F.lit("clusters:"), name))
        .when(account.isNull(), F.concat(F.lit("name:"), name))
    )


def _hits(parsed: DataFrame, members: DataFrame, instances: DataFrame) -> DataFrame:
    """What every distinct requested name could mean, in any account and region."""
    names = parsed.where(F.col("status") == "ok").select(F.col("target").alias("name"))
    return name_hits(names, members, instances)


def _match_counts(best: DataFrame, targets: DataFrame) -> DataFrame:
    """Per name: how many enabled targets know it, and which one if only one does."""
    return (
        best.join(query_targets(targets), PLACE)
        .groupBy("name")
        .agg(
            F.count("*").alias("matches"),
            F.min("target_name").alias("target_name"),
            F.min("account_id").alias("account_id"),
            F.min("region").alias("region"),
            F.min("tier").alias("tier"),
            F.min("place").alias("place"),
        )
    )


def resolve_scope(parsed: DataFrame, targets: DataFrame, members: DataFrame, instances: DataFrame) -> DataFrame:
    """One row per request: the account and region it is about, and whether that is settled.

    The name of an enabled target stands for its account in the first of its regions.
    Any other name is resolved there for every enabled target; a match at more than one is
    ``ambiguous``. ``status``: ok, no_instances, ambiguous, not_found, or the
    parse status. ``all_resources`` marks scopes without a resource list; the others name
    theirs in ``scope`` (see ``scope_resources``).
    """
    located = _by_target_name(parsed, targets, instances)
    counts = _match_counts(best_tiers(_hits(parsed, members, instances)), targets)
    named = F.col("named_account").isNotNull()
    listing = F.col("mode").isin(*LISTING_MODES)
    status = (
        F.when(F.col("status") != "ok", F.col("status"))
        .when(named & listing & F.col("stocked").isNull(), "no_instances")
        .when(named, "ok")
        .when(F.col("matches").isNull(), "not_found")
        .when(F.col("matches") > 1, "ambiguous")
        .otherwise("ok")
    )
    settled = located.join(counts, "name", "left").withColumn("scope_status", status)
    ok = F.col("scope_status") == "ok"
    return settled.select(
        "request_id",
        "target",
        "mode",
        "value",
        F.when(ok, F.coalesce("named_account", "account_id")).alias("account_id"),
        F.when(ok, F.coalesce("named_region", "region")).alias("region"),
        F.when(ok, F.when(named, F.col("target")).otherwise(F.col("target_name"))).alias("target_name"),
        F.coalesce(ok & named & ~listing, F.lit(False)).alias("all_resources"),
        F.when(ok, _scope_key()).alias("scope"),
        F.col("scope_status").alias("status"),
    )


def name_resources(parsed: DataFrame, targets: DataFrame, members: DataFrame, instances: DataFrame) -> DataFrame:
    """(name, account_id, region, with_clusters, resource_id) of every unambiguous requested name.

    Each name has two lists: its instances, and (``with_clusters``) the same
    extended by the clusters of those instances.
    """
    hits = _hits(parsed, members, instances)
    single = _match_counts(best_tiers(hits), targets).where(F.col("matches") == 1)
    ids = expand_hits(hits, single.select(*KEY, "tier", "place"), members)
    clusters = instances.where(F.col("cluster_identifier") != "").select(
        *PLACE, F.col("identifier").alias("resource_id"), "cluster_identifier"
    )
    lists = F.array(
        F.struct(F.lit(False).alias("with_clusters"), F.col("resource_id").alias("id")),
        F.struct(F.lit(True).alias("with_clusters"), F.col("resource_id").alias("id")),
        F.struct(F.lit(True).alias("with_clusters"), F.col("cluster_identifier").alias("id")),
    )
    return (
        ids.join(clusters, [*PLACE, "resource_id"], "left")
        .select(*KEY, F.explode(lists).alias("entry"))
        .select(*KEY, "entry.with_clusters", F.col("entry.id").alias("resource_id"))
        .where(F.col("resource_id").isNotNull())
        .distinct()
    )


def scope_resources(parsed: DataFrame, targets: DataFrame, members: DataFrame, instances: DataFrame) -> DataFrame:
    """(scope, account_id, region, resource_id): the resource list of every distinct settled scope.

    Requests point at their list by ``scope``, so a list is resolved and stored once however
    many requests repeat it, and rows grow with the inventory, not with the requests. Lists
    of storage and month requests also hold the clusters of their instances.
    """
    good = parsed.where(F.col("status") == "ok")
    named = F.col("named_account").isNotNull()
    scoped = _by_target_name(good, targets, instances).select(
        "named_account",
        "named_region",
        "name",
        F.col("mode").isin(*CLUSTER_MODES).alias("with_clusters"),
        _scope_key().alias("scope"),
    ).where(F.col("scope").isNotNull())
    loose = scoped.where(~named).select("scope", "name", "with_clusters").distinct()
    listed = scoped.where(named).select(
        "scope", F.col("named_account").alias("account_id"), F.col("named_region").alias("region")
    ).distinct()
    whole = instances.where(F.col("identifier") != "").select(*PLACE, F.col("identifier").alias("resource_id"))
    columns = ["scope", *PLACE, "resource_id"]
    return (
        loose.join(name_resources(parsed, targets, members, instances), ["name", "with_clusters"])
        .select(columns)
        .unionByName(listed.join(whole, PLACE).select(columns).distinct())
    )
