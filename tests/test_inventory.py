from __future__ import annotations

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from fleetmetrics import collection_plan, collection_summary, resolve_requests
from fleetmetrics.catalog import BASE_INSTANCE_METRICS, METRICS
from fleetmetrics.operators.collection import instance_metrics, unsupported_metrics
from fleetmetrics.operators.inventory import available, extend_with_clusters
from fleetmetrics.operators.names import resolve_names
from fleetmetrics.operators.requests import parse_requests
from fleetmetrics.plans.collection import planned_resources
from fleetmetrics.schemas import INSTANCES, REQUESTS
from fleetmetrics.sources.inventory import (
    clusters_from_pages,
    instances_from_pages,
    members_from_pages,
    read_cluster_pages,
    read_instance_pages,
    target_regions,
    targets_table,
)

from .helpers import ACCOUNT, REGION, inventory, rows_of

FLEET = {"orders": ["orders-a", "orders-c"], "billing-prod": ["bill-1"], "empty-prod": [], "ghost": [None]}
ALONE = ["devops-db", "Reports"]


def resolve(spark, names, fleet=None, alone=None):
    _, members, instances = inventory(spark, FLEET if fleet is None else fleet, ALONE if alone is None else alone)
    df = resolve_names(spark.createDataFrame([(n,) for n in names], "name string"), members, instances)
    found: dict[str, list] = {}
    for r in df.orderBy("name", "position", "resource_id").collect():
        found.setdefault(r.name, []).append(r.resource_id)
    return found


def test_names_by_tier(spark):
    found = resolve(spark, [" ORDERS-A ", "Orders", "prod", "devops", "reports", "r", "nothing", "  ", "empty-prod", "ghost"])
    assert found == {
        "orders-a": ["orders-a"],
        "orders": ["orders-a", "orders-c"],
        "prod": ["bill-1"],
        "devops": ["devops-db"],
        "reports": ["Reports"],
        "r": ["bill-1", "orders-a", "orders-c"],
    }


def _brute(name, fleet, alone):
    name = name.strip().lower()
    instances = [m for ms in fleet.values() for m in ms] + list(alone)
    if not name:
        return []
    for i in instances:
        if i.lower() == name:
            return [i]
    for c, ms in fleet.items():
        if c.lower() == name and ms:
            return ms
    part = sorted({m for c, ms in fleet.items() if name in c.lower() for m in ms})
    return part or sorted({i for i in instances if name in i.lower()})


def test_names_equal_brute_force(spark):
    rng = random.Random(3)

    def word(low, high):
        return "".join(rng.choice("abcA-") for _ in range(rng.randint(low, high)))

    fleet = {word(3, 7) + str(i): [word(2, 6) + f"{i}{k}" for k in range(rng.randint(0, 3))] for i in range(12)}
    alone = [word(2, 8) + f"s{i}" for i in range(12)]
    names = sorted({word(1, 6) for _ in range(120)} | set(list(fleet)[:5]) | set(alone[:5]))
    found = resolve(spark, names, fleet, alone)
    for name in names:
        expected = _brute(name, fleet, alone)
        assert found.get(name.strip().lower(), []) == expected, name


def test_name_search_has_no_nested_loop(spark):
    _, members, instances = inventory(spark, FLEET, ALONE)
    df = resolve_names(spark.createDataFrame([("a",)], "name string"), members, instances)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cluster_extension(spark):
    _, _, instances = inventory(spark, FLEET, ALONE)
    ids = spark.createDataFrame([("orders-a",), ("orders-a",), ("devops-db",), ("unknown",)], "resource_id string")
    assert rows_of(extend_with_clusters(ids, instances, keys=()), "resource_id") == [
        ("devops-db",), ("orders",), ("orders-a",), ("unknown",),
    ]


# ---- requests -------------------------------------------------------------

TODAY = date(2026, 9, 1)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("health db", ("db", "live", "30", "ok")),
        ("health db 2h", ("db", "live", "120", "ok")),
        ("health db 045m", ("db", "live", "45", "ok")),
        ("health db 2026-08-19", ("db", "date", "2026-08-19", "ok")),
        ("  storage   db  ", ("db", "storage", "30", "ok")),
        ("storage db 090d", ("db", "storage", "090", "ok")),
        ("topsql db", ("db", "topsql", "10", "ok")),
        ("topsql db 1h more words", ("db", "topsql", "60", "ok")),
        ("report db", ("db", "report", "2026-08", "ok")),
        ("report db 2026-07", ("db", "report", "2026-07", "ok")),
        ("report db 2026-13", (None, None, None, "bad_argument")),
        ("storage db 30m", (None, None, None, "bad_argument")),
        ("topsql db 2026-08-19", (None, None, None, "bad_argument")),
        ("health db soon", (None, None, None, "bad_argument")),
        ("health", (None, None, None, "bad_usage")),
        ("Health db", (None, None, None, "bad_usage")),
        ("", (None, None, None, "bad_usage")),
        (None, (None, None, None, "bad_usage")),
    ],
)
def test_parse(spark, text, expected):
    df = parse_requests(spark.createDataFrame([("1", text)], REQUESTS), TODAY)
    assert rows_of(df, "target", "mode", "value", "status") == [expected]


def test_scopes_over_several_accounts(spark):
    second, off = "222222222222", "333333333333"
    parts = [
        inventory(spark, FLEET, ALONE),
        inventory(spark, {"orders-eu": ["eu-1"], "search": ["s-1", "s-2"]}, account=second),
        inventory(spark, {"hidden": ["hidden-1"]}, account=off),
    ]
    members = parts[0][1].unionByName(parts[1][1]).unionByName(parts[2][1])
    instances = parts[0][2].unionByName(parts[1][2]).unionByName(parts[2][2])
    entry = {"role_name": "observer", "regions": [REGION]}
    targets = targets_table(
        spark,
        [
            {"name": "main", "account_id": ACCOUNT, **entry},
            {"name": "europe", "account_id": second, **entry},
            {"name": "bare", "account_id": "444444444444", **entry},
            {"name": "off", "account_id": off, "enabled": False, **entry},
        ],
    )
    lines = {
        "1": "health main", "2": "storage main", "3": "health bare", "4": "health orders", "5": "health search",
        "6": "storage search", "7": "health hidden", "8": "health off", "9": "report Search 2026-07", "10": "nonsense",
        "11": "topsql europe",
    }
    scopes, resources = resolve_requests(
        spark.createDataFrame(list(lines.items()), REQUESTS), targets, members, instances, TODAY
    )
    status = {r.request_id: (r.status, r.target_name, r.all_resources) for r in scopes.collect()}
    assert status == {
        "1": ("ok", "main", False), "2": ("ok", "main", True), "3": ("no_instances", None, False),
        "4": ("ambiguous", None, False), "5": ("ok", "europe", False), "6": ("ok", "europe", False),
        "7": ("not_found", None, False), "8": ("not_found", None, False), "9": ("ok", "europe", False),
        "10": ("bad_usage", None, False), "11": ("ok", "europe", False),
    }
    ids: dict[str, list] = {}
    listed = scopes.select("request_id", "scope").join(resources, "scope")
    assert resources.count() == resources.distinct().count() < listed.count()
    for r in listed.orderBy("request_id", "resource_id").collect():
        ids.setdefault(r.request_id, []).append(r.resource_id)
    assert ids == {
        "1": ["Reports", "bill-1", "devops-db", "orders-a", "orders-c"],
        "5": ["s-1", "s-2"], "6": ["s-1", "s-2", "search"], "9": ["s-1", "s-2", "search"],
        "11": ["eu-1", "s-1", "s-2"],
    }


def test_only_the_first_region_of_a_target_is_asked(spark):
    _, members, instances = inventory(spark, FLEET, ALONE)
    _, far_members, far = inventory(spark, {"far": ["far-1"]}, ["devops-db"])
    other = F.lit("us-east-1")
    members = members.unionByName(far_members.withColumn("region", other))
    instances = instances.unionByName(far.withColumn("region", other))
    targets = targets_table(
        spark, [{"name": "main", "account_id": ACCOUNT, "role_name": "r", "regions": [REGION, "us-east-1"]}]
    )
    lines = [("1", "topsql main"), ("2", "health far"), ("3", "health devops-db")]
    scopes, resources = resolve_requests(spark.createDataFrame(lines, REQUESTS), targets, members, instances, TODAY)
    assert rows_of(scopes, "request_id", "status", "region") == [
        ("1", "ok", REGION), ("2", "not_found", None), ("3", "ok", REGION),
    ]
    listed = scopes.select("request_id", "scope").join(resources, "scope")
    assert rows_of(listed.where("request_id = '1'"), "resource_id", "region") == [
        (i, REGION) for i in ("Reports", "bill-1", "devops-db", "orders-a", "orders-c")
    ]
    found = resolve_names(spark.createDataFrame([("devops",), ("far",)], "name string"), members, instances)
    assert rows_of(found, "name", "region", "resource_id") == [
        ("devops", REGION, "devops-db"), ("devops", "us-east-1", "devops-db"), ("far", "us-east-1", "far-1"),
    ]


def test_target_checks(spark):
    good = {"name": "n", "account_id": ACCOUNT, "role_name": "r", "regions": [REGION, "us-east-1"]}
    assert target_regions(targets_table(spark, [good])).count() == 2
    assert target_regions(targets_table(spark, [{**good, "enabled": False}])).count() == 0
    for change in ({"account_id": "12"}, {"name": " "}, {"regions": []}, {"regions": "x"}, {"enabled": "yes"}):
        with pytest.raises(ValueError):
            targets_table(spark, [{**good, **change}])
    with pytest.raises(ValueError):
        targets_table(spark, [])


# ---- describe pages and collection ---------------------------------------


def test_pages_become_inventory(spark, tmp_path):
    head = {"account_id": ACCOUNT, "region": REGION}
    (tmp_path / "c").mkdir()
    (tmp_path / "i").mkdir()
    clusters = [
        {"DBClusterIdentifier": "orders", "Engine": "aurora-mysql", "EngineVersion": "8", "Status": "available",
         "DBClusterMembers": [
             {"DBInstanceIdentifier": "orders-a", "IsClusterWriter": True, "PromotionTier": 0},
             {"DBInstanceIdentifier": "orders-c"}]},
        {"DBClusterIdentifier": "lonely", "Engine": "aurora-mysql"},
    ]
    (tmp_path / "c" / "0.json").write_text(json.dumps({**head, "page_number": 0, "DBClusters": clusters[:1]}, indent=2))
    (tmp_path / "c" / "1.json").write_text(json.dumps({**head, "page_number": 1, "DBClusters": clusters[1:]}, indent=2))
    instances = [
        {"DBInstanceIdentifier": "orders-a", "DBClusterIdentifier": "orders", "Engine": "aurora-mysql", "DBInstanceStatus": "available"},
        {"DBInstanceIdentifier": "orders-c", "Engine": "aurora-mysql", "DBInstanceStatus": "available"},
        {"DBInstanceIdentifier": "solo", "Engine": "mysql", "DBInstanceStatus": "stopped", "MultiAZ": True},
        {"Engine": "mysql", "DBInstanceStatus": "available"},
    ]
    (tmp_path / "i" / "0.json").write_text(json.dumps({**head, "DBInstances": instances}, indent=2))
    pages = read_cluster_pages(spark, str(tmp_path / "c"))
    members = members_from_pages(pages)
    assert rows_of(clusters_from_pages(pages), "identifier", "status") == [("lonely", None), ("orders", "available")]
    assert rows_of(members, "identifier", "role", "promotion_tier") == [("orders-a", "writer", 0), ("orders-c", "reader", None)]
    flat = instances_from_pages(read_instance_pages(spark, str(tmp_path / "i")), members)
    assert flat.columns == INSTANCES.fieldNames()
    assert rows_of(flat, "identifier", "cluster_identifier", "cluster_role", "multi_az") == [
        ("orders-a", "orders", "writer", False), ("orders-c", "orders", "reader", False),
        ("solo", None, None, True), (None, None, None, False),
    ]
    assert rows_of(available(flat), "identifier") == [("orders-a",), ("orders-c",)]


@pytest.mark.parametrize(
    "engine, role, klass, storage, extra, profile",
    [
        ("aurora-mysql", "writer", "db.r6g.large", None, ["FreeLocalStorage", "AuroraReplicaLagMaximum"], "aurora-writer"),
        ("aurora-postgresql", "reader", "db.serverless", None, ["AuroraReplicaLag"], "aurora-reader"),
        ("Aurora-MySQL", None, "db.t4g.medium", "gp2", ["FreeLocalStorage", "CPUCreditBalance"], "aurora-instance"),
        ("mysql", None, "db.t3.micro", "gp2", ["FreeStorageSpace", "BinLogDiskUsage", "SwapUsage", "BurstBalance", "CPUCreditBalance"], "rds-mysql"),
        ("postgres", None, "db.m5.large", "gp3", ["FreeStorageSpace", "TransactionLogsDiskUsage", "SwapUsage"], "rds-postgres"),
        ("oracle-ee", None, "db.m5.large", "io1", ["FreeStorageSpace", "SwapUsage"], "rds-oracle-ee"),
        ("sqlserver-ex", None, "db.m5.large", None,
         ["FreeStorageSpace", "TempDbAvailableDataSpace", "TempDbAvailableLogSpace", "TempDbDataFileUsage", "TempDbLogFileUsage"], "rds-sqlserver-ex"),
        ("sqlserver-se", None, "db.m5.large", None,
         ["FreeStorageSpace", "TempDbAvailableDataSpace", "TempDbAvailableLogSpace", "TempDbDataFileUsage", "TempDbLogFileUsage", "FailedSQLServerAgentJobsCount"], "rds-sqlserver-se"),
        (None, None, None, None, ["FreeStorageSpace"], "rds-generic"),
    ],
)
def test_instance_rules(spark, engine, role, klass, storage, extra, profile):
    row = (ACCOUNT, REGION, 0, "x", None, engine, None, klass, None, "available", False, storage, False, None, role)
    got = instance_metrics(spark.createDataFrame([row], INSTANCES)).first()
    assert got.metrics == [*BASE_INSTANCE_METRICS, *extra]
    assert (got.resource_profile, got.metric_profile) == (profile, "operational-v1")


def test_collection_plan_and_summary(spark):
    clusters, members, instances = inventory(spark, {"orders": ["orders-a"]}, ["solo"])
    stopped = instances.withColumn("status", F.when(F.col("identifier") == "solo", "stopped").otherwise("available"))
    targets = targets_table(
        spark, [{"name": "main", "account_id": ACCOUNT, "role_name": "r", "regions": [REGION, "us-east-1"]}]
    )
    plan = collection_plan(targets, clusters, stopped)
    per = {r.resource_id: r["count"] for r in plan.groupBy("resource_id").count().collect()}
    assert per == {"orders-a": 14, "orders": 1}
    volume = plan.where("resource_id = 'orders'").first()
    assert (volume.cluster_role, volume.resource_dimension, volume.metric_name, volume.statistic) == (
        "cluster", "DBClusterIdentifier", "VolumeBytesUsed", "Average",
    )
    summary = collection_summary(targets, clusters, stopped, plan)
    assert rows_of(summary, "region", "cluster_count", "instance_count", "selected_instance_count", "uploaded_count") == [
        (REGION, 1, 2, 1, 15), ("us-east-1", 0, 0, 0, 0),
    ]
    few = collection_plan(targets, clusters, stopped, profile=None, metrics=["ReadIOPS", "CPUUtilization"])
    assert rows_of(few, "metric_name", "metric_pos", "resource_profile") == [
        ("CPUUtilization", 1, "explicit-metrics"), ("ReadIOPS", 0, "explicit-metrics"),
    ]
    for bad in ({"profile": "other"}, {"profile": None, "metrics": ["Nope"]}, {"profile": None}, {"metrics": ["ReadIOPS"]}):
        with pytest.raises(ValueError):
            planned_resources(targets, clusters, stopped, **bad)


def test_unknown_metrics_are_listed(spark):
    asked = spark.createDataFrame([("ReadIOPS",), ("Nope",)], "metric_name string")
    assert rows_of(unsupported_metrics(asked), "metric_name") == [("Nope",)]
    assert len(METRICS) == len({m for m, _, _ in METRICS}) == 28
