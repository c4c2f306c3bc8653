"""Small fixtures shared by the tests."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from fleetmetrics.schemas import CLUSTER_MEMBERS, CLUSTERS, CURATED, INSTANCES, RAW_PAYLOAD

ACCOUNT = "012345678901"
REGION = "ap-northeast-2"


#: When the sample payload was collected, and its one datapoint.
COLLECTED, SAMPLED, VALUE = "2026-08-19T05:12:30Z", "2026-08-19T05:05:00Z", 17.25


def payload(**changes) -> dict:
    """A document with a value for every field of the raw schema; ``...`` leaves a field out."""
    made = {f.name: f"some {f.name}" if f.dataType.typeName() == "string" else 300 for f in RAW_PAYLOAD.fields}
    made |= {"source_account_id": ACCOUNT, "region": REGION, "resource_id": "ledger-3", "metric_name": "CPUUtilization"}
    made |= {"collected_at": COLLECTED, "datapoints": [{"timestamp": SAMPLED, "value": VALUE}]}
    return {name: value for name, value in (made | changes).items() if value is not ...}


def write_payload(root: Path, name: str, document) -> None:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    text = document if isinstance(document, str) else json.dumps(document, indent=2)
    path.write_text(text, encoding="utf-8")


def curated(spark: SparkSession, samples: list[tuple]) -> DataFrame:
    """Curated rows from (resource, engine, role, metric, timestamp, value)."""
    rows = [
        ("t", resource, engine, None, role, None, None, metric, "Average", "Count", ts, float(value), 300,
         ts + timedelta(minutes=5), "f.json", ACCOUNT, REGION, ts.date(), f"{ts:%H}")
        for resource, engine, role, metric, ts, value in samples
    ]
    return spark.createDataFrame(rows, CURATED)


def history(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        [(r, date.fromisoformat(d), f, u) for r, d, f, u in rows],
        "resource_id string, date date, free_storage_space_bytes double, volume_bytes_used double",
    )


def inventory(spark: SparkSession, clusters: dict[str, list[str]], standalone: list[str] = (), account: str = ACCOUNT):
    """(clusters, members, instances) from cluster -> member names."""
    cluster_rows, member_rows, instance_rows = [], [], []
    for number, (name, members) in enumerate(clusters.items()):
        cluster_rows.append((account, REGION, number, name, "aurora-mysql", "1", "available"))
        for pos, member in enumerate(members):
            role = "writer" if pos == 0 else "reader"
            member_rows.append((account, REGION, number, name, pos, member, role, pos))
            if member is not None:
                instance_rows.append(_instance(account, len(instance_rows), member, name, role))
    for name in standalone:
        instance_rows.append(_instance(account, len(instance_rows), name, None, None))
    return (
        spark.createDataFrame(cluster_rows, CLUSTERS),
        spark.createDataFrame(member_rows, CLUSTER_MEMBERS),
        spark.createDataFrame(instance_rows, INSTANCES),
    )


def _instance(account, ordinal, name, cluster, role):
    engine = "aurora-mysql" if cluster else "mysql"
    return (account, REGION, ordinal, name, f"db-{ordinal}X", engine, "1", "db.r6g.large", "a", "available",
            False, "gp3", True, cluster, role)


def rows_of(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)
