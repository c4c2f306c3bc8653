"""The curated table in the catalogue: every hour a folder of one version, swapped as a whole.

A refresh writes the hours it touches into a folder of its own and then points their
partitions there, one catalogue change for each hour. A reader of the table sees an hour as it
was or as it is, never half of it and never an hour without files, wherever a refresh stops.
Files that were published are never written again, so plans already running stay valid.

Partitions are chosen by the catalogue before anything is listed: a report over some days lists
their folders only, however many years the table has.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from datetime import date
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession

from ..schemas import CURATED, PARTITION_COLUMNS
from .curated import write_curated

#: Partitions added by one statement.
ADDED_AT_ONCE = 200
# What a partitioned write spells as %XX in folder names, beside control characters.
ESCAPED = frozenset("\"#%'*/:=?\\{[]^\x7f")


def create_published(spark: SparkSession, table: str, root: str) -> None:
    """Make ``table`` an empty external table whose partitions live below ``root``."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CURATED.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"PARTITIONED BY ({', '.join(PARTITION_COLUMNS)}) LOCATION '{_quoted(root)}'"
    )


def read_published(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table).select(*CURATED.fieldNames())


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _folder_name(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or c < " " else c for c in value)


def _literal(value: str | date) -> str:
    return f"DATE '{value}'" if isinstance(value, date) else f"'{_quoted(value)}'"


def partition_filter(partitions: Sequence[Sequence], columns: Sequence[str] = PARTITION_COLUMNS) -> str:
    """A condition on partition columns alone that holds for exactly these values of them.

    The range of days comes first, as every catalogue understands it.
    """
    days = [p[list(columns).index("date")] for p in partitions]
    listed = ", ".join(f"({', '.join(map(_literal, p))})" for p in partitions)
    return f"date BETWEEN {_literal(min(days))} AND {_literal(max(days))} AND ({', '.join(columns)}) IN ({listed})"


def published_hours(spark: SparkSession, table: str, hours: Sequence[Row]) -> DataFrame:
    """The table's rows of exactly these hours; no other folder is listed."""
    rows = read_published(spark, table)
    return rows.where(partition_filter(hours)) if hours else rows.limit(0)


def touched_hours(rows: DataFrame) -> list[Row]:
    """The hours of ``rows``, one entry for each partition a refresh will swap."""
    return sorted(rows.select(*PARTITION_COLUMNS).distinct().collect())


def _partition(hour: Row) -> str:
    return "PARTITION (" + ", ".join(f"{c}={_literal(hour[c])}" for c in PARTITION_COLUMNS) + ")"


def _known(spark: SparkSession, table: str, hours: Sequence[Row]) -> set[tuple[str, ...]]:
    """Those of the hours that have a partition; the catalogue is asked day by day."""
    found = set()
    for day, _ in groupby(hours, key=lambda h: tuple(h[c] for c in PARTITION_COLUMNS[:-1])):
        within = ", ".join(f"{c}={_literal(v)}" for c, v in zip(PARTITION_COLUMNS, day))
        for row in spark.sql(f"SHOW PARTITIONS {table} PARTITION ({within})").collect():
            found.add((*map(str, day), row[0].rsplit("=", 1)[1]))
    return found


def publish_hours(spark: SparkSession, table: str, root: str, rows: DataFrame, hours: Iterable[Row]) -> None:
    """Write ``rows``, the whole new content of ``hours``, and swap each hour for it.

    New partitions come first. Running it again after a stop anywhere gives the same table;
    versions that no partition names any more can be removed when no old plan reads them.
    """
    hours = sorted(hours)
    if not hours:
        return
    create_published(spark, table, root)
    version = f"{root.rstrip('/')}/_versions/{uuid.uuid4().hex}"
    write_curated(rows, version)

    def place(hour: Row) -> str:
        return version + "".join(f"/{c}={_folder_name(str(hour[c]))}" for c in PARTITION_COLUMNS)

    known = _known(spark, table, hours)
    new = [h for h in hours if tuple(str(h[c]) for c in PARTITION_COLUMNS) not in known]
    for first in range(0, len(new), ADDED_AT_ONCE):
        added = " ".join(f"{_partition(h)} LOCATION '{_quoted(place(h))}'" for h in new[first : first + ADDED_AT_ONCE])
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")
    for hour in hours:
        if hour not in new:
            swap_hour(spark, table, hour, place(hour))


def swap_hour(spark: SparkSession, table: str, hour: Row, place: str) -> None:
    """Point one partition to another folder: the step in which readers change over."""
    spark.sql(f"ALTER TABLE {table} {_partition(hour)} SET LOCATION '{_quoted(place)}'")
