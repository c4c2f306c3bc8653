"""Batch refresh: raw payloads to the curated table."""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import nullcontext
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..operators.dedup import SAMPLE_KEY, deduplicate, merge_hours
from ..operators.flatten import REASON, accepted, check_quarantine, headers, judged, refused, rows_of
from ..schemas import PARTITION_COLUMNS
from ..sources.curated import hours_of, register_curated, write_curated
from ..sources.files import staged
from ..sources.published import create_published, publish_hours, published_hours, touched_hours
from ..sources.raw import list_objects, object_counts, read_raw


def curate(
    spark: SparkSession,
    raw_root: str,
    curated_root: str,
    on_error: str = "fail",
    quarantine_root: str | None = None,
    partitioned_only: bool = False,
    collection_dates: Iterable[str] | None = None,
    multi_line: bool = True,
    table: str | None = None,
    file_stats: bool = False,
    publish_to: str | None = None,
    variant: bool = False,
) -> dict[str, int]:
    """Flatten, de-duplicate and write every raw payload; return refresh statistics.

    Only the hours that occur in the input are overwritten, so running twice
    gives the same table. With ``collection_dates`` the refresh reads only the
    payloads collected on those days and merges them into the hours they touch.
    With ``on_error="quarantine"`` the
    refused rows replace what ``quarantine_root`` holds, each with its reason, and are
    counted. ``table`` registers the hours found under ``curated_root``; ``publish_to`` instead
    keeps a catalogue table whose hours are swapped one by one (:mod:`..sources.published`).
    Payloads are parsed once: where their rows are needed more than once they are staged below
    ``curated_root``. The row statistics are observed while the jobs run;
    ``file_stats`` adds a listing of the files written.
    """
    check_quarantine(on_error, quarantine_root)
    collection_dates = None if collection_dates is None else list(collection_dates)
    quarantine, partial = on_error == "quarantine", collection_dates is not None
    started = datetime.now(timezone.utc)
    raw = read_raw(spark, raw_root, partitioned_only, collection_dates, multi_line, variant)
    if raw.select("source_file").isEmpty():
        raise ValueError(f"No raw JSON files found under {raw_root}")

    read, flat, kept = Observation("payloads"), Observation("datapoints"), Observation("curated")
    payloads = headers(raw).observe(
        read,
        F.count(F.lit(1)).alias("raw_payload_count"),
        F.count_if(F.size("datapoints") == 0).alias("no_data_payload_count"),
    )
    parsed = judged(payloads) if quarantine else rows_of(payloads, on_error)
    bad = F.col(REASON).isNotNull() if quarantine else F.lit(False)
    parsed = parsed.observe(
        flat, F.count_if(~bad).alias("raw_datapoint_count"), F.count_if(bad).alias("rejected_count")
    )
    several_uses = quarantine or partial or publish_to
    with staged(parsed, curated_root) if several_uses else nullcontext(parsed) as rows:
        fresh = accepted(rows) if quarantine else rows
        latest = deduplicate(fresh).observe(kept, F.count(F.lit(1)).alias("curated_row_count"))
        hours = touched_hours(fresh) if partial or publish_to else None
        if publish_to:
            create_published(spark, publish_to, curated_root)
            # Part of the payloads only: their hours may hold samples of the others.
            merged = merge_hours(latest, published_hours(spark, publish_to, hours)) if partial else latest
            publish_hours(spark, publish_to, curated_root, merged, hours)
        else:
            merged = latest
            if partial:
                touched = fresh.select(*PARTITION_COLUMNS).distinct()
                merged = merge_hours(latest, hours_of(spark, curated_root, touched))
            write_curated(merged, curated_root)
        if quarantine:
            refused(rows).write.mode("overwrite").parquet(quarantine_root)
    if table:
        register_curated(spark, table, curated_root, hours)

    stats = {**read.get, **flat.get, **(kept.get if hours != [] or not publish_to else {"curated_row_count": 0})}
    stats["duplicates_removed"] = stats["raw_datapoint_count"] - stats["curated_row_count"]
    if partitioned_only:
        stats["skipped_object_count"] = object_counts(spark, raw_root).first()["skipped_count"]
    if file_stats:
        stats.update(written_files(spark, curated_root, started))
    return stats


def written_files(spark: SparkSession, root: str, since: datetime) -> dict[str, int]:
    """Files, hours and bytes that appeared under ``root`` since a moment."""
    stamp = since.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .option("modifiedAfter", stamp)
        .option("timeZone", "UTC")
        .load(root)
        .select("path", "length")
    )
    row = files.agg(
        F.count(F.lit(1)).alias("parquet_file_count"),
        F.count_distinct(F.regexp_replace("path", r"/[^/]*$", "")).alias("partition_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("parquet_total_bytes"),
    ).first()
    return row.asDict()


def refresh_statistics(raw: DataFrame) -> DataFrame:
    """The refresh counts of a set of payloads as one row, without writing anything.

    ``raw_datapoint_count`` counts readable datapoints, ``rejected_count`` refused payloads
    and refused datapoints of accepted ones, as the quarantine holds them.
    """
    header_rows = headers(raw)
    rows = rows_of(header_rows, "quarantine")
    payload_counts = header_rows.agg(
        F.count(F.lit(1)).alias("raw_payload_count"),
        F.count_if(F.size("datapoints") == 0).alias("no_data_payload_count"),
        F.coalesce(F.sum(F.when(F.col(REASON).isNull(), F.size("datapoints"))), F.lit(0)).alias("_listed"),
        F.count_if(F.col(REASON).isNotNull()).alias("_refused"),
    )
    # One row per sample, with its copies: counting needs no ordering of them.
    samples = rows.groupBy(*dict.fromkeys((*SAMPLE_KEY, *PARTITION_COLUMNS))).agg(F.count(F.lit(1)).alias("copies"))
    curated_counts = (
        samples.groupBy(*PARTITION_COLUMNS)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
        .agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_datapoint_count"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("curated_row_count"),
            F.count(F.lit(1)).alias("partition_count"),
        )
    )
    counts = payload_counts.unionByName(curated_counts, allowMissingColumns=True)
    row = counts.agg(*[F.max(c).alias(c) for c in counts.columns])
    listed, refused, readable = F.col("_listed"), F.col("_refused"), F.col("raw_datapoint_count")
    return row.withColumns(
        {
            "rejected_count": refused + listed - readable,
            "duplicates_removed": readable - F.col("curated_row_count"),
        }
    ).drop("_listed", "_refused")


__all__ = ["curate", "list_objects", "refresh_statistics", "written_files"]
