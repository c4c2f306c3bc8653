"""Incremental refresh: new raw payloads merged into the curated hours they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import deduplicate, merge_hours
from ..operators.flatten import REASON, accepted, check_quarantine, headers, judged, refused, rows_of
from ..operators.rollup import refresh_days
from ..schemas import PARTITION_COLUMNS
from ..sources.curated import hours_of, write_curated
from ..sources.files import staged
from ..sources.published import create_published, publish_hours, published_hours, touched_hours
from ..sources.raw import stream_raw


def merge_batch(
    batch: DataFrame,
    curated_root: str,
    on_error: str = "fail",
    quarantine_root: str | None = None,
    batch_id: int = 0,
    table: str | None = None,
    rollup_root: str | None = None,
    stats_root: str | None = None,
) -> None:
    """Merge one batch of payloads into the curated table.

    The payloads are parsed once: their rows are staged below ``curated_root``, on storage that
    outlives an executor, and the touched hours, the merge and the refused rows are read from
    there. The touched hours are read back, united with the new rows, de-duplicated
    and replaced as a whole, so replaying a batch changes nothing. With ``table`` the hours are
    published in that catalogue table, each swapped at once; without, they are overwritten in
    place. With ``rollup_root`` the daily states of the touched days follow (``table`` needed), with
    ``stats_root`` the counts of the batch (see :func:`read_batch_stats`). With
    ``on_error="quarantine"`` the refused rows replace ``batch_id=<id>`` under
    ``quarantine_root``, so a replay does not repeat them either.
    """
    check_quarantine(on_error, quarantine_root)
    if rollup_root and not table:
        raise ValueError("a rollup follows a published table: pass table")
    spark = batch.sparkSession
    read, flat, kept = Observation("payloads"), Observation("datapoints"), Observation("curated")
    payloads = headers(batch).observe(
        read,
        F.count(F.lit(1)).alias("raw_payload_count"),
        F.count_if(F.size("datapoints") == 0).alias("no_data_payload_count"),
    )
    parsed = judged(payloads) if on_error == "quarantine" else rows_of(payloads, on_error)
    bad = F.col(REASON).isNotNull() if on_error == "quarantine" else F.lit(False)
    parsed = parsed.observe(
        flat, F.count_if(~bad).alias("raw_datapoint_count"), F.count_if(bad).alias("rejected_count")
    )
    with staged(parsed, curated_root) as rows:
        # Hours are asked of the staged rows: copies of a sample lie in its hour, so nothing is ranked for them.
        fresh = accepted(rows) if on_error == "quarantine" else rows
        latest = deduplicate(fresh).observe(kept, F.count(F.lit(1)).alias("curated_row_count"))
        hours = touched_hours(fresh) if table or stats_root else []
        if table:
            create_published(spark, table, curated_root)
            publish_hours(spark, table, curated_root, merge_hours(latest, published_hours(spark, table, hours)), hours)
            if rollup_root:
                refresh_days(spark, table, rollup_root, hours)
        else:
            touched = fresh.select(*PARTITION_COLUMNS).distinct()
            write_curated(merge_hours(latest, hours_of(spark, curated_root, touched)), curated_root)
        if on_error == "quarantine":
            refused(rows).write.mode("overwrite").parquet(f"{quarantine_root.rstrip('/')}/batch_id={batch_id}")
    if stats_root:
        counts = {**read.get, **flat.get, **(kept.get if hours else {"curated_row_count": 0})}
        counts["duplicates_removed"] = counts["raw_datapoint_count"] - counts["curated_row_count"]
        counts["touched_hour_count"] = len(hours)
        files = batch.select("source_file", "source_bytes").distinct()
        files = files.agg(F.count("*").alias("raw_file_count"), F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("raw_bytes"))
        row = files.withColumns({name: F.lit(n).cast("long") for name, n in counts.items()})
        row.write.mode("overwrite").parquet(f"{stats_root.rstrip('/')}/batch_id={batch_id}")


def read_batch_stats(spark: SparkSession, stats_root: str) -> DataFrame:
    """One row a batch: files, bytes, payloads, datapoints, refused and curated rows, touched hours.

    A replayed batch has replaced its row.
    """
    return spark.read.parquet(stats_root)


def incremental_curate(
    spark: SparkSession,
    raw_root: str,
    curated_root: str,
    checkpoint_root: str,
    on_error: str = "fail",
    max_files_per_trigger: int = 100_000,
    multi_line: bool = True,
    partitioned_only: bool = False,
    quarantine_root: str | None = None,
    table: str | None = None,
    rollup_root: str | None = None,
    stats_root: str | None = None,
) -> StreamingQuery:
    """Process every raw file not seen before, then stop (``availableNow``).

    Progress lives in ``checkpoint_root``, which must be shared storage. A batch
    that fails between hours is replayed from the raw files; readers of ``table`` see whole
    hours meanwhile. ``partitioned_only`` leaves out objects without an account partition.
    """
    check_quarantine(on_error, quarantine_root)
    stream = stream_raw(spark, raw_root, max_files_per_trigger, multi_line, partitioned_only)

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(batch, curated_root, on_error, quarantine_root, number, table, rollup_root, stats_root)

    return (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint_root)
        .foreachBatch(merge)
        .start()
    )
