"""Live health as a sliding event-time window, on a batch frame or kept up by a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..catalog import LIVE_STATS
from ..functions.timestamps import instant_to_utc, utc_to_instant
from ..operators.dedup import SAMPLE_KEY
from ..operators.flatten import POSITION, flatten
from ..operators.metrics import finished_stats, mergeable_stats, stats_by_metric, with_value_parts
from ..sources.files import delete_folder, staged
from ..sources.raw import stream_raw

EVENT_TIME = "event_time"
#: What is kept of a sample while a window of it is open.
OPEN_SAMPLE = (*SAMPLE_KEY, "value")
_DAY = 86_400_000_000


def with_event_time(rows: DataFrame, late_by: str) -> DataFrame:
    """Rows with their sample time as an instant, and the watermark on it."""
    timed = rows.withColumn(EVENT_TIME, utc_to_instant(F.col("metric_timestamp")))
    return timed.withWatermark(EVENT_TIME, late_by)


def _bounds(windowed: DataFrame) -> DataFrame:
    return windowed.withColumns(
        {"window_start": instant_to_utc(F.col("w.start")), "window_end": instant_to_utc(F.col("w.end"))}
    )


def _windowed(timed: DataFrame, window: str, slide: str) -> DataFrame:
    """Windows of a stream: one stateful aggregate."""
    grouped = _bounds(
        with_value_parts(timed, LIVE_STATS)
        .groupBy(F.window(EVENT_TIME, window, slide).alias("w"), "resource_id")
        .agg(*map(F.expr, mergeable_stats(LIVE_STATS)))
    )
    return finished_stats(grouped, LIVE_STATS, "window_start", "window_end", "resource_id")


def _micros(spark: SparkSession, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.lit(interval).cast("interval"))).first()[0]


def _at() -> Column:
    """The sample time in microseconds since 1970."""
    return F.unix_micros(utc_to_instant(F.col("metric_timestamp")))


def _windows_of(
    rows: DataFrame, window: str, slide: str, closed: tuple[int, int] | None = None
) -> DataFrame:
    """Windows of a batch frame, of those whose end lies after the first of two moments and up to the second.

    Samples, not their copies in every window, are dealt out, by resource and day of the window's
    start: all rows of a window then lie in one task, and a resource of any size is spread over
    its days. Each window is one small row per metric it has.
    """
    spark = rows.sparkSession
    long, step = _micros(spark, window), _micros(spark, slide)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = F.col("_at") - F.pmod("_at", F.lit(step))
    first = last - (long - 1) // step * step
    day, start = F.col("_day"), F.col("_start")
    dealt = (
        rows.select("resource_id", "metric_name", "value", _at().alias("_at"))
        .withColumn("_day", F.explode(F.sequence(F.floor(first / _DAY), F.floor(last / _DAY))))
        .repartition(parts, "resource_id", "_day")
    )
    # Exploded, not F.window: an Expand would forget how the rows are dealt out.
    opened = dealt.withColumn("_start", F.explode(F.sequence(first, last, F.lit(step)))).where(
        (start > F.col("_at") - long) & (F.floor(start / _DAY) == day)
    )
    if closed is not None:
        opened = opened.where((start > closed[0] - long) & (start <= closed[1] - long))
    return stats_by_metric(opened, ("resource_id", "_day", "_start"), LIVE_STATS).select(
        instant_to_utc(F.timestamp_micros(start)).alias("window_start"),
        instant_to_utc(F.timestamp_micros(start + long)).alias("window_end"),
        "resource_id",
        *[column for _, _, column, _ in LIVE_STATS],
    )


def sliding_health(
    curated: DataFrame,
    window: str = "30 minutes",
    slide: str = "5 minutes",
    late_by: str = "15 minutes",
) -> DataFrame:
    """Health statistics per resource and window; samples later than ``late_by`` are too late.

    The same aggregates as the batch live report. Batch frames have no late samples; there a
    window costs a small row for each metric it has. State of a stream per (window, resource) is
    one fixed-size aggregation buffer.
    """
    if curated.isStreaming:
        return _windowed(with_event_time(curated, late_by), window, slide)
    return _windows_of(curated, window, slide)


def _first_seen(fresh: DataFrame, kept: DataFrame | None) -> DataFrame:
    """One row per sample: one kept from earlier batches, else the first collected."""
    order = ("collected_at", "source_file", POSITION)
    rows = fresh.select(*OPEN_SAMPLE, *order)
    if kept is not None:
        rows = kept.unionByName(rows, allowMissingColumns=True)
    # Kept samples have no file and come first.
    first = Window.partitionBy(*SAMPLE_KEY).orderBy(
        F.col("collected_at").asc_nulls_first(), F.split("source_file", "/").asc_nulls_first(), POSITION
    )
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select(*OPEN_SAMPLE)


def _state_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema[c] for c in OPEN_SAMPLE] + [T.StructField("mark", T.LongType())])


def close_windows(
    fresh: DataFrame, batch_id: int, sink_root: str, state_root: str, window: str, slide: str, late_by: str
) -> None:
    """Add a batch of curated rows to the open samples and write the windows that it closes.

    ``after=<id>`` under ``state_root`` holds the watermark and the samples of open windows, as
    they are after that batch. A replayed batch starts from the state before it and replaces what
    it had written. The watermark begins at 1970, as in any stream.
    """
    spark = fresh.sparkSession
    sink, state = sink_root.rstrip("/"), state_root.rstrip("/")
    kept, before = None, 0
    if batch_id:
        kept = spark.read.schema(_state_schema(fresh)).parquet(f"{state}/after={batch_id - 1}")
        before = kept.agg(F.coalesce(F.max("mark"), F.lit(0))).first()[0]
        kept = kept.select(*OPEN_SAMPLE)
    with staged(_first_seen(fresh.where(_at() > before), kept), sink) as rows:
        newest = rows.agg(F.max(_at())).first()[0]
        # Whole milliseconds, as watermarks are.
        after = before if newest is None else max(before, newest // 1000 * 1000 - _micros(spark, late_by))
        windows = _windows_of(rows, window, slide, (before, after))
        windows.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        still_open = rows.where(_at() + _micros(spark, window) > after).withColumn("mark", F.lit(after).cast("long"))
        still_open.write.mode("overwrite").parquet(f"{state}/after={batch_id}")
    if batch_id > 1:
        delete_folder(spark, f"{state}/after={batch_id - 2}")


def live_health_stream(
    spark: SparkSession,
    raw_root: str,
    sink_root: str,
    checkpoint_root: str,
    window: str = "30 minutes",
    slide: str = "5 minutes",
    late_by: str = "15 minutes",
    max_files_per_trigger: int = 100_000,
    multi_line: bool = True,
    partitioned_only: bool = False,
) -> StreamingQuery:
    """Keep closed windows of live health as Parquet under ``sink_root``, then stop.

    Payloads not seen before are flattened; a sample collected twice counts once, the
    first one seen (later ones come while its state is kept, ``late_by`` of event time).
    Every run goes on from the state and the watermark in ``checkpoint_root``: a sample
    that is not newer than the watermark of the batches before is too late and left out, a window
    is written once, in the batch whose watermark has passed its end. State is the samples of
    open windows, a small row each; windows that open and close within a batch never enter it. Refused
    rows are left out; the curated refresh reports them. Read the sink with :func:`read_live_health`.
    """
    stream = stream_raw(spark, raw_root, max_files_per_trigger, multi_line, partitioned_only)

    def close(batch: DataFrame, number: int) -> None:
        rows = flatten(batch, "quarantine")
        close_windows(rows, number, sink_root, f"{checkpoint_root.rstrip('/')}/open_windows", window, slide, late_by)

    return (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint_root)
        .foreachBatch(close)
        .start()
    )


def read_live_health(spark: SparkSession, sink_root: str) -> DataFrame:
    """The closed windows of every batch; a replayed batch has replaced its own."""
    return spark.read.parquet(sink_root).drop("batch_id")
