"""Top SQL statements by average active sessions, and findings about them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..catalog import SQL_DISPLAY_LIMIT, SQL_TEXT_LIMIT, TRUNCATION_MARK
from ..functions import exact
from ..functions.rounding import with_even_round
from ..functions.timestamps import utc_literal
from ..functions.validators import check_lookback_minutes

IDLE_BELOW = 1.0

# Confidence code, display label.
CONFIDENCE_LABELS = (
    ("high", "가능성 높음"),
    ("medium", "가능성 보통"),
    ("low", "확인 필요"),
)


def load_window(sql_load: DataFrame, as_of: datetime, lookback_minutes: int) -> DataFrame:
    """Load samples of the last ``lookback_minutes`` up to and including ``as_of`` (UTC)."""
    check_lookback_minutes(lookback_minutes)
    start = as_of - timedelta(minutes=lookback_minutes)
    sampled = F.col("sample_ts")
    return sql_load.where(
        (sampled > utc_literal(start))
        & (sampled <= utc_literal(as_of))
    )


def average_load(samples: DataFrame, samples_in_window: int | None = None) -> DataFrame:
    """Average active sessions per (resource, statement id, statement text).

    A statement that is absent from a sample had no session in it, so its
    sessions are divided by the number of samples in the window: the given
    ``samples_in_window``, or the resource's distinct sample times.
    """
    summed = (
        exact.with_parts(samples, "_part", "active_sessions")
        .groupBy("resource_id", "sql_id", "sql_text")
        .agg(*map(F.expr, exact.sums("_part", "sessions")), F.count("active_sessions").alias("known"))
    )
    if samples_in_window is not None:
        counted = summed.withColumn("samples", F.lit(samples_in_window))
    else:
        sample_counts = samples.groupBy("resource_id").agg(
            F.count_distinct("sample_ts").alias("samples")
        )
        counted = summed.join(sample_counts, "resource_id")
    loads = counted.select(
        "resource_id",
        "sql_id",
        "sql_text",
        F.when(F.col("known") > 0, F.expr(exact.mean("sessions", "samples"))).alias("avg_active_sessions"),
    )
    return with_even_round(loads, "avg_active_sessions", 4)


def _four_decimals(load: Column) -> Column:
    """A load, already rounded to four decimals, as the decimal it stands for: sums of it are exact."""
    return load.try_cast("decimal(28,4)")


def truncated(text: Column, limit: int = SQL_TEXT_LIMIT) -> Column:
    """Text cut to ``limit`` characters plus a mark; text within the limit is untouched."""
    return F.when(
        F.char_length(text) > limit,
        F.concat(F.substring(text, 1, limit), F.lit(TRUNCATION_MARK)),
    ).otherwise(text)


def is_truncated(text: Column, limit: int = SQL_TEXT_LIMIT) -> Column:
    return F.coalesce(F.char_length(text) > limit, F.lit(False))


def truncate_statements(df: DataFrame, column: str = "sql_text") -> DataFrame:
    """Cut statements for reading along and flag the ones that were cut."""
    text = F.col(column)
    return df.withColumns({column: truncated(text), f"{column}_truncated": is_truncated(text)})


def with_display_text(df: DataFrame) -> DataFrame:
    """Add the short statement text for display and whether anything is missing from it."""
    text = F.col("sql_text")
    return df.withColumns(
        {
            "display_text": truncated(text, SQL_DISPLAY_LIMIT),
            "display_shortened": F.when(
                F.coalesce(text, F.lit("")) == "", F.lit(False)
            ).otherwise(F.col("sql_text_truncated") | is_truncated(text, SQL_DISPLAY_LIMIT)),
        }
    )


def top_statements(loads: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` heaviest statements of each resource, ranked from 1.

    Ties go to the smaller statement id, then the smaller text. The rank filter
    becomes a group limit before the shuffle, so a resource with any number of
    statements sends at most ``k`` rows per map task.
    """
    heaviest = Window.partitionBy("resource_id").orderBy(
        F.col("avg_active_sessions").desc(), F.col("sql_id").asc(), F.col("sql_text").asc()
    )
    ranked = loads.withColumn("rank", F.row_number().over(heaviest)).where(F.col("rank") <= k)
    return truncate_statements(ranked)


def total_load(ranked: DataFrame) -> DataFrame:
    """Summed load of each resource's ranked statements, and whether it is near idle."""
    totals = ranked.groupBy("resource_id").agg(
        F.sum(F.coalesce(_four_decimals(F.col("avg_active_sessions")), F.lit(0)))
        .cast("double")
        .alias("total_active_sessions"),
        F.count("*").alias("ranked_statements"),
    )
    return totals.withColumn(
        "load_note", F.when(F.col("total_active_sessions") < IDLE_BELOW, "idle")
    )


def with_share(ranked: DataFrame) -> DataFrame:
    """Add each statement's share of its resource's ranked load (at most k rows per group)."""
    total = F.sum(_four_decimals(F.col("avg_active_sessions"))).over(Window.partitionBy("resource_id")).cast("double")
    shared = ranked.withColumn("ranked_load", total).withColumn(
        "load_share", F.when(F.col("ranked_load") > 0, F.col("avg_active_sessions") / F.col("ranked_load"))
    )
    return with_even_round(shared.drop("ranked_load"), "load_share", 4)


def normalize_findings(findings: DataFrame) -> DataFrame:
    """Explode finding lists and keep entries that point at a ranked statement.

    Dropped: no resource, no integer rank of at least 1, no finding text. A rank given as
    a number is cut to its integer part; one given as text must be written as an integer.
    Confidence defaults to ``low``. ``position`` is the place in the list.
    """
    entry = findings.select(F.posexplode("queries").alias("position", "q")).select("position", "q.*")

    def clean(name: str) -> Column:
        return F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", "")

    confidence = F.coalesce(F.nullif(F.col("confidence"), F.lit("")), F.lit("low"))
    if isinstance(entry.schema["rank"].dataType, T.StringType):
        rank = F.when(F.col("rank").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("rank").try_cast("int"))
    else:
        rank = F.col("rank").try_cast("int")
    return entry.select(
        clean("resource_id").alias("resource_id"),
        rank.alias("rank"),
        clean("finding").alias("finding"),
        clean("suggestion").alias("suggestion"),
        F.regexp_replace(confidence, r"(?U)^\s+|\s+$", "").alias("confidence"),
        "position",
    ).where((F.col("resource_id") != "") & (F.col("rank") >= 1) & (F.col("finding") != ""))


def normalize_finding_documents(documents: DataFrame, column: str = "document") -> DataFrame:
    """:func:`normalize_findings` of whole answers in a VARIANT column.

    Entries keep the types they were given: a rank that is a number is cut to its integer part,
    one that is text must be written as an integer, so 3.7 counts as 3 and "3.7" is dropped. Entries
    that are no objects are dropped, and zero or false is no resource, as it is no text.
    """
    entry = documents.select(F.expr(f"posexplode(try_variant_get({column}, '$.queries', 'array<variant>')) AS (position, q)"))
    whole = r"^\\s*[+-]?[0-9]+\\s*$"

    def text(name: str) -> Column:
        as_text, kind = f"try_variant_get(q, '$.{name}', 'string')", f"schema_of_variant(try_variant_get(q, '$.{name}', 'variant'))"
        nothing = f"{kind} <> 'STRING' AND try_variant_get(q, '$.{name}', 'double') = 0"
        return F.regexp_replace(F.expr(f"CASE WHEN {nothing} THEN '' ELSE coalesce({as_text}, '') END"), r"(?U)^\s+|\s+$", "")

    given, rank_text = "schema_of_variant(try_variant_get(q, '$.rank', 'variant'))", "try_variant_get(q, '$.rank', 'string')"
    rank = F.expr(
        f"CASE WHEN {given} = 'STRING' THEN CASE WHEN {rank_text} RLIKE '{whole}' THEN try_cast(trim({rank_text}) AS INT) END "
        "ELSE try_cast(try_variant_get(q, '$.rank', 'double') AS INT) END"
    )
    confidence = text("confidence")
    return entry.select(
        text("resource_id").alias("resource_id"),
        rank.alias("rank"),
        text("finding").alias("finding"),
        text("suggestion").alias("suggestion"),
        F.when(confidence == "", "low").otherwise(confidence).alias("confidence"),
        "position",
    ).where((F.col("resource_id") != "") & (F.col("rank") >= 1) & (F.col("finding") != ""))


def confidence_label(confidence: Column) -> Column:
    """Display label of a confidence code; an unknown code is shown as it is."""
    label = confidence
    for code, text in reversed(CONFIDENCE_LABELS):
        label = F.when(confidence == code, F.lit(text)).otherwise(label)
    return label


def attach_findings(ranked: DataFrame, findings: DataFrame) -> DataFrame:
    """Left-join normalized findings to ranked statements by resource and rank.

    Of several findings for one statement the last of the list stands (of several
    lists, the greatest of those), so the ranking never gains rows. ``capped_confidence`` is ``low`` for any
    statement that was cut: its missing tail could change the conclusion.
    """
    entry = F.struct("finding", "suggestion", "confidence")
    one = findings.groupBy("resource_id", "rank").agg(F.max_by(entry, F.struct("position", entry)).alias("entry"))
    joined = ranked.join(one, ["resource_id", "rank"], "left")
    return joined.select(
        *ranked.columns,
        F.col("entry.finding").alias("finding"),
        F.col("entry.suggestion").alias("suggestion"),
        F.col("entry.confidence").alias("confidence"),
        confidence_label(F.col("entry.confidence")).alias("confidence_label"),
        F.when(F.col("entry").isNotNull() & F.col("sql_text_truncated"), F.lit("low"))
        .otherwise(F.col("entry.confidence"))
        .alias("capped_confidence"),
    )
