"""Operator 4: mix sources to target weights by Pareto order sampling.

A source whose target is at least its size gives every document a whole copy (two at the
limit). What is left of its target is a fixed-size sample: each document draws a random
number, its odds are divided by the document's inclusion odds, and the documents with the
smallest quotients are taken until the words left are used. Inclusion odds follow from the
target of the source and, if an ``odds`` column is named, from the document.

The smallest quotients are found without sorting a source: words are summed by source and
quotient bin, the bin in which the target falls is found from these sums, and only that
bin (one in 4096) is ordered. The result is a threshold for each source, so applying it
moves no text. Only DataFrame functions are used.

Defined cases: null text has size 0; a null source is the last source; a document with
size 0 takes no words; null ids draw like any other value; rows repeated with one id and
text share one draw and one decision; an empty table gives an empty result; columns beside
``doc_id``, ``text``, ``source`` are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, whole_row

#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)
BINS = 4096


def words(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str) -> Column:
    """A number in (0, 1) that depends on the document and the seed only."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target): weights share the total, none above ``most`` times its size.

    Filling up in order of limit / weight needs no iteration: the sources at their limit
    are a prefix of that order.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("long")
    order = Window.orderBy((F.col("limit") * 6 / F.col("weight")), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = each.select("source", "source_size", rank.alias("rank"), weight.alias("weight")).withColumn(
        "limit", F.col("source_size") * most
    )
    filled = ranked.select(
        "*",
        (F.sum("source_size").over(Window.partitionBy()) * share).alias("total"),
        F.coalesce(F.sum("limit").over(before), F.lit(0)).alias("used"),
        (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left"),
    )
    fair = F.col("weight") * (F.col("total") - F.col("used")) / F.col("left")
    full = F.col("limit") <= fair
    # The first source below its limit sets the level for all after it.
    judged = filled.select("*", full.alias("full"))
    level = F.first(F.when(~F.col("full"), (F.col("total") - F.col("used")) / F.col("left")), ignorenulls=True).over(
        Window.orderBy("full", F.col("limit") * 6 / F.col("weight"), "rank").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing
        )
    )
    return judged.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"),
    )


def _place(odds: str | None) -> dict[str, Column]:
    """Columns of a document beside its source's target: whole copies, the quotient, its bin."""
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("int")
    part = F.when(size > 0, (target - whole * size) / size).otherwise(F.lit(0.0))
    # (1 - u)/u turned round: v = q / (1 + q) for the quotient q keeps the order within (0, 1).
    favour = part / (1 - part) * (F.coalesce(F.col(odds).cast("double"), F.lit(1.0)) if odds else F.lit(1.0))
    quotient = F.col("u") / (F.col("u") + (1 - F.col("u")) * favour)
    bins = F.least(F.floor(quotient * BINS), F.lit(BINS - 1)).cast("int")
    return {"whole": whole, "left": target - whole * size, "quotient": quotient, "bin": bins}


def thresholds(base: DataFrame, aims: DataFrame, odds: str | None = None) -> DataFrame:
    """``aims`` with (cut, last): take what lies in bins below ``cut`` and, in it, up to ``last``."""
    named = aims.withColumnRenamed("source", "_source")
    placed = base.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumns(_place(odds))
    sums = placed.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("below", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where("below + words > left")
        .groupBy("source")
        .agg(F.min(F.struct("bin", "below")).alias("at"))
        .select(F.col("source").alias("_at_source"), F.col("at.bin").alias("cut"), F.col("at.below").alias("below"))
    )
    inside = placed.join(cuts, F.col("source").eqNullSafe(F.col("_at_source")) & (F.col("bin") == F.col("cut")))
    upto = Window.partitionBy("source").orderBy("quotient", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    sofar = F.col("below") + F.coalesce(F.sum("size").over(upto), F.lit(0))
    taken = inside.withColumn("middle", sofar * 2 + F.col("size")).where("middle <= 2 * left")
    last = taken.groupBy("source").agg(F.max(F.struct("quotient", "doc_id")).alias("last"))
    last = last.withColumnRenamed("source", "_last_source")
    found = named.join(cuts.drop("below"), F.col("_source").eqNullSafe(F.col("_at_source")), "left")
    return found.join(last, F.col("_source").eqNullSafe(F.col("_last_source")), "left").select(
        "_source", "source_size", "target", F.coalesce("cut", F.lit(BINS)).alias("cut"), "last"
    )


def with_copies(rows: DataFrame, limits: DataFrame, odds: str | None = None) -> DataFrame:
    """``rows`` (source, doc_id, u and others) with source_size, target and ``copies`` taken of each."""
    joined = rows.join(limits, F.col("source").eqNullSafe(F.col("_source"))).withColumns(_place(odds))
    inside = (F.col("bin") < F.col("cut")) | (
        (F.col("bin") == F.col("cut")) & F.coalesce(F.struct("quotient", "doc_id") <= F.col("last"), F.lit(False))
    )
    extra = F.when((F.col("left") > 0) & inside, 1).otherwise(0)
    return joined.withColumn("copies", F.col("whole") + extra).drop(
        "_source", "whole", "left", "quotient", "bin", "cut", "last", "u"
    )


def mix(docs: DataFrame, seed: str = "mix", share: float = 1.5, most: int = 2, odds: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged (doc_id, source, size, u) of every document and the thresholds of the sources."""
    extra = [odds] if odds else []
    base = staged(docs.select("doc_id", "source", words().alias("size"), draw(seed).alias("u"), *extra), "mix")
    aims = staged(targets(base, share, most), "targets")
    return base, staged(thresholds(base, aims, odds), "thresholds")


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    _, limits = mix(docs, seed)
    packed = docs.select("doc_id", "source", draw(seed).alias("u"), whole_row(docs).alias("row"))
    taken = with_copies(packed, limits).where("copies > 0")
    return taken.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    base, limits = mix(docs)
    return with_copies(base, limits).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(concat('mix', ':', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE
          + 0.5) / 4503599627370496.0 AS u
  FROM documents
), each AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank, source_size * 2 AS lim FROM each
), weighed AS (
  SELECT *, [3, 1, 2][(rank % 3 + 1)::INT]::BIGINT AS weight FROM ranked
), filled AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(lim) OVER w, 0) AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS remaining
  FROM weighed WINDOW w AS (ORDER BY lim * 6 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, (total - used::DOUBLE) / remaining::DOUBLE AS fair,
         lim::DOUBLE <= weight::DOUBLE * (total - used::DOUBLE) / remaining::DOUBLE AS at_limit FROM filled
), leveled AS (
  SELECT *, arg_min(fair, (lim * 6 / weight, rank)) FILTER (WHERE NOT at_limit) OVER () AS level FROM judged
), aims AS (
  SELECT source, source_size, CASE WHEN at_limit THEN lim::DOUBLE ELSE weight::DOUBLE * level END AS target FROM leveled
), parts AS (
  SELECT b.*, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN floor(a.target / a.source_size) ELSE 0 END AS whole
  FROM base b JOIN aims a ON b.source IS NOT DISTINCT FROM a.source
), ordered AS (
  SELECT *, target - whole * source_size AS remaining,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar
  FROM parts
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN remaining > 0 AND sofar * 2 + size <= 2 * remaining THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""
