"""From raw documents to tokens: five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns of
``documents`` (and pass further columns through).

Defined cases are those of the operators: rows without a word are rejected by the first
stage; rows repeated with one id and text get one decision and leave the third stage as one
row; a null id is a value like any other; a null source is the last source; an empty table
passes through as an empty one. A text that loses lines gets a new ``n_chars``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmetrics.llm import bpe, line_dedup, mixing, ngram_join, quality_classifier
from fleetmetrics.llm.common import check_of, staged, whole_row

#: The tokenizer file of the last stage.
TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; the rejected go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    found = quality_classifier.resampled(docs, labels).where("kept")
    none = F.lit(-(1 << 63))
    kept = found.select(F.coalesce("doc_id", none).alias("_doc"), F.col("check").alias("_check")).distinct()
    keyed = docs.select(
        F.coalesce("doc_id", none).alias("_doc"), check_of().alias("_check"), whole_row(docs).alias("row")
    )
    return keyed.join(kept, ["_doc", "_check"], "left_semi").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least three documents share, but for the largest id's."""
    others = whole_row(docs.drop("text")).alias("row")
    applied = line_dedup.apply_bitmaps(docs.select("doc_id", "text", others), line_dedup.keep_bitmaps(docs))
    row = F.col("row")
    if "n_chars" in docs.columns:
        length = F.when(F.col("_n_dropped") > 0, F.length("_kept").cast("long")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", length)
    changed = applied.select(F.col("_kept").alias("text"), row.alias("row")).select("text", "row.*")
    return changed.select(*[f"`{name}`" for name in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents, that with the smallest id; ids do not join groups."""
    return ngram_join.one_of_each(docs, ngram_join.similar_documents(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    done = bpe.encoded(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER), decode=True)
    return done.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe", encode_tokens),
]

#: Models and tokenizers are beyond SQL; the README says what tests/llm checks of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
