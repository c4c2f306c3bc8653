"""Operator 10: quality by importance resampling.

Two generative models over hashed word and word-pair counts, one of good documents and one
of the whole corpus, give each document a log importance weight: the sum over its n-grams
of log p(target) - log p(raw). Weights plus Gumbel noise rank the documents; the top k are
a sample without replacement in proportion to the weights. k is not a fixed number: it is
the count of documents whose weight clears the cut that separates the labelled rows best.

The raw model counts every document. The target model and the cut use at most
``max_labelled`` labelled documents, picked by hash (a documented bound of the fit).

Defined cases: null or empty text has no n-grams, weight 0, and is rejected; labels that
are null or name no document are ignored; with no good or no bad label every document
that has a word is kept; rows repeated with one id and text get one weight and one noise,
hence one decision; a null id draws like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK, SPACES, check_of, mix, staged, text_bytes, word_bounds, word_hashes

#: Classes of bytes: 0 white space, 1 letters, digits and all of UTF-8 beyond ASCII, 2 other.
_KINDS = np.full(256, 2, np.uint8)
_KINDS[[ord(c) for c in SPACES]] = 0
for _from, _to in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KINDS[ord(_from) : ord(_to) + 1] = 1
_KINDS[128:] = 1
_SHAPES = np.zeros(256, np.uint8)
_SHAPES[ord("A") : ord("Z") + 1] = 1


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every n-gram: tokens are runs of word characters or of signs.

    Counted are tokens, pairs of neighbours, and the shape of each token (its kind, whether
    it is upper case, whether it repeats the token before), in buckets of their own.
    """
    starts, ends = word_bounds(data, offsets, _KINDS)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.searchsorted(offsets, starts, "right") - 1
    tokens = word_hashes(data, starts, ends)
    drop = np.uint64(64 - bits)
    same = rows[1:] == rows[:-1]
    pairs = mix(tokens[:-1] * np.uint64(3) + tokens[1:])[same]
    kind = _KINDS[data[starts]].astype(np.uint64)
    upper = (_SHAPES[data[starts]] & _SHAPES[data[ends - 1]] & (ends - starts > 1)).astype(np.uint64)
    again = np.zeros(len(tokens), np.uint64)
    again[1:] = same & (tokens[1:] == tokens[:-1])
    shape = mix(kind * np.uint64(8) + upper * np.uint64(2) + again + np.uint64(1))
    buckets = np.concatenate((tokens >> drop, pairs >> drop, shape >> drop)).astype(np.int64)
    return buckets, np.concatenate((rows, rows[1:][same], rows))


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BLOCK bytes."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, last
        first = last


def bucket_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, n) over all texts: one dense vector in each task, summed by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for first, last in _blocks(data, offsets):
                part = data[offsets[first] : offsets[last]]
                buckets, _ = ngram_buckets(part, offsets[first : last + 1] - offsets[first], bits)
                total += np.bincount(buckets, minlength=1 << bits)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, bits: int) -> np.ndarray:
    """At most 2**bits rows, whatever the corpus."""
    table = counts.toArrow()
    out = np.zeros(1 << bits)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log p(target) - log p(raw) by bucket; the target is smoothed towards the raw model."""
    prior = (raw + 1e-3) / (raw + 1e-3).sum()
    strength = smooth * len(raw)
    p = (target + strength * prior) / (target.sum() + strength)
    return np.log(p / prior)


def weighed(docs: DataFrame, ratio: np.ndarray, bits: int) -> DataFrame:
    """(doc_id, check, n_tokens, log_weight) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)  # 2**bits numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            weight, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, last in _blocks(data, offsets):
                part = data[offsets[first] : offsets[last]]
                buckets, rows = ngram_buckets(part, offsets[first : last + 1] - offsets[first], bits)
                weight[first:last] = np.bincount(rows, model.value[buckets], last - first)
                size[first:last] = np.bincount(rows, minlength=last - first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size), pa.array(weight)], ["doc_id", "check", "n_grams", "log_weight"]
            )

    rows = docs.select("doc_id", check_of().alias("check"), "text")
    return rows.mapInArrow(score, "doc_id long, check long, n_grams long, log_weight double")


def best_cut(good: np.ndarray, bad: np.ndarray, keep: float) -> float:
    """The mean weight that parts the two best while at least ``keep`` of the good stay above it."""
    if not len(good) or not len(bad):
        return -np.inf
    good, bad = np.sort(good), np.sort(bad)
    places = np.unique(np.concatenate((good, bad)))
    above_good = 1 - np.searchsorted(good, places, "left") / len(good)
    below_bad = np.searchsorted(bad, places, "left") / len(bad)
    fair = np.flatnonzero(above_good >= keep)
    best = fair[np.argmax((above_good + below_bad)[fair])]
    return float(places[best] if best == 0 else (places[best] + places[best - 1]) / 2)


def gumbel(seed: str):
    """Standard Gumbel noise that depends on the document and the seed only."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "check"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return -F.log(-F.log(u))


def top_k(scored: DataFrame, k: int, bins: int = 4096) -> DataFrame:
    """``scored`` with ``kept``: among the k largest ``key``, ties by smaller id.

    The k-th key is found by counting keys in ever finer bins; nothing is sorted globally.
    """
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return scored.withColumn("kept", F.lit(False))
    above = 0
    for _ in range(3):
        width = (high - low) / bins
        if width <= 0:
            break
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1))
        counts = dict(scored.where(F.col("key").between(low, high)).groupBy(place.alias("b")).count().collect())
        at = bins - 1
        while at > 0 and above + counts.get(at, 0) < k:
            above += counts.get(at, 0)
            at -= 1
        low, high = low + at * width, (low + (at + 1) * width if at < bins - 1 else high)
        if counts.get(at, 0) <= 1000:
            break
    edge = scored.where(F.col("key").between(low, high)).select("key", "doc_id", "check").distinct()
    last = edge.orderBy(F.desc("key"), F.asc("doc_id"), F.asc("check")).limit(max(1, k - above)).agg(
        F.min("key"), F.max_by("doc_id", F.struct(-F.col("key"), F.coalesce("doc_id", F.lit(-(1 << 63))), "check"))
    ).first()
    over = F.col("key") > F.lit(last[0])
    tied = (F.col("key") == F.lit(last[0])) & (F.coalesce("doc_id", F.lit(-(1 << 63))) <= F.coalesce(F.lit(last[1]).cast("long"), F.lit(-(1 << 63))))
    return scored.withColumn("kept", over | tied)


def resampled(
    docs: DataFrame,
    labels: DataFrame,
    bits: int = 16,
    max_labelled: int = 20_000,
    keep: float = 0.995,
    seed: str = "resample",
) -> DataFrame:
    """(doc_id, check, n_grams, log_weight, key, kept) for every row of ``docs``."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    picked = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labels")
    chosen = docs.select("doc_id", "text").join(picked, "doc_id")
    raw = _vector(bucket_counts(docs, bits), bits)
    target = _vector(bucket_counts(chosen.where("quality = 1 AND toxic = 0"), bits), bits)
    scored = staged(weighed(docs, log_ratio(target, raw), bits), "weights")
    judged = scored.where("n_grams > 0").join(picked.where("toxic = 0"), "doc_id").select("quality", (F.col("log_weight") / F.col("n_grams")).alias("mean"))
    rows = judged.toArrow()  # at most max_labelled ids
    quality, mean = rows.column("quality").to_numpy(), rows.column("mean").to_numpy()
    cut = best_cut(mean[quality == 1], mean[quality == 0], keep)
    # The weight of a document relative to the cut, for its length, plus noise.
    margin = F.col("log_weight") - (F.col("n_grams") * F.lit(cut) if np.isfinite(cut) else F.lit(0.0))
    full = scored.where("n_grams > 0").withColumn("margin", margin).withColumn("key", F.col("margin") + gumbel(seed))
    full = staged(full, "keys")
    k = full.where("margin >= 0").count() if np.isfinite(cut) else full.count()
    kept = top_k(full, k).drop("margin")
    return kept.unionByName(scored.where("n_grams = 0").withColumns({"key": F.lit(None).cast("double"), "kept": F.lit(False)}))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return resampled(docs, labels).select("doc_id", "n_grams", "log_weight", "key", "kept")
