"""Operator 6: language identification by prediction by partial matching.

Every language has a tree of byte contexts up to ``order`` bytes long. The cost of a byte
in a context is that of its count there, or of an escape to the next shorter context
(escape method C), down to equal odds for all bytes. Statistics are frozen after training,
so the exact code length of a text under a language is a sum over its bytes, looked up in a
table that holds the finished costs of all languages side by side. The language with the
shortest code wins.

Training uses at most ``per_lang`` whole texts of each language, picked by hash, and keeps
the ``contexts`` most frequent contexts (documented bounds of the fit).

Defined cases: null text and text without a letter give ``und`` with score 0, as does a
corpus without a known language; ties go to the smaller language name; rows repeated with
one text get one answer; a null id is never used for training and not held out; an empty
table gives an empty result; columns beside ``doc_id``, ``text``, ``lang`` are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import built_once, check_of, text_bytes

#: Costs looked up at a time.
STEP = 1 << 19
_LETTER = regex.compile(r"\p{L}")


def _windows(part: np.ndarray, bounds: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each context length: (length, packed context, byte) of every place that has so long a context."""
    wide = part.astype(np.int64)
    place = np.arange(len(part)) - np.repeat(bounds[:-1], np.diff(bounds))
    context = np.zeros(len(part), np.int64)
    for length in range(order + 1):
        if length:
            context[length:] |= wide[:-length] << (8 * (length - 1))
        whole = place >= length
        yield length, context[whole], part[whole]


def context_counts(train: DataFrame, order: int) -> DataFrame:
    """(lang, length, context, byte, n); contexts are packed bytes, the nearest lowest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                rows = batch.filter(pa.array(langs == lang))
                data, offsets = text_bytes(rows.column(1))
                for first in range(0, len(offsets) - 1, 64):
                    cut = offsets[first : first + 65]
                    for length, context, byte in _windows(data[cut[0] : cut[-1]], cut - cut[0], order):
                        keys, n = np.unique(context << 8 | byte, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), length, np.int32)), pa.array(keys), pa.array(n)],
                            ["lang", "length", "key", "n"],
                        )

    rows = train.select("lang", "text").mapInArrow(count, "lang string, length int, key long, n long")
    return rows.groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The trees of all languages as one table: costs[context, byte, language] in bits."""

    def __init__(self, langs: list[str], order: int, table: dict[str, np.ndarray], contexts: int):
        self.langs, self.order = langs, order
        lang, length, key, n = (table[k] for k in ("lang", "length", "key", "n"))
        known = np.unique(key & 0xFF)
        self.classes = np.zeros(256, np.int64)  # class 0: bytes never seen in training
        self.classes[known] = np.arange(1, len(known) + 1)
        self.width = len(known) + 1
        byte = self.classes[key & 0xFF]
        context = np.zeros(len(key), np.int64)  # contexts in base ``width`` instead of bytes
        for i in range(order):
            digit = self.classes[(key >> (8 * (i + 1))) & 0xFF]
            context += np.where(i < length, digit * self.width**i, 0)
        kept: list[np.ndarray] = []
        for size in range(order + 1):
            at = length == size
            names, where = np.unique(context[at], return_inverse=True)
            often = np.bincount(where, n[at], len(names))
            if size:  # a context needs its parent, which drops the farthest byte
                names, often = names[of := np.isin(names % self.width ** (size - 1), kept[-1])], often[of]
            kept.append(np.sort(names[np.argsort(-often, kind="stable")[:contexts]]))
        # Rows of the table: length by length; the parent row of each context.
        starts = np.cumsum([0, *map(len, kept)])
        costs = np.empty((starts[-1], self.width, len(langs)), np.float32)
        level = np.full((1, self.width, len(langs)), np.log2(256), np.float64)
        parent = np.zeros(1, np.int64)
        self.row_of = np.zeros(1, np.int32)
        for size in range(order + 1):
            count = np.zeros((len(kept[size]), self.width, len(langs)))
            at = (length == size) & np.isin(context, kept[size])
            np.add.at(count, (np.searchsorted(kept[size], context[at]), byte[at], lang[at]), n[at])
            if size:
                parent = np.searchsorted(kept[size - 1], kept[size] % self.width ** (size - 1))
            total, distinct = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = np.log2(total + distinct) - np.log2(count)
                escape = np.where(total > 0, np.log2(total + distinct) - np.log2(distinct), 0.0)
            level = np.where(count > 0, own, escape + level[parent])
            costs[starts[size] : starts[size + 1]] = level
            # the row of every possible context of this length: its own, or its parent's
            rows = np.tile(self.row_of, self.width if size else 1)
            rows[kept[size]] = starts[size] + np.arange(len(kept[size]))
            self.row_of = rows.astype(np.int32)
        self.costs = costs.reshape(-1, len(langs))

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text (row) under every language (column)."""
        bits = np.zeros((len(offsets) - 1, len(self.langs)))
        for first in range(0, len(data), STEP):
            low = max(0, first - self.order)
            part = self.classes[data[low : first + STEP]]
            context = np.zeros(len(part), np.int64)
            for i in range(1, self.order + 1):
                context[i:] += part[:-i] * self.width ** (i - 1)
            context, byte = context[first - low :], part[first - low :]
            cost = self.costs[self.row_of[context].astype(np.int64) * self.width + byte]
            a = int(np.searchsorted(offsets, first, "right")) - 1
            b = int(np.searchsorted(offsets, first + len(byte), "left"))
            cuts = np.clip(offsets[a:b] - first, 0, None)
            rows = np.flatnonzero(np.diff(np.append(cuts, len(byte))) > 0)
            bits[a + rows] += np.add.reduceat(cost, cuts[rows], axis=0, dtype=np.float64)
        return bits


def trained(train: DataFrame, order: int = 3, per_lang: int = 300, contexts: int = 6000) -> tuple[list[str], dict[str, np.ndarray]]:
    """The languages and the frozen counts of their sample."""
    first = Window.partitionBy("lang").orderBy(check_of(), "doc_id")
    sample = train.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_lang).select("lang", "text")
    table = context_counts(sample, order).toArrow()  # at most the distinct n-grams of the sample
    langs = sorted(set(table.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(langs)}
    counts = {k: table.column(k).to_numpy().astype(np.int64) for k in ("length", "key", "n")}
    counts["lang"] = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
    return langs, counts


def predicted(docs: DataFrame, langs: list[str], counts: dict[str, np.ndarray], order: int = 3, contexts: int = 6000) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte): score is the winner's share of all likelihoods."""
    model = docs.sparkSession.sparkContext.broadcast((langs, order, counts, contexts))  # sample-sized
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = built_once(key, lambda: ContextTrees(*model.value)) if langs else None
        for batch in batches:
            lettered = np.array([t.is_valid and _LETTER.search(t.as_py()) is not None for t in batch.column(1)], bool)
            name, score, rate = ["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if trees is not None and lettered.any():
                data, offsets = text_bytes(batch.column(1))
                bits = trees.code_lengths(data, offsets)
                best = bits.argmin(1)
                least = bits.min(1, keepdims=True)
                share = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1)
                score = np.where(lettered, share, 0.0)
                rate = np.where(lettered, least[:, 0] / np.maximum(np.diff(offsets), 1), 0.0)
                name = [langs[b] if ok else "und" for b, ok in zip(best, lettered)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(name, pa.string()), pa.array(score), pa.array(rate)],
                ["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def held_out():
    """Documents no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    told = predicted(docs, *trained(train))
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")
