"""Operator 2: drop lines that many documents repeat.

Range-partitioned line hashes with a secondary sort by document (largest first) and
position are streamed once; a line's first occurrence in that order is the one that
stays. The result is a compressed bitmap of kept lines for each document that loses
some, never text.

Defined cases: a null or empty text is one empty line and loses nothing; documents with a
null id count together as one document smaller than all others; rows repeated with one id
count as one document, and all its occurrences stay in the document that keeps the line;
an empty table gives an empty result; columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, check_of, partitions, staged, whole_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)
#: What a streamed row says: drop the line; decide it with the neighbours; evidence only.
DROP, OPEN, SEEN = 0, 1, 2


def line_key(line: Column) -> Column:
    """The line without white space around it, ASCII letters lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line long enough to count: 128-bit key hash, document, position."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    parts = docs.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
        check_of().alias("check"),
        lines.alias("lines"),
    )
    parts = parts.select("doc", "check", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    keyed = parts.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc", "check", "n_lines", "pos"
    )


class _Stream:
    """State of one sorted partition: the open key, its largest documents, rows not decided."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key: tuple[int, int] | None = None
        self.tops: list[int] = []
        self.opening = True
        self.held: list[np.ndarray] = []
        self.out: list[tuple[int, np.ndarray]] = []

    def part(self, rows: np.ndarray) -> None:
        """More rows (h1, h2, doc, check, n_lines, pos) of the open key, documents descending."""
        if len(self.tops) < self.min_docs:
            docs = rows[:, 2]
            for doc in docs[np.flatnonzero(np.diff(docs, prepend=~docs[0]))][: self.min_docs + 1].tolist():
                if len(self.tops) < self.min_docs and doc not in self.tops:
                    self.tops.append(doc)
        if self.opening:
            self.out.append((OPEN, rows))
        elif len(self.tops) < self.min_docs:
            self.held.append(rows)
        else:
            for piece in (*self.held, rows):
                self.out.append((DROP, piece[piece[:, 2] != self.tops[0]]))
            self.held = []

    def feed(self, rows: np.ndarray) -> None:
        cut = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
        starts = np.concatenate(([0], cut, [len(rows)]))
        # Keys that begin and end in this batch need no state: all of them at once.
        lone = slice(1, len(starts) - 2)
        self._switch(rows[0])
        self.part(rows[: starts[1]])
        if len(starts) > 2:
            self._whole(rows, starts[lone], starts[2:-1])
            self._switch(rows[starts[-2]])
            self.part(rows[starts[-2] :])

    def _whole(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if not len(starts):
            return
        span = rows[starts[0] : ends[-1]]
        at = starts - starts[0]
        new_doc = np.append(True, np.diff(span[:, 2]) != 0)
        new_doc[at] = True
        n_docs = np.add.reduceat(new_doc.astype(np.int64), at)
        length = ends - starts
        drop = np.repeat(n_docs >= self.min_docs, length) & (span[:, 2] != np.repeat(span[at, 2], length))
        self.out.append((DROP, span[drop]))

    def _switch(self, row: np.ndarray) -> None:
        key = (int(row[0]), int(row[1]))
        if key != self.key:
            self.opening = self.key is None
            self.key, self.tops, self.held = key, [], []

    def end(self) -> None:
        """The last key may go on in the next partition."""
        if self.key is None or self.opening:
            return
        for piece in self.held:
            self.out.append((OPEN, piece))
        seen = np.zeros((len(self.tops), 6), np.int64)
        seen[:, 0], seen[:, 1], seen[:, 2] = self.key[0], self.key[1], self.tops
        self.out.append((SEEN, seen))

    def flush(self) -> Iterator[pa.RecordBatch]:
        for kind, rows in self.out:
            if len(rows):
                columns = [pa.array(np.full(len(rows), kind, np.int32)), *(pa.array(rows[:, i]) for i in range(6))]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "h1", "h2", "doc", "check", "n_lines", "pos"])
        self.out = []


def repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Lines to drop: (doc, check, n_lines, pos), doc being the id or the smallest long for null."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Stream(min_docs)
        for batch in batches:
            if batch.num_rows:
                state.feed(np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]))
                yield from state.flush()
        state.end()
        yield from state.flush()

    spark = docs.sparkSession
    longs = occurrences(docs, min_chars).select(
        "h1", "h2", "doc", "check", F.col("n_lines").cast("long").alias("n_lines"), F.col("pos").cast("long").alias("pos")
    )
    order = [F.asc("h1"), F.asc("h2"), F.desc("doc"), F.asc("check"), F.asc("pos")]
    ranged = longs.repartitionByRange(partitions(spark), *order[:3]).sortWithinPartitions(*order)
    told = staged(
        ranged.mapInArrow(stream, "kind int, h1 long, h2 long, doc long, check long, n_lines long, pos long"), "lines"
    )
    # Undecided are the first and last key of each partition only, so this side stays at two
    # keys a partition, whatever the number of rows that hold them.
    edges = told.where(F.col("kind") != DROP)
    decided = (
        edges.groupBy("h1", "h2")
        .agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
    )
    late = edges.where(F.col("kind") == OPEN).join(F.broadcast(decided), ["h1", "h2"]).where("doc <> keeper")
    columns = ["doc", "check", "n_lines", "pos"]
    return told.where(F.col("kind") == DROP).select(*columns).unionByName(late.select(*columns))


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def one(n: int, gone: np.ndarray) -> bytes:
        keep = np.ones(n, np.uint8)
        keep[np.asarray(gone, np.int64)] = 0
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([one(n, gone) for n, gone in zip(n_lines, dropped)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(value: str | None, packed: bytes | None) -> str | None:
        if packed is None:
            return value
        lines = (value or "").split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(lines))
        return "\n".join(lines[i] for i in np.flatnonzero(keep))

    return pd.Series([one(*pair) for pair in zip(text, bitmap)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """For each document that loses lines: (doc, check, n_lines, n_dropped, keep).

    ``keep`` is a zlib-compressed bit string, the first line in the highest bit of the first
    byte. Documents without a row keep everything.
    """
    gone = repeated_lines(docs, min_docs, min_chars)
    each = gone.groupBy("doc", "check").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return each.select("doc", "check", "n_lines", F.size("gone").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the text of kept lines in ``_kept`` and the count of the others in ``_n_dropped``.

    Columns of ``docs`` with these two names are replaced, all others pass through.
    """
    passed = docs.drop("_kept", "_n_dropped")
    keyed = passed.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), check_of().alias("check"), whole_row(passed).alias("row")
    )
    joined = keyed.join(bitmaps.select("doc", "check", "n_dropped", "keep"), ["doc", "check"], "left")
    return joined.select(
        "row.*", _kept_text("row.text", "keep").alias("_kept"), F.coalesce("n_dropped", F.lit(0)).alias("_n_dropped")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    applied = apply_bitmaps(docs, keep_bitmaps(docs))
    return applied.select(
        "doc_id",
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
        F.col("_n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("_kept", F.lit("")), 256).alias("kept_sha256"),
    )


OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, o.keeper IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
