"""Helpers the training-data operators share: staging, byte views of text, hashes.

Conventions of all operators
----------------------------
A row of ``documents`` is addressed by ``(doc_id, check)``, ``check`` being the 64-bit
xxhash of the text (null hashes as a constant): rows repeated with the same id and text
are one address and get one answer, rows that share an id but not the text stay apart.
Operators pick the columns they need by name, so further columns may have any name.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words in every operator.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes hashed at a time inside a task; arrays of 8 bytes for each stay small.
BLOCK = 1 << 19


# ---------------------------------------------------------------- staging


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or in local mode a new one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not (context.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-checkpoint-")
        context.setCheckpointDir(named)
        named = context.getCheckpointDir()
    return named.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Inside, an execution's shuffle files go as soon as it ends: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in durable files.

    A lost executor costs its running tasks only. The folder goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_built: dict[str, object] = {}


def built_once(key: str, build):
    """What ``build()`` makes, kept in the Python worker until another key is asked for."""
    if key not in _built:
        _built.clear()
        _built[key] = build()
    return _built[key]


# ---------------------------------------------------------------- columns


def check_of(text: Column | str = "text") -> Column:
    return F.xxhash64(text)


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` in one struct, so that none can clash with those of an operator."""
    return F.struct(*[F.col(f"`{name}`") for name in docs.columns])


def chunked(rows: DataFrame, keys: list[str], member: Column, limit: int) -> DataFrame:
    """Add ``n_chunks`` and ``chunk``: a key of more than ``limit`` rows is split evenly.

    Keys up to the limit have one chunk. The sizes are counted with map-side sums, only
    keys over the limit (at most rows / limit of them) come back by a join, and adaptive
    execution splits the hot side of it.
    """
    sizes = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("n_chunks"))
    )
    joined = rows.join(sizes, keys, "left")
    return joined.withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1))).withColumn(
        "chunk", F.pmod(F.xxhash64(member), F.col("n_chunks")).cast("int")
    )


# ---------------------------------------------------------------- bytes and hashes


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + (1 << 16))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers[0], _powers[1]


class RangeHash:
    """64-bit polynomial hashes of any byte range of one block, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self._down = _power_tables(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and where each row starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``limit`` bytes of a string column; longer rows stay whole."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // limit
    starts = np.flatnonzero(np.append(True, np.diff(part) > 0)).tolist()
    for first, last in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(first, last - first)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None):
    """Starts and ends of words, never across rows.

    ``kinds`` gives each byte value a class, 0 being white space; a word is a longest run
    of one class (by default: of anything but white space).
    """
    kind = (~_IS_SPACE).view(np.uint8)[data] if kinds is None else kinds[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(kind), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    inner = offsets[(offsets > 0) & (offsets < len(kind))]
    edge[inner] = True
    bounds = np.flatnonzero(edge)
    ends = np.append(bounds[1:], len(kind))
    words = kind[bounds] > 0
    return bounds[words], ends[words]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word; bytes are taken in blocks, so memory does not follow the batch."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        block = RangeHash(data[base : ends[last - 1]])
        out[first:last] = block.of(starts[first:last] - base, ends[first:last] - base)
        first = last
    return out
