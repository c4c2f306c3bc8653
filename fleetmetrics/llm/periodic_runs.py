"""Operator 13: runs of words that repeat with a period, by an online sparse diagonal DP.

A run is a longest stretch of words with smallest period ``q`` (words ``q`` apart are equal)
that is at least ``max(6, 4 q)`` words long. On the diagonal of lag ``q`` such a stretch is a
series of ``length - q`` matches, so the DP keeps, for every lag that is active, how far its
diagonal has matched: each word, read from left to right, lets the lags of its earlier
occurrences grow by one and ends the others, and a diagonal that ends long enough is a run.

One frequent word would make that quadratic. The recurrence is therefore run once for each
band of lags ``2^k .. 2^(k+1) - 1``, on words of ``2^k`` neighbours: a block that starts at a
multiple of ``2^k`` looks for its earlier occurrences in the band, at most ``2^k`` places. A
stretch of four periods holds at least two such blocks in a row, so no run is missed, and the
matches before the first and behind the last block are added by halving steps. A band costs
as much as the text is long, whatever the words are; there are log2(n / 4) bands. A diagonal
whose lag is a multiple of the period has the ends of the run of that period; the smallest lag
of equal ends stays.

Words are told apart exactly; blocks by a 64-bit hash of their two halves, and every run is
compared word by word before it is given out.

Defined cases: null, empty and blank texts have no words and no runs; texts of any length are
taken whole (memory is 8 bytes for each word and band, one text or ``BATCH_BYTES`` at a time);
repeated rows get the same runs; an empty table gives an empty result; all other columns pass
through, unless they are named ``n_words``, ``runs`` or ``collapsed``, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, mix, sliced

MIN_WORDS, MIN_PERIODS = 6, 4
#: Bytes of text whose words are looked at together.
BATCH_BYTES = 1 << 20
RUN = T.StructType(
    [T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]
)
_NEW = ("n_words", "runs", "collapsed")


def _block_names(words: np.ndarray, bands: int) -> list[np.ndarray]:
    """For each k < ``bands`` a name of the block of ``2^k`` words that starts at each place."""
    names = [mix((words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))]
    for k in range(bands - 1):
        left, half = names[-1], 1 << k
        if len(left) <= half:
            break
        # No product with a fixed base: structured texts cannot make blocks meet.
        names.append(mix(left[:-half] * np.uint64(0xD6E8FEB86659FD93) + mix(left[half:])))
    return names


def _diagonals(names: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lag, first and last block of every diagonal of band ``k`` with two or more blocks in a row."""
    size, name = 1 << k, names[k]
    blocks = np.arange(size, len(name), size)  # the first block has nothing before it
    lags = np.arange(size, 2 * size)
    earlier = blocks[:, None] - lags
    match = (earlier >= 0) & (name[np.maximum(earlier, 0)] == name[blocks][:, None])
    grown = np.zeros((len(blocks) + 1, size), bool)
    grown[1:-1] = match[1:] & match[:-1]  # row m: the lag was active at m - 1 and grows at m
    begins = grown[1:] & ~grown[:-1]  # row m: its first two blocks are m and m + 1
    ends = grown[:-1] & ~grown[1:]
    lag_b, first = np.nonzero(begins.T)
    lag_e, last = np.nonzero(ends.T)
    return lags[lag_b], blocks[first], blocks[last]


def _grown(names: list[np.ndarray], k: int, lag: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Exact first match and end (exclusive) of diagonals known block by block."""
    begin, end = first.copy(), last + (1 << k)
    for j in range(k - 1, -1, -1):
        name, step = names[j], 1 << j
        ahead = np.minimum(end, len(name) - 1)
        end = np.where((end < len(name)) & (name[ahead] == name[ahead - lag]), end + step, end)
        back = begin - step
        safe = np.maximum(back - lag, 0)
        begin = np.where((back >= lag) & (name[np.maximum(back, 0)] == name[safe]), back, begin)
    return begin, end


def find_runs(words: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Runs (start, length, period) of a sequence of word numbers, by start, then period.

    ``longest`` bounds the length of a stretch without a unique word, where that is known.
    """
    most = len(words) if longest is None else longest
    bands = max(0, (most // MIN_PERIODS).bit_length())
    names = _block_names(words, bands)
    found = []
    for k in range(len(names)):
        lag, first, last = _diagonals(names, k)
        if not len(lag):
            continue
        begin, end = _grown(names, k, lag, first, last)
        start, length = begin - lag, end - begin + lag
        long = length >= np.maximum(MIN_WORDS, MIN_PERIODS * lag)
        found.append(np.column_stack([start, length, lag])[long])
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
    runs = runs[fresh]
    true = [np.array_equal(words[s + q : s + n], words[s : s + n - q]) for s, n, q in runs.tolist()]
    runs = runs[np.array(true, bool)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _batch_runs(texts: list[bytes | None]):
    """Words, runs and kept words of some texts, all looked at together."""
    words = [(t or b"").split() for t in texts]  # splits at the six ASCII white-space bytes
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    # Behind every text stands a word of its own, so that nothing matches across texts.
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    sequence = np.empty(starts[-1], np.int64)
    walls = starts[1:] - 1
    inside = np.ones(len(sequence), bool)
    inside[walls] = False
    sequence[inside] = codes
    sequence[walls] = len(flat) + np.arange(len(walls))
    runs = find_runs(sequence, int(sizes.max(initial=0)))
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    local = runs.copy()
    local[:, 0] -= starts[owner]
    # Dropped: all but the first period of each run.
    change = np.zeros(len(sequence) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change[:-1]) > 0
    collapsed = []
    for n, own in enumerate(words):
        gone = dropped[starts[n] : starts[n] + len(own)]
        if gone.any():
            own = [w for w, g in zip(own, gone.tolist()) if not g]
        collapsed.append(b" ".join(own))
    return sizes, local, np.searchsorted(owner, np.arange(len(words) + 1)), collapsed


def periodic_runs(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period) and the text ``collapsed``.

    ``collapsed`` holds the words joined by one space, of each run only the first period.
    """
    kept = [f for f in docs.schema.fields if f.name not in _NEW]
    place = [f.name for f in kept].index(column)
    added = [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("runs", T.ArrayType(RUN, False), False),
        T.StructField("collapsed", T.StringType(), False),
    ]
    names = [f.name for f in (*kept, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in sliced(batch, place, BATCH_BYTES):
                texts = part.column(place).cast(pa.binary()).to_pylist()
                sizes, runs, offsets, collapsed = _batch_runs(texts)
                fields = [pa.array(runs[:, i], pa.int64()) for i in range(3)]
                listed = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                )
                text = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), listed, text], names)

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, T.StructType([*kept, *added]))


def _tiled(docs: DataFrame) -> DataFrame:
    """The contract's texts: of every tenth document, words from ``a`` on repeat with a period."""
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.btrim("text", F.lit(SPACES))
    chosen = (F.pmod(seed, F.lit(10)) == 0) & (F.length(bare) > 0)
    # Each step is a projection of its own: a list used inside a lambda would be made for every word.
    cut = docs.withColumn("words", F.when(chosen, F.split(bare, r"[\x20\x09-\x0D]+")))
    numbered = cut.withColumns({"n": F.size("words"), "g": F.floor(seed / 10)})
    shifted = numbered.withColumn("a", F.pmod("g", "n").cast("int"))
    timed = shifted.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.pmod("g", F.lit(8))))).cast("int"))
    source = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), "p"))),
    )
    text = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(source, " "))
    return timed.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the text of every tenth repeated as its contract says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(_tiled(docs)).drop("text")
    # Longest first, then by start, then by period.
    order = F.transform(
        "runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    )
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("_top", F.array_min(order)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_top.s").alias("start"),
        (-F.col("_top.l")).alias("length"),
        F.col("_top.p").alias("period"),
        F.floor(-1000 * F.col("_top.l") / F.col("_top.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
