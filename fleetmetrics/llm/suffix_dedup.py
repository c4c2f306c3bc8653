"""Operator 1: remove passages that a document with a smaller id holds too.

Equal strings of ``LENGTH`` bytes are found by sorting suffixes. Sampled splitters
range-partition suffixes by their leading bytes; each bucket sorts its suffixes locally by
a multikey sort (first by the leading word of 8 bytes, then only what is still tied by the
next key, and so on) and compares neighbours, also with the values at its boundaries.

Not every suffix is sorted. Of every ``LENGTH`` bytes at least one position is an anchor,
chosen by content (the least hash of ``SEED`` bytes among those inside), so equal strings
have equal anchors, and only suffixes at anchors, about one in sixteen, are shuffled. An
anchor carries its leading word, the hash of the rest of its seed, and the hash of its
context: all strings of ``LENGTH`` bytes around the seed. Equal contexts settle all of them
at once. Where seeds agree but contexts differ (at the ends of a shared passage), a second
round sorts the strings around these anchors one by one in the same way.

Suffixes are equal if the leading 8 bytes and a 96-bit hash of what follows are equal; in
the second round, 8 bytes and a 64-bit hash. Before anything is shuffled, each batch keeps
only the smallest document of every context, so a passage that a third of all documents
share is a few rows a batch.

Defined cases: null text is empty; texts shorter than ``LENGTH`` lose nothing; documents
with an equal id never remove from each other, and rows repeated with one id and text are
cut alike; a null id counts as larger than all others, so such rows can lose passages and
cause no loss; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK, RangeHash, check_of, mix, partitions, sliced, staged, text_bytes, whole_row

LENGTH, SEED = 50, 20
#: Seeds inside a string of LENGTH bytes.
SPAN = LENGTH - SEED + 1
#: Bytes needed around a block so that all strings that touch it are whole.
MARGIN = 2 * LENGTH + 8
NO_ID = (1 << 63) - 1
#: Documents whose suffixes are sampled for splitters, and suffixes of each.
SAMPLE, SAMPLE_EACH = 4000, 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- suffixes of a batch


class Suffixes:
    """Keys (lead, tail, rest), row in the batch, position in the text."""

    def __init__(self, lead, tail, rest, row, pos):
        self.keys = [lead, tail, rest]
        self.row, self.pos = row, pos

    def take(self, at) -> Suffixes:
        return Suffixes(*(k[at] for k in self.keys), self.row[at], self.pos[at])

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        both = [np.concatenate([p.keys[i] for p in parts]) for i in range(3)]
        return Suffixes(*both, np.concatenate([p.row for p in parts]), np.concatenate([p.pos for p in parts]))


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    lead = np.zeros(len(at), np.uint64)
    for i in range(8):
        lead = lead << np.uint64(8) | data[at + i]
    return lead


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(from, to, start of the slice, slice with margins) of each block of the batch."""
    for core in range(0, len(data), BLOCK):
        low = max(0, core - MARGIN)
        yield core, min(len(data), core + BLOCK), low, data[low : core + BLOCK + MARGIN]


def anchors(data: np.ndarray, offsets: np.ndarray, with_seeds: bool = False):
    """The suffixes at the anchors of every row that is long enough, and the hashes of their seeds if asked for."""
    seeds = [np.zeros(0, np.uint64)]
    parts = [Suffixes(*(np.zeros(0, t) for t in (np.uint64, np.uint32, np.uint64, np.int64, np.int64)))]
    for core, end, low, part in _blocks(data):
        if len(part) < LENGTH:
            continue
        hashed = RangeHash(part)
        start = np.arange(len(part) - SEED + 1)
        seed = hashed.of(start, start + SEED)
        ends = offsets[(offsets > low) & (offsets < low + len(part))] - low
        across = (ends[:, None] - np.arange(1, SEED)).ravel()
        seed[across[(across >= 0) & (across < len(seed))]] = _NONE  # no seed reaches into the next row
        least = _slide(seed, SPAN, np.minimum)
        # Only strings inside one row choose, so anchors do not depend on the row's neighbours.
        beyond = (ends[:, None] - np.arange(1, LENGTH)).ravel()
        least[beyond[(beyond >= 0) & (beyond < len(least))]] = 0
        padded = np.zeros(len(least) + 2 * (SPAN - 1), np.uint64)
        padded[SPAN - 1 : SPAN - 1 + len(least)] = least
        chosen = np.flatnonzero((_slide(padded, SPAN, np.maximum) == seed) & (seed != _NONE))
        chosen = chosen[(chosen + low >= core) & (chosen + low < end)]
        row = np.searchsorted(offsets, chosen + low, "right") - 1
        long_enough = offsets[row + 1] - offsets[row] >= LENGTH
        chosen, row = chosen[long_enough], row[long_enough]
        left = np.maximum(chosen - (LENGTH - SEED), offsets[row] - low)
        right = np.minimum(chosen + LENGTH, offsets[row + 1] - low)
        tail = (hashed.of(chosen + 8, chosen + SEED) >> np.uint64(32)).astype(np.uint32)
        seeds.append(seed[chosen])
        parts.append(Suffixes(_leads(part, chosen), tail, hashed.of(left, right), row, chosen + low - offsets[row]))
    found = Suffixes.joined(parts)
    return (found, np.concatenate(seeds)) if with_seeds else found


def strings(data: np.ndarray, offsets: np.ndarray, ranges: list[np.ndarray], dull=None) -> Suffixes:
    """The suffixes that start in the given ranges of each row and have LENGTH bytes left.

    ``dull(row, pos)`` may tell starts that can be left out.
    """
    row = np.repeat(np.arange(len(ranges)), [len(r) // 2 for r in ranges])
    flat = np.concatenate([np.asarray(r, np.int64).reshape(-1, 2) for r in ranges]) if len(row) else np.zeros((0, 2), np.int64)
    limit = offsets[row + 1] - offsets[row] - LENGTH + 1
    first, last = np.maximum(flat[:, 0], 0), np.minimum(flat[:, 1], limit)
    count = np.maximum(last - first, 0)
    row, pos = np.repeat(row, count), np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    if dull is not None and len(row):
        keep = ~dull(row, pos)
        row, pos = row[keep], pos[keep]
    at = offsets[row] + pos
    rest = np.zeros(len(at), np.uint64)
    for core, end, low, part in _blocks(data):
        here = (at >= core) & (at < end)
        if here.any():
            rest[here] = RangeHash(part).of(at[here] - low + 8, at[here] - low + LENGTH)
    return Suffixes(_leads(data, at), np.zeros(len(at), np.uint32), rest, row, pos)


def open_strings(data: np.ndarray, offsets: np.ndarray, hits: list, looks: list) -> Suffixes:
    """The strings around the places to look at that the first round leaves open.

    A string with a repeated anchor inside is settled, and a smaller document speaks for it.
    The anchor of least hash inside a string is the same wherever the string stands: if that
    anchor was not told to be looked at, the string is repeated nowhere.
    """
    found, seed = anchors(data, offsets, True)
    place = offsets[found.row] + found.pos
    order = np.argsort(place, kind="stable")
    place, seed = place[order], seed[order]
    flat = lambda lists: np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)])
    row_start = lambda lists: np.repeat(offsets[:-1], [len(x) for x in lists])
    settled = np.isin(place, flat(hits) + row_start(hits))
    asked = np.isin(place, flat(looks) + row_start(looks))

    def dull(row: np.ndarray, pos: np.ndarray) -> np.ndarray:
        at = offsets[row] + pos
        first, last = np.searchsorted(place, at), np.searchsorted(place, at + SPAN)
        least, done, look = np.full(len(at), _NONE), np.zeros(len(at), bool), np.zeros(len(at), bool)
        for step in range(int((last - first).max(initial=0))):
            here = np.flatnonzero(first + step < last)
            i = first[here] + step
            done[here] |= settled[i]
            look[here] = np.where(seed[i] < least[here], asked[i], look[here] | (asked[i] & (seed[i] == least[here])))
            least[here] = np.minimum(least[here], seed[i])
        return done | ~look

    ranges = [_merged(np.asarray(x, np.int64) - (LENGTH - SEED), np.asarray(x, np.int64) + 1) for x in looks]
    return strings(data, offsets, ranges, dull)


# ---------------------------------------------------------------- sorting and dealing


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Sorted order by several keys: each next key sorts only what all keys before it left tied."""
    order = np.argsort(keys[0], kind="stable")
    fresh = np.append(True, np.diff(keys[0][order]) != 0) if len(order) else np.zeros(0, bool)
    for key in keys[1:]:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(fresh)[at]
        some = order[at]
        some = some[np.lexsort((key[some], group))]
        order[at] = some
        fresh[at] |= np.append(True, (np.diff(key[some]) != 0) | (np.diff(group) != 0))
    return order


def _cuts(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """Where sorted keys reach each splitter."""
    out = []
    for splitter in splitters:
        low, high = 0, len(keys[0])
        for key, value in zip(keys, splitter):
            part = key[low:high]
            value = np.asarray(value).astype(key.dtype)
            low, high = low + int(np.searchsorted(part, value, "left")), low + int(np.searchsorted(part, value, "right"))
            if low == high:
                break
        out.append(low)
    return np.array(out, np.int64)


def _pack(values: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: Suffixes on their way to a bucket (kind 0), or places already known as repeated (kind 1).
DEALT = "bucket int, kind int, " + ", ".join(f"{c} binary" for c in ("lead", "tail", "rest", "doc", "check", "pos"))
_NAMES = [c.split()[0] for c in DEALT.split(", ")]
_TYPES = [np.uint64, np.uint32, np.uint64, np.int64, np.int64, np.int64]
#: Places told to documents: flag 0 repeated, 1 to be looked at string by string.
TOLD = "part int, doc binary, check binary, pos binary, flag binary"


def _batch(rows: list[tuple], names: list[str], plain: int) -> pa.RecordBatch:
    columns = list(zip(*rows))
    kinds = [pa.int32()] * plain + [pa.binary()] * (len(names) - plain)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _deal(found: Suffixes, ids: np.ndarray, checks: np.ndarray, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sort a batch, settle what it can settle itself, and send the rest to buckets."""
    if not len(found.row):
        return
    doc = ids[found.row]
    order = multikey_order([*found.keys, doc])
    found, doc = found.take(order), doc[order]
    fresh = np.append(True, np.any([np.diff(k) != 0 for k in found.keys], axis=0))
    least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    later = doc > least
    rows = []
    buckets = len(splitters) + 1
    if later.any():
        some = np.flatnonzero(later)
        arrays = (doc[some], checks[found.row[some]], found.pos[some])
        rows.append((int(some[0]) % buckets, 1, b"", b"", b"", *map(_pack, arrays)))
    first = np.flatnonzero(~later)
    found, doc = found.take(first), doc[first]
    cuts = np.concatenate(([0], _cuts(found.keys, splitters), [len(doc)]))
    for bucket in np.flatnonzero(np.diff(cuts)).tolist():
        at = slice(cuts[bucket], cuts[bucket + 1])
        arrays = (*(k[at] for k in found.keys), doc[at], checks[found.row[at]], found.pos[at])
        rows.append((bucket, 0, *map(_pack, arrays)))
    yield _batch(rows, _NAMES, 2)


def _tell(doc, check, pos, flag, parts: int) -> Iterator[pa.RecordBatch]:
    if not len(doc):
        return
    part = (mix(doc.view(np.uint64) ^ mix(check.view(np.uint64))) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((pos, doc, part))
    part, arrays = part[order], [x[order] for x in (doc, check, pos, flag)]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    rows = [(int(part[a]), *(_pack(x[a:b]) for x in arrays)) for a, b in zip(cuts, cuts[1:])]
    yield _batch(rows, [c.split()[0] for c in TOLD.split(", ")], 1)


def _sort_buckets(splitters: np.ndarray, parts: int, seeds: bool) -> Callable:
    """Task code over dealt rows sorted by bucket: sort each bucket, compare, tell documents."""
    # A seed that a splitter cuts has neighbours in another bucket: always looked at closely.
    edge = {(int(a), int(b)) for a, b, _ in splitters}
    edge_leads = np.unique(np.array([a for a, _ in edge], np.uint64))

    def settle(blobs: list[tuple]):
        lead, tail, rest, doc, check, pos = (
            np.concatenate([_unpack(b[i], kind) for b in blobs]) for i, kind in enumerate(_TYPES)
        )
        order = multikey_order([lead, tail, rest, doc])
        lead, tail, rest, doc, check, pos = (x[order] for x in (lead, tail, rest, doc, check, pos))
        new_seed = np.append(True, (np.diff(lead) != 0) | (np.diff(tail) != 0))
        new_rest = new_seed | np.append(True, np.diff(rest) != 0)
        least = doc[np.flatnonzero(new_rest)][np.cumsum(new_rest) - 1]
        repeated = doc > least
        look = np.zeros(len(doc), bool)
        if seeds:
            at = np.flatnonzero(new_seed)
            group = np.cumsum(new_seed) - 1
            mixed = (np.add.reduceat(new_rest.astype(np.int64), at) > 1) & (
                np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
            )
            for i in np.flatnonzero(np.isin(lead[at], edge_leads)).tolist():
                mixed[i] |= (int(lead[at[i]]), int(tail[at[i]])) in edge
            look = mixed[group] & ~repeated
        some = np.flatnonzero(repeated | look)
        return doc[some], check[some], pos[some], look[some].astype(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, told, held = None, [], [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[1] == 1:
                    doc, check, pos = (_unpack(x, np.int64) for x in row[5:])
                    yield from _tell(doc, check, pos, np.zeros(len(doc), np.uint8), parts)
                    continue
                if row[0] != bucket and blobs:
                    told.append(settle(blobs))
                    held += len(told[-1][0])
                    blobs = []
                    if held > 1 << 20:
                        yield from _tell(*map(np.concatenate, zip(*told)), parts)
                        told, held = [], 0
                bucket = row[0]
                blobs.append(row[2:])
        if blobs:
            told.append(settle(blobs))
        if told:
            yield from _tell(*map(np.concatenate, zip(*told)), parts)

    return run


def _merged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sorted ranges without overlap, flat."""
    if not len(start):
        return np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return np.column_stack((start[first], reach[np.append(first[1:] - 1, len(start) - 1)])).ravel()


def _collate(before: int, after: int) -> Callable:
    """Task code over told rows sorted by part: what each document is told.

    ``spans`` are the ranges that repeated places cover, [p - before, p + after) each; ``hits``
    are these places and ``looks`` the places to look at, in ascending order.
    """

    def flush(blobs: list[tuple]) -> pa.RecordBatch:
        doc, check, pos = (np.concatenate([_unpack(b[i], np.int64) for b in blobs]) for i in range(3))
        flag = np.concatenate([_unpack(b[3], np.uint8) for b in blobs])
        order = np.lexsort((pos, check, doc))
        doc, check, pos, flag = doc[order], check[order], pos[order], flag[order]
        cuts = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (np.diff(check) != 0)))
        spans, hits, looks = [], [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(doc))):
            p, look = pos[a:b], flag[a:b] == 1
            spans.append(_merged(np.maximum(p[~look] - before, 0), p[~look] + after))
            hits.append(p[~look])
            looks.append(p[look])
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[cuts]), pa.array(check[cuts]), *(pa.array(x, pa.list_(pa.int64())) for x in (spans, hits, looks))],
            ["doc", "check", "spans", "hits", "looks"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[0] != part and blobs:
                    yield flush(blobs)
                    blobs = []
                part = row[0]
                blobs.append(row[1:])
        if blobs:
            yield flush(blobs)

    return run


# ---------------------------------------------------------------- jobs


def _sampled_splitters(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters for anchors and for strings, from a bounded sample of suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            found = anchors(data, offsets)
            if not len(found.row):
                continue
            near = strings(data, offsets, [np.array([0, 1 << 40]) if i % 16 == 0 else np.zeros(0, np.int64) for i in range(batch.num_rows)])
            for kind, some in ((0, found), (1, near)):
                every = np.random.default_rng(len(some.row)).permutation(len(some.row))[: SAMPLE_EACH * batch.num_rows]
                few = some.take(np.sort(every))
                columns = [pa.array(np.full(len(few.row), kind, np.int32)), *(pa.array(k.astype(np.uint64).view(np.int64)) for k in few.keys)]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "lead", "tail", "rest"])

    total = docs.count()
    sample = docs.select("text").sample(fraction=min(1.0, SAMPLE / max(total, 1)), seed=1)
    table = sample.mapInArrow(run, "kind int, lead long, tail long, rest long").toArrow()
    out = []
    for kind in (0, 1):
        mine = table.filter(pa.compute.equal(table.column("kind"), kind))
        keys = np.column_stack([mine.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("lead", "tail", "rest")])
        keys = np.unique(keys, axis=0)
        at = np.linspace(0, len(keys), buckets + 1)[1:-1].astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        out.append(np.unique(keys[at], axis=0) if len(keys) else keys.reshape(0, 3))
    return out[0], out[1]


def _places(dealt: DataFrame, splitters: np.ndarray, seeds: bool, name: str) -> DataFrame:
    spark = dealt.sparkSession
    parts = partitions(spark)
    sorted_ = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    told = sorted_.mapInArrow(_sort_buckets(splitters, parts, seeds), TOLD)
    reach = (LENGTH - SEED, LENGTH) if seeds else (0, LENGTH)
    collated = told.repartition(parts, "part").sortWithinPartitions("part")
    return staged(collated.mapInArrow(_collate(*reach), "doc long, check long, spans array<long>, hits array<long>, looks array<long>"), name)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, check, spans): byte ranges, flat and not merged across the rounds, to be removed.

    ``doc`` is the id, or the largest long for null.
    """
    spark = docs.sparkSession
    buckets = 4 * partitions(spark)
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), check_of().alias("check"), "text")
    by_anchor, by_string = _sampled_splitters(docs, buckets)

    def deal_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 2):
                ids, checks = (batch.column(i).to_numpy() for i in (0, 1))
                yield from _deal(anchors(*text_bytes(batch.column(2))), ids, checks, by_anchor)

    def deal_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ids, checks = (batch.column(i).to_numpy() for i in (0, 1))
                hits, looks = (batch.column(i).to_numpy(zero_copy_only=False).tolist() for i in (3, 4))
                found = open_strings(*text_bytes(batch.column(2)), hits, looks)
                yield from _deal(found, ids, checks, by_string)

    first = _places(keyed.mapInArrow(deal_anchors, DEALT), by_anchor, True, "anchors")
    asked = first.where(F.size("looks") > 0).select("doc", "check", "hits", "looks")
    looked = keyed.join(asked, ["doc", "check"]).select("doc", "check", "text", "hits", "looks")
    second = _places(looked.mapInArrow(deal_strings, DEALT), by_string, False, "strings")
    both = first.select("doc", "check", "spans").unionByName(second.select("doc", "check", "spans"))
    return both.where(F.size("spans") > 0).groupBy("doc", "check").agg(F.flatten(F.collect_list("spans")).alias("spans"))


_CUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


@F.pandas_udf(_CUT)
def _cut_out(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for value, ranges in zip(text, spans):
        data = (value or "").encode()
        if ranges is None or not len(ranges):
            rows.append((len(data), 0, 0, data))
            continue
        pairs = np.asarray(ranges, np.int64).reshape(-1, 2)
        flat = _merged(pairs[:, 0], np.minimum(pairs[:, 1], len(data))).reshape(-1, 2).tolist()
        kept, at = [], 0
        for a, b in flat:
            kept.append(data[at:a])
            at = b
        kept.append(data[at:])
        rows.append((len(data), sum(b - a for a, b in flat), len(flat), b"".join(kept)))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with ``cut``: n_bytes, n_removed, n_spans and the bytes kept; a column of that name is replaced."""
    passed = docs.drop("cut")
    keyed = passed.select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), check_of().alias("check"), whole_row(passed).alias("row")
    )
    joined = keyed.join(spans.select("doc", "check", "spans"), ["doc", "check"], "left")
    return joined.select("row.*", _cut_out("row.text", "spans").alias("cut"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = without_repeats(docs, repeated_spans(docs))
    return done.select(
        "doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256")
    )
