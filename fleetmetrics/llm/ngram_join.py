"""Operator 3: all pairs of documents with similar word n-grams, by a chosen-path join.

A document is its set of five-word shingles. Texts with equal sets are one class of copies.
Each run picks one shared token of every set at random (the smallest shingle under a random
order) and splits the sets by it: two sets of similarity s meet with probability s, and
stay together in further splits with a probability that is known too, so the number of
runs follows from the target recall. Buckets that are still large are split again, on further sampled tokens,
or, if most of a bucket resembles one member, that member takes its likes out and only the
rest is compared. Small buckets are compared by brute force, on sketches.

Sketches only propose: sets that hang together are brought into one place (in blocks, if
they are many) and every pair of them is counted exactly, so links are exact and each is
counted once. No list of pairs leaves a task.

Defined cases: texts with one to four words have one shingle, all their words; null texts
and texts without a word resemble nothing and are their own class; rows with one id count
as documents of their own; a class whose ids are all null has a null class_id; an empty
table gives an empty result; columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_of, mix, staged, text_bytes, whole_row, word_bounds, word_hashes
from .graph import components

SHINGLE = 5
#: Coordinates of a sketch, one byte each.
SKETCH = 128
#: Sets are brought together from this share of equal coordinates on: 5 standard deviations
#: below a similarity of 0.8.
MARGIN = 5.0
#: Members of a bucket compared by brute force, and depth of further splits.
LEAF, DEPTH = 256, 4
#: Further tokens a large bucket is split on; few, as the next run gives a pair another chance.
WAYS = 3
#: Bits that tell which texts may be wanted for the exact counts (16 MB).
BITS = 1 << 27

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    starts, ends = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets[:-1])
    last = np.append(first[1:], len(words))
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for i in range(1, size):
            rolled = rolled * _STEP + words[i : len(words) - size + 1 + i]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                whole = whole * _STEP + words[i : i + 1]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_ORDERS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each non-empty set under every random order."""
    out = np.empty((len(sets), SKETCH), np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) < 1 << 17):
            total += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        cuts = np.cumsum([0, *map(len, sets[first : last - 1])])
        for j, factor in enumerate(_ORDERS):
            out[first:last, j] = np.minimum.reduceat(flat * factor, cuts)
        first = last
    return out


def described(docs: DataFrame, runs: int) -> DataFrame:
    """(doc_id, check, print, n, sketch, tokens) of every row; print is null for an empty set."""
    kind = "doc_id long, check long, print binary, n long, sketch binary, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sets = shingle_sets(*text_bytes(batch.column(2)))
                full = [i for i, s in enumerate(sets) if len(s)]
                prints, sketches, tokens = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    least = min_hashes([sets[i] for i in full])
                    small = (mix(least) >> np.uint64(56)).astype(np.uint8)
                    for row, i in enumerate(full):
                        two = np.array([mix(sets[i]).sum(), mix(sets[i] ^ _STEP).sum()], np.uint64)
                        prints[i], sketches[i] = two.tobytes(), small[row].tobytes()
                        tokens[i] = least[row, :runs].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(prints, pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sketches, pa.binary()),
                        pa.array(tokens, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "check", "print", "n", "sketch", "tokens"],
                )

    return docs.select("doc_id", check_of().alias("check"), "text").mapInArrow(run, kind)


# ---------------------------------------------------------------- buckets


class Bucket:
    """Sets of one bucket; ``join`` links those whose sketches agree in ``need`` places."""

    def __init__(self, sketches: np.ndarray, need: int):
        self.sketches, self.need = sketches, need
        self.parent = list(range(len(sketches)))
        self.rng = np.random.default_rng(len(sketches))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def alike(self, one: int, among: np.ndarray) -> np.ndarray:
        return among[(self.sketches[among] == self.sketches[one]).sum(1) >= self.need]

    def brute(self, some: np.ndarray, among: np.ndarray) -> None:
        """Link each of ``some`` with its likes in ``among``, one of each known group."""
        for i in some.tolist():
            for j in self.alike(i, among).tolist():
                self.join(i, j)

    def split(self, members: np.ndarray, depth: int = 0) -> None:
        if len(members) < 2:
            return
        if len(members) <= LEAF or depth == DEPTH:
            for at in range(len(members) - 1):
                self.brute(members[at : at + 1], members[at + 1 :])
            return
        pivot = int(self.rng.choice(members))
        star = self.alike(pivot, members)
        if len(star) * 2 > len(members):
            for j in star.tolist():
                self.join(pivot, j)
            rest = np.setdiff1d(members, star)
            # Likes of the pivot are linked already; one of them is enough for any of the rest.
            for i in rest.tolist():
                for j in self.alike(i, star)[:1].tolist():
                    self.join(i, j)
            self.split(rest, depth + 1)
            return
        for place in self.rng.choice(SKETCH, WAYS, replace=False).tolist():
            value = self.sketches[members, place]
            order = np.argsort(value, kind="stable")
            for part in np.split(members[order], np.flatnonzero(np.diff(value[order])) + 1):
                self.split(part, depth + 1)


def _bucket_links(need: int):
    """Task code over rows (run, token, a, b, print, sketch) sorted by the first four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (prints, sketches) in _groups(batches, 4):
            if len(prints) == 1:
                continue
            bucket = Bucket(np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH), need)
            bucket.split(np.arange(len(prints)))
            links = [(prints[i], prints[r]) for i in range(len(prints)) if (r := bucket.root(i)) != i]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[list]]]:
    """The first ``keys`` columns (of type long) and the columns after them, for each run of equal keys."""
    key, rows = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        values = [batch.column(i).to_pylist() for i in range(keys, batch.num_columns)]
        edges = np.flatnonzero((np.diff(names, axis=0) != 0).any(1)) + 1
        for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(names)]):
            if key is None or (names[x] != key).any():
                if rows:
                    yield key, rows
                key, rows = names[x], [[] for _ in values]
            for into, column in zip(rows, values):
                into += column[x:y]
    if rows:
        yield key, rows


def in_chunk_pairs(rows: DataFrame, sizes: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """``rows`` with (a, b): once (0, 0) for a key of one chunk, else one row for each pair of
    chunks its own belongs to, so that any two members of a key meet in some (a, b).

    ``sizes`` has n_chunks of the keys that need more than one.
    """
    joined = rows.join(sizes, keys, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(1)).cast("long"))
    own = joined.withColumn("own", F.pmod(F.xxhash64(member), F.col("n_chunks")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    return other.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "n_chunks")


def proposed(sets: DataFrame, similarity: float, chunk: int) -> DataFrame:
    """Links (a, b) between prints whose sets may be similar: a forest of each bucket."""
    need = math.floor(SKETCH * similarity - MARGIN * math.sqrt(SKETCH * similarity * (1 - similarity)))
    rows = sets.select("print", "sketch", F.posexplode("tokens").alias("run", "token")).withColumn("run", F.col("run").cast("long"))
    counts = rows.groupBy("run", "token").agg(F.count("*").alias("n"))
    sizes = counts.where(F.col("n") > chunk).select("run", "token", F.ceil(F.col("n") / chunk).alias("n_chunks"))
    dealt = in_chunk_pairs(rows, sizes, ["run", "token"], F.col("print")).select("run", "token", "a", "b", "print", "sketch")
    keys = ["run", "token", "a", "b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_bucket_links(need), "a binary, b binary")


# ---------------------------------------------------------------- exact counts


def overlaps(sets: list[np.ndarray], rare: int = 8) -> np.ndarray:
    """Sizes of all pairwise intersections: rare tokens by pairs, frequent ones by products."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    df = np.bincount(token)
    order = np.argsort(token, kind="stable")
    owner = owner[order]  # owners of token 0, then of token 1, ...
    first = np.concatenate(([0], np.cumsum(df)))[:-1]
    out = np.zeros((n, n), np.float32)
    flat = np.zeros(n * n, np.int64)
    for d in range(2, min(rare, n) + 1):
        at = first[df == d]
        if len(at):
            held = owner[at[:, None] + np.arange(d)]
            for i in range(d):
                for j in range(d):
                    if i != j:
                        flat += np.bincount(held[:, i] * n + held[:, j], minlength=n * n)
    out += flat.reshape(n, n)
    often = np.flatnonzero(df > rare)
    for begin in range(0, len(often), 2048):
        some = often[begin : begin + 2048]
        dense = np.zeros((n, len(some)), np.float32)
        for column, t in enumerate(some.tolist()):
            dense[owner[first[t] : first[t] + df[t]], column] = 1
        out += dense @ dense.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _exact_links(similarity: float):
    """Task code over rows (label, a, b, own, print, copies, set) sorted by the first three.

    Gives (print, root, links, texts): similar documents and similar texts of each set within
    the block, and the root of its group there. A block of two chunks (a <> b) counts only
    pairs between them, none if one of the two has no member; every pair of sets counts in one block.
    """
    top = round(similarity * 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), (own, prints, copies, packed) in _groups(batches, 3):
            keep = list(dict(zip(prints, range(len(prints)))).values())  # repeated rows are one text
            side = np.array([own[i] for i in keep])
            if len(keep) < 2 or a != b and (side == side[0]).all():
                continue
            sets = [np.frombuffer(packed[i], np.uint64) for i in keep]
            size = np.array([len(s) for s in sets], np.int64)
            shared = overlaps(sets).astype(np.int64)
            similar = 10_000 * shared >= top * (size[:, None] + size[None, :] - shared)
            if a != b:
                similar &= side[:, None] != side[None, :]
            np.fill_diagonal(similar, False)
            weight = np.array([copies[i] for i in keep], np.int64)
            root = np.arange(len(keep))
            while True:  # smallest member reachable within the block
                near = np.where(similar, root[None, :], len(keep)).min(1)
                after = np.minimum(root, near)
                after = after[after]
                if (after == root).all():
                    break
                root = after
            some = np.flatnonzero(similar.any(1))
            if len(some):
                name = [prints[i] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name[i] for i in some], pa.binary()),
                        pa.array([name[root[i]] for i in some], pa.binary()),
                        pa.array((similar @ weight)[some]),
                        pa.array(similar.sum(1)[some]),
                    ],
                    ["print", "root", "links", "texts"],
                )

    return run


def wanted_bits(wanted: DataFrame, place: Column) -> np.ndarray:
    """A bit for each place (below BITS) of ``wanted``; of fixed size, whatever the number of rows."""
    words = wanted.select(place.alias("p")).select(
        F.floor(F.col("p") / 32).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p % 32 as int))").alias("bit")
    )
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most BITS / 32 rows
    out = np.zeros(BITS // 32, np.uint32)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out


def packed_sets(docs: DataFrame, bits: np.ndarray, place: Column, key: Column) -> DataFrame:
    """(doc, check, set) of the rows whose place has its bit set: texts that may be wanted.

    Only these leave the task, so texts that resemble nothing are not shuffled. The more
    places are taken, the more rows pass; the join that follows decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            p = whole.column(2).to_numpy()
            passing = whole.filter(pa.array((shared.value[p // 32] >> (p % 32).astype(np.uint32)) & 1 == 1))
            for start in range(0, passing.num_rows, 1024):
                batch = passing.slice(start, 1024)
                packed = pa.array([s.tobytes() for s in shingle_sets(*text_bytes(batch.column(3)))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed], ["doc", "check", "set"])

    rows = docs.select(key.alias("doc"), check_of().alias("check"), place.alias("place"), "text")
    return rows.mapInArrow(run, "doc long, check long, set binary")


def similar_documents(
    docs: DataFrame,
    similarity: float = 0.8,
    recall: float = 0.999999,
    chunk: int = 20_000,
    block_members: int = 1024,
    block_shingles: int = 400_000,
) -> DataFrame:
    """(doc_id, check, label, class_id, n_links, n_copies, n_texts) of every row.

    ``label`` names the group of documents connected by links (null without shingles); two groups
    never share it, as they can share an id. ``class_id`` is the smallest id among documents connected by links, ``n_links`` the
    number of other documents with at least ``similarity``, of which ``n_copies`` have the
    same shingles and ``n_texts`` different sets do the rest. ``chunk`` and the ``block_``
    parameters bound what meets in one task; larger groups are dealt out in pairs of chunks.
    """
    # A pair meets in a run if it shares the run's token and one token at every further split.
    meets = similarity * (1 - (1 - similarity) ** WAYS) ** DEPTH
    runs = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    texts = staged(described(docs, runs), "texts")
    sets = texts.where(F.col("print").isNotNull()).groupBy("print").agg(
        F.count("*").alias("copies"),
        F.min("doc_id").alias("least"),
        F.min(F.struct(key.alias("doc"), "check")).alias("one"),
        F.max("n").alias("n"),
        F.max("sketch").alias("sketch"),
        F.max("tokens").alias("tokens"),
    )
    sets = staged(sets, "sets")
    near = components(staged(proposed(sets, similarity, chunk), "proposed"))
    known = staged(near.withColumnRenamed("node", "print").join(sets.drop("sketch", "tokens"), "print"), "known")
    wanted = known.select("label", "print", "copies", F.col("one.doc").alias("doc"), F.col("one.check").alias("check"))
    place = lambda doc, check: F.pmod(F.xxhash64(doc, check), F.lit(BITS))
    bits = wanted_bits(wanted, place("doc", "check"))
    held = packed_sets(docs, bits, place(key, check_of()), key)
    rows = held.join(wanted, ["doc", "check"]).select("label", "print", "copies", "set")
    sizes = known.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("n")).select(
        "label",
        F.greatest(F.ceil(F.col("m") / block_members), F.ceil(F.col("n") / block_shingles)).alias("n_chunks"),
    )
    dealt = in_chunk_pairs(rows, sizes.where("n_chunks > 1"), ["label"], F.col("print"))
    place = F.xxhash64("label").alias("place")  # labels as longs; equal places of two labels only widen a block
    dealt = dealt.select(place, "a", "b", "own", "print", "copies", "set")
    exact = dealt.repartition("place", "a", "b").sortWithinPartitions("place", "a", "b").mapInArrow(
        _exact_links(similarity), "print binary, root binary, links long, texts long"
    )
    exact = staged(exact, "exact")
    linked = components(exact.select(F.col("print").alias("a"), F.col("root").alias("b")))
    counts = exact.groupBy("print").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    grouped = sets.select("print", "copies", "least").join(linked.withColumnRenamed("node", "print"), "print", "left")
    grouped = grouped.join(counts, "print", "left").withColumn("label", F.coalesce("label", "print"))
    least = grouped.groupBy("label").agg(F.min("least").alias("class_id"))
    told = staged(
        grouped.join(least, "label").select(
            "print",
            "label",
            "class_id",
            (F.col("copies") - 1).alias("n_copies"),
            F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("texts", F.lit(0)).alias("n_texts"),
        ),
        "classes",
    )
    full = texts.select("doc_id", "check", "print").join(told, "print", "left")
    return full.select(
        "doc_id",
        "check",
        "label",
        F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("n_copies", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
    )


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each group one row, that with the smallest id (and check).

    A null id is greater than any other. Rows without shingles are a group for each id and text.
    """
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    alone = F.when(F.col("label").isNull(), F.struct(key, "check")).alias("alone")
    keepers = found.select(key.alias("doc"), "check", "label", alone)
    first = keepers.groupBy("label", "alone").agg(F.min(F.struct("doc", "check")).alias("first")).select("first.*")
    keyed = docs.select(key.alias("doc"), check_of().alias("check"), whole_row(docs).alias("row"))
    return keyed.join(first, ["doc", "check"], "left_semi").dropDuplicates(["doc", "check"]).select("row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs).drop("check", "label")
