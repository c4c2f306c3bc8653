"""Operator 8: approximate nearest neighbours by cross-polytope hashing.

Vectors are centred on the mean of all and scaled to unit length for hashing only. A hash
function is a pseudo-rotation (three rounds of random signs and a fast Hadamard transform)
followed by the nearest of the signed axes; a table joins ``depth`` of them, the last one
cut to as many axes as makes the number of buckets follow the number of vectors. Queries
also look into the buckets of the next nearest axes (multiprobe), into more of them the
more vectors there are (``probes_for``), so that recall holds. Within a bucket all
vectors are compared exactly, on the original vectors in double precision, and each query
keeps the best of the bucket, so what leaves a bucket grows with the queries alone.

A query whose tables gave fewer than k vectors although there are more is compared with all
rows, in blocks: the exact way for sparse regions.

Defined cases: vectors that are null, zero, or hold null or non-finite values take no part,
as a row without an id; vectors of another length than the most frequent one take no part;
equal distances go to the smaller id; rows repeated with one id are one candidate (the
nearest copy counts) and none for a query of that id; an empty table gives an empty result;
columns beside the two named are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import built_once, chunked, staged

FOUND = "query_id long, vec_id long, score double"


def layout(dim: int, n: int, bucket: int) -> tuple[int, int]:
    """(depth, last): buckets = (2 size)^(depth - 1) * 2 last, about n / bucket."""
    size = 1 << max(1, (dim - 1).bit_length())
    buckets, depth = max(2.0, n / bucket), 1
    while buckets > 2 * size:
        buckets, depth = buckets / (2 * size), depth + 1
    return depth, int(min(size, max(1, round(buckets / 2))))


def probes_for(n: int) -> int:
    """Buckets a query looks into in each of 12 tables: 24 up to 50,000 vectors, then 24 (n / 50,000)^0.6.

    Fitted on vectors without structure (uniform directions, dim 64), the hardest case: there
    recall of the 10 nearest stays over 0.9; the README has the figures.
    """
    return max(24, math.ceil(24 * (n / 50_000) ** 0.6))


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    kept = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & nonzero)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class CrossPolytope:
    """``tables`` hash functions of ``depth`` rotations each; drawn from a seed, nothing is stored."""

    def __init__(self, dim: int, mean: np.ndarray, tables: int, depth: int, last: int, seed: int = 8):
        self.mean, self.tables, self.depth, self.last = mean, tables, depth, last
        self.size = 1 << max(1, (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (tables, depth, 3, self.size))

    def rotated(self, unit: np.ndarray, table: int, part: int) -> np.ndarray:
        x = unit
        for signs in self.signs[table, part]:
            x = x * signs
            step = 1
            while step < self.size:  # fast Hadamard transform
                pairs = x.reshape(len(x), -1, 2, step)
                x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), -1)
                step *= 2
            x = x / np.sqrt(self.size)
        return x

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        x = np.zeros((len(vectors), self.size))
        x[:, : vectors.shape[1]] = vectors - self.mean
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(length > 0, length, 1)

    def probes(self, unit: np.ndarray, table: int, count: int) -> np.ndarray:
        """The ``count`` bucket codes nearest to each vector, nearest first.

        The loss of an axis is how much farther it is than the nearest; losses of the parts
        add up, and sums are tried in ascending order.
        """
        codes, losses = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for part in range(self.depth):
            x = self.rotated(unit, table, part)
            if part == self.depth - 1:
                x = x[:, : self.last]
            signed = np.concatenate((x, -x), axis=1)
            near = min(count, signed.shape[1])
            order = np.argsort(-signed, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(signed, order, 1)
            loss = (value[:, :1] - value) ** 2
            total = (losses[:, :, None] + loss[:, None, :]).reshape(len(x), -1)
            code = (codes[:, :, None] * (2 * self.size) + order[:, None, :]).reshape(len(x), -1)
            best = np.argsort(total, axis=1, kind="stable")[:, :count]
            codes, losses = np.take_along_axis(code, best, 1), np.take_along_axis(total, best, 1)
        return codes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int):
    """For a block: (query number, vec_id, distance) of each query's k best ids, ties by id.

    The rows of an id become one, the nearest, before the best are cut out.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    single = ids[first]
    for q in range(len(queries)):
        gap = vectors - queries[q]
        distance = np.sqrt((gap * gap).sum(1))
        if len(single) < len(ids):
            distance = np.minimum.reduceat(distance, first)
        distance[single == own[q]] = np.inf
        place = np.arange(len(single))
        if len(single) > k:
            place = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        for i in place[np.argsort(distance[place], kind="stable")][:k].tolist():
            if distance[i] < np.inf:
                yield q, int(single[i]), float(distance[i])


def _compare(k: int):
    """Task code over rows sorted by (table, code, chunk, is vector): queries first, then vectors.

    Queries of a bucket are held in blocks and every block of vectors is compared with them,
    so memory follows the block, not the bucket; each query keeps its k best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, best = None, [], {}

        def out():
            rows = [(q, v, -d) for q, heap in best.items() for d, v in ((d, -v) for d, v in heap)]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                ["query_id", "vec_id", "score"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            keys = np.column_stack(names[:3])
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, len(keys)]):
                if key is None or (keys[a] != key).any():
                    if best:
                        yield out()
                    key, queries, best = keys[a], [], {}
                kinds, ids = names[3][a:b], names[4][a:b]
                matrix = _matrix(batch.column(5).slice(a, b - a))
                asked = kinds == 0
                if asked.any():
                    queries.append((ids[asked], matrix[asked]))
                if not asked.all() and queries:
                    own, asking = np.concatenate([q[0] for q in queries]), np.concatenate([q[1] for q in queries])
                    queries = [(own, asking)]
                    for q, vec, d in _nearest(asking, ids[~asked], matrix[~asked], own, k):
                        heap = best.setdefault(int(own[q]), [])
                        at = next((i for i, (_, v) in enumerate(heap) if v == -vec), None)
                        if at is None:
                            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-d, -vec))
                        elif d < -heap[at][0]:  # a nearer copy in a later block
                            heap[at] = (-d, -vec)
                            heapq.heapify(heap)
        if best:
            yield out()

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    each = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    tables: int = 12,
    probes: int | None = None,
    bucket: int = 48,
    chunk: int = 20_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): Euclidean neighbours of every row of ``queries``.

    ``bucket`` is the number of vectors a bucket should hold on average; the number of
    buckets follows from it. A query looks into ``probes`` buckets of each table, by default
    as many as ``probes_for`` says, so its work grows with the 0.6th power of the vectors.
    Buckets of more than ``chunk`` vectors are split over tasks.
    """
    spark = vectors.sparkSession
    base = staged(usable(vectors).dropDuplicates(["vec_id", "v"]), "vectors")
    asked = usable(queries).dropDuplicates(["vec_id", "v"])
    shape = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = int(shape["dim"]), int(shape["count"])
    base, asked = base.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    mean = np.array(base.agg(*[F.avg(F.element_at("v", i + 1)) for i in range(dim)]).first(), np.float64)
    depth, last = layout(dim, n, bucket)
    probes = probes or probes_for(n)
    key = uuid.uuid4().hex

    def hashed(count: int, kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = built_once(key, lambda: CrossPolytope(dim, mean, tables, depth, last))
            # Probing tries count * min(count, axes) sums for each row; a block tries about a million.
            block = min(2048, max(1, (1 << 20) // (count * min(count, 2 * hashes.size))))
            for whole in batches:
                for start in range(0, whole.num_rows, block):
                    batch = whole.slice(start, block)
                    unit = hashes.unit(_matrix(batch.column(1)))
                    for table in range(tables):
                        codes = hashes.probes(unit, table, count)
                        each = batch if codes.shape[1] == 1 else batch.take(pa.array(np.repeat(np.arange(len(codes)), codes.shape[1])))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(codes.size, table, np.int32)),
                                pa.array(codes.ravel()),
                                pa.array(np.full(codes.size, kind, np.int32)),
                                *each.columns,
                            ],
                            ["table", "code", "kind", "vec_id", "v"],
                        )

        return run

    place = "table int, code long, kind int, vec_id long, v array<double>"
    index = chunked(base.mapInArrow(hashed(1, 1), place), ["table", "code"], F.col("vec_id"), chunk)
    looked = asked.mapInArrow(hashed(probes, 0), place)
    # A query goes to every chunk of a split bucket.
    split = index.where("n_chunks > 1").select("table", "code", "n_chunks").distinct()
    looked = looked.join(split, ["table", "code"], "left").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.coalesce("n_chunks", F.lit(1)) - 1))
    )
    columns = ["table", "code", "chunk", "kind", "vec_id", "v"]
    both = index.select(*columns).unionByName(looked.select(*columns))
    dealt = both.repartition("table", "code", "chunk").sortWithinPartitions("table", "code", "chunk", "kind")
    found = staged(dealt.mapInArrow(_compare(k), FOUND), "found")
    per_query = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    enough = per_query.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = staged(asked.join(enough, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return _ranked(found, k)
    return _ranked(found.unionByName(exact(base, short, k)), k)


def exact(base: DataFrame, asked: DataFrame, k: int, blocks: int = 16) -> DataFrame:
    """Brute force in blocks: every query meets every block of rows once."""
    rows = base.select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("code"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), "vec_id", "v")
    copies = asked.select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("code"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("chunk"), F.lit(0).alias("kind"), "vec_id", "v")
    dealt = rows.unionByName(copies).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return dealt.mapInArrow(_compare(k), FOUND)


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = nearest(rows, rows.where("vec_id % 100 = 0"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
