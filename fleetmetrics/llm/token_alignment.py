"""Operator 12: the tokens of two tokenizers aligned by the bytes they cover.

Both tokenizers encode a space and the text. For each Arrow batch the tokens of both sides
become two pandas frames in byte order, and ``merge_asof``, keyed by document, finds for each
token start the token of the other side that covers it: the last one that starts there or
before. The union of both directions holds every overlapping pair of tokens once. Pairs that
end at the same byte are the links; their ends cut the document into groups, the smallest
stretches that both sides tokenize by themselves.

Two linked tokens end together, so the bytes of one are the end of the other's. The two
vocabularies therefore bound the pairs of ids that can ever be linked (one for each ending of a
token that is a token of the other side, at most their bytes), whatever the corpus is. Links are
written as numbers in that table, their counts over the corpus are one dense sum for each
partition, and the summed table is small enough for every task by this bound.

A side is a byte-level BPE file (``.json``) or a piece model (``.model``); paths are parameters,
the contents go to tasks as broadcasts of fixed size. Strings of special tokens are plain text.

Defined cases: null and empty texts, and texts whose tokens of either side do not spell the
space and the text (a literal U+2581, say), have no tokens: zeros and an empty group list; texts
of any length are aligned whole; repeated rows get the same result and all count in the corpus;
an empty table gives an empty result; all other columns pass through, unless one is named
``alignment`` (or ``scores``), which the result replaces.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PATTERN, byte_letters
from .common import built_once, sliced, staged

#: Bytes of text aligned together; longer texts are aligned alone.
BATCH_BYTES = 1 << 18
#: Links counted or scored together: an Arrow batch may hold millions.
BATCH_LINKS = 1 << 18

_LONGS = [T.StructField(n, T.LongType(), False) for n in ("n_a", "n_b", "n_groups")]
_INTS = T.ArrayType(T.IntegerType(), False)
_OVERLAP = T.StructType([T.StructField(n, T.IntegerType(), False) for n in ("a", "b")])
#: What can be asked of an alignment beside the three counts.
OUTPUTS = {
    "groups": T.StringType(),  # a1,a2|b1;a3|b2,b3: ids of each group, side A | side B
    "links": _INTS,  # numbers in link_pairs()
    "ids_a": _INTS,
    "ids_b": _INTS,
    "ends_a": _INTS,  # byte offsets in space + text, exclusive
    "ends_b": _INTS,
    "overlaps": T.ArrayType(_OVERLAP, False),  # places in ids_a and ids_b
}
SCORES = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_links", "n_best", "count_sum")])


class ByteLevel:
    """One side: a byte-level BPE file."""

    def __init__(self, content: bytes):
        model = json.loads(content)["model"]
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.pieces = {i: bytes(value[c] for c in t) for t, i in model["vocab"].items() if all(c in value for c in t)}
        order = [i for _, i in sorted((model["vocab"][a + b], n) for n, (a, b) in enumerate(model["merges"]))]
        if order != list(range(len(order))):
            raise ValueError("ids must follow the order of merges")
        ranks = {piece: i for i, piece in self.pieces.items()}
        ranks = {piece: i for piece, i in ranks.items() if len(piece) == 1 or i >= 256}
        self._coder = tiktoken.Encoding("side", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._coder.encode_ordinary(" " + text) for text in texts]


class Pieces:
    """One side: a piece model with byte fallback, which puts the space before the text itself."""

    def __init__(self, content: bytes):
        self._coder = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.pieces = {}
        for i in range(self._coder.vocab_size()):
            piece = self._coder.id_to_piece(i)
            self.pieces[i] = bytes([int(piece[3:5], 16)]) if self._coder.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._coder.encode(texts, num_threads=1)


def _side(path: str, content: bytes) -> ByteLevel | Pieces:
    return Pieces(content) if path.endswith(".model") else ByteLevel(content)


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def suffix_pairs(a: dict[int, bytes], b: dict[int, bytes]) -> np.ndarray:
    """All id pairs whose bytes can end together, as sorted ``id_a << 32 | id_b``."""

    def ending_in(long: dict[int, bytes], short: dict[int, bytes]):
        known: dict[bytes, list[int]] = {}
        for i, piece in short.items():
            known.setdefault(piece, []).append(i)
        for i, piece in long.items():
            for start in range(len(piece)):
                for j in known.get(piece[start:], ()):
                    yield i, j

    pairs = {x << 32 | y for x, y in ending_in(a, b)} | {x << 32 | y for y, x in ending_in(b, a)}
    return np.sort(np.fromiter(pairs, np.int64, len(pairs)))


def link_pairs(path_a: str, path_b: str) -> np.ndarray:
    """The table that ``links`` point into; its size depends on the vocabularies alone."""
    return suffix_pairs(_side(path_a, _content(path_a)).pieces, _side(path_b, _content(path_b)).pieces)


class Aligner:
    """Both sides, and what a batch needs of them as arrays."""

    def __init__(self, a: ByteLevel | Pieces, b: ByteLevel | Pieces, pairs: np.ndarray):
        self.sides, self.pairs = (a, b), pairs
        self._sizes, self._written = [], []
        for side, inner in ((a, "|"), (b, ";")):
            top = max(side.pieces) + 1
            sizes = np.zeros(top, np.int64)
            for i, piece in side.pieces.items():
                sizes[i] = len(piece)
            self._sizes.append(sizes)
            digits = [str(i) for i in range(top)]
            self._written.append(np.array([[d + "," for d in digits], [d + inner for d in digits], digits], object))

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[list[int]]]]:
        """Places of texts that both sides spell in full, and their ids on each side."""
        asked = [n for n, text in enumerate(texts) if text]
        some = [texts[n] for n in asked]
        coded = [side.encode(some) for side in self.sides]
        spelled = [b" " + text.encode() for text in some]
        good = []
        for n, whole in enumerate(spelled):
            try:
                good.append(all(b"".join(map(s.pieces.__getitem__, c[n])) == whole for s, c in zip(self.sides, coded)))
            except KeyError:
                good.append(False)
        keep = np.flatnonzero(good)
        return np.array(asked, np.int64)[keep], [[c[n] for n in keep.tolist()] for c in coded]

    def align(self, texts: list[str | None], wanted: tuple[str, ...]) -> pa.StructArray:
        places, coded = self.tokens(texts)
        ids, owner, counts, ends, frames = [], [], [], [], []
        for side, lists in enumerate(coded):
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
            size = self._sizes[side][flat]
            end = np.cumsum(size)  # both sides spell the same bytes: one offset for both
            doc = np.repeat(np.arange(len(lists)), n)
            ids.append(flat), owner.append(doc), counts.append(n), ends.append(end)
            name = "ab"[side]
            frames.append(pd.DataFrame({"at": end - size, "doc": doc, name: np.arange(len(flat)), f"end_{name}": end}))
        a_cover = pd.merge_asof(frames[0], frames[1], on="at", by="doc")
        b_cover = pd.merge_asof(frames[1], frames[0], on="at", by="doc")
        # Tokens that start together are in both directions: they are taken from the first.
        shared = np.isin(frames[1]["at"].to_numpy(), frames[0]["at"].to_numpy(), assume_unique=True)
        cover = pd.concat([a_cover, b_cover[~shared]], ignore_index=True)
        meets = cover[cover["end_a"].to_numpy() == cover["end_b"].to_numpy()]
        meets = meets.iloc[np.argsort(meets["end_a"].to_numpy(), kind="stable")]
        cuts = meets["end_a"].to_numpy()

        n_docs = len(places)
        link_doc = meets["doc"].to_numpy()
        n_links = np.bincount(link_doc, minlength=n_docs)
        found = {"n_a": counts[0], "n_b": counts[1], "n_groups": n_links}
        row = np.full(len(texts), -1, np.int64)
        row[places] = np.arange(n_docs)
        columns = [
            pa.array(np.where(row >= 0, found[n][row] if n_docs else 0, 0), pa.int64()) for n in ("n_a", "n_b", "n_groups")
        ]

        def listed(values: pa.Array, size: np.ndarray) -> pa.ListArray:
            whole = np.zeros(len(texts) + 1, np.int32)
            whole[places + 1] = size
            return pa.ListArray.from_arrays(pa.array(np.cumsum(whole, dtype=np.int32)), values)

        for name in wanted:
            if name == "groups":
                texts_of = self._groups(ids, ends, owner, cuts, counts)
                columns.append(pa.array([texts_of[r] if r >= 0 else "" for r in row.tolist()], pa.string()))
            elif name == "links":
                key = ids[0][meets["a"].to_numpy()] << 32 | ids[1][meets["b"].to_numpy()]
                columns.append(listed(pa.array(np.searchsorted(self.pairs, key), pa.int32()), n_links))
            elif name == "overlaps":
                doc = cover["doc"].to_numpy()
                order = np.lexsort((cover["b"].to_numpy(), cover["a"].to_numpy()))
                fields = []
                for side in (0, 1):
                    first = np.cumsum(counts[side]) - counts[side]
                    local = cover["ab"[side]].to_numpy() - first[doc]
                    fields.append(pa.array(local[order], pa.int32()))
                both = pa.StructArray.from_arrays(fields, ["a", "b"])
                columns.append(listed(both, np.bincount(doc, minlength=n_docs)))
            else:
                side = "ab".index(name[-1])
                total = np.bincount(owner[1], self._sizes[1][ids[1]], n_docs).astype(np.int64)
                base = (np.cumsum(total) - total)[owner[side]]
                values = ids[side] if name.startswith("ids") else ends[side] - base
                columns.append(listed(pa.array(values, pa.int32()), counts[side]))
        return pa.StructArray.from_arrays(columns, ["n_a", "n_b", "n_groups", *wanted])

    def _groups(self, ids, ends, owner, cuts, counts) -> list[str]:
        """The written groups of each document: every id with the sign that follows it."""
        group = [np.searchsorted(cuts, end) for end in ends]
        place = [
            np.arange(len(ids[0])) + np.searchsorted(group[1], group[0]),
            np.arange(len(ids[1])) + np.searchsorted(group[0], group[1], "right"),
        ]
        written = np.empty(len(ids[0]) + len(ids[1]), object)
        for side in (0, 1):
            sign = (np.diff(group[side], append=-1) != 0).astype(np.int64)  # last of its group
            if side:
                sign[np.diff(owner[1], append=-1) != 0] = 2  # last of the document
            written[place[side]] = self._written[side][sign, ids[side]]
        offsets = np.concatenate(([0], np.cumsum(counts[0] + counts[1]))).tolist()
        whole = written.tolist()
        return ["".join(whole[x:y]) for x, y in zip(offsets, offsets[1:])]


def aligned(
    docs: DataFrame, path_a: str, path_b: str, column: str = "text", outputs: tuple[str, ...] = ("groups", "links")
) -> DataFrame:
    """``docs`` with a struct ``alignment``: ``n_a``, ``n_b``, ``n_groups`` and the asked ``OUTPUTS``."""
    spark = docs.sparkSession
    contents = spark.sparkContext.broadcast((_content(path_a), _content(path_b), link_pairs(path_a, path_b)))
    key = uuid.uuid4().hex
    kept = [f for f in docs.schema.fields if f.name != "alignment"]
    place = [f.name for f in kept].index(column)
    kind = T.StructType([*_LONGS, *(T.StructField(n, OUTPUTS[n], False) for n in outputs)])
    schema = T.StructType([*kept, T.StructField("alignment", kind, False)])

    def build() -> Aligner:
        a, b, pairs = contents.value
        return Aligner(_side(path_a, a), _side(path_b, b), pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = built_once(key, build)
        for batch in batches:
            if batch.num_rows:
                for part in sliced(batch, place, BATCH_BYTES):
                    found = aligner.align(part.column(place).to_pylist(), tuple(outputs))
                    yield pa.RecordBatch.from_arrays([*part.columns, found], schema.names)

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def linked(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``BATCH_LINKS`` links, with links as (offsets, numbers); longer rows stay whole."""
    for batch in batches:
        offsets = batch.column(place).field("links").offsets.to_numpy()
        part = (offsets[1:] - offsets[0]) // BATCH_LINKS
        starts = np.flatnonzero(np.append(True, np.diff(part) > 0)).tolist() if batch.num_rows else []
        for first, last in zip(starts, [*starts[1:], batch.num_rows]):
            some = batch.slice(first, last - first)
            links = some.column(place).field("links")
            ends = links.offsets.to_numpy()
            yield some, ends - ends[0], links.flatten().to_numpy()


def _over_links(df: DataFrame, schema: T.StructType, each: Callable) -> DataFrame:
    """``each`` gets what :func:`linked` makes of the batches of ``df``."""
    place = df.columns.index("alignment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(linked(batches, place))

    return df.mapInArrow(run, schema)


def link_counts(alignments: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, links): how often each pair of ids is linked; at most ``n_pairs`` rows a partition."""

    def each(opened):
        total = np.zeros(n_pairs, np.int64)
        for _, _, links in opened:
            total += np.bincount(links, minlength=n_pairs)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "links"])

    schema = T.StructType([T.StructField(n, T.LongType(), False) for n in ("pair", "links")])
    counted = _over_links(alignments.select(F.struct("alignment.links").alias("alignment")), schema, each)
    return counted.groupBy("pair").agg(F.sum("links").alias("links"))


def scored(alignments: DataFrame, pairs: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """Add ``scores``: links, links whose count is the highest of their B id, and all counts summed.

    ``alignments`` is read twice and should be staged. The counts, one for each pair that the
    vocabularies allow, pass through the driver. Where links are not needed again, ``keep`` names
    the columns to give back, so that links enter tasks but do not come out of them.
    """
    counted = link_counts(alignments, len(pairs)).toArrow()
    counts = np.zeros(len(pairs), np.int64)
    counts[counted["pair"].to_numpy()] = counted["links"].to_numpy()
    id_b = pairs & 0xFFFFFFFF
    highest = np.zeros(int(id_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, id_b, counts)
    shared = alignments.sparkSession.sparkContext.broadcast((counts, counts == highest[id_b]))
    kept = [f for f in alignments.schema.fields if f.name != "scores" and (keep is None or f.name in keep)]
    schema = T.StructType([*kept, T.StructField("scores", SCORES, False)])
    columns = [F.col(f"`{f.name}`") for f in kept]
    if "alignment" not in schema.names:
        columns.append(F.struct("alignment.links").alias("alignment"))

    def each(opened):
        count, best = shared.value
        for batch, offsets, links in opened:
            sums = [np.concatenate(([0], np.cumsum(x[links], dtype=np.int64))) for x in (best, count)]
            found = [np.diff(offsets), *(s[offsets[1:]] - s[offsets[:-1]] for s in sums)]
            scores = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], SCORES.names)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], scores], schema.names)

    return _over_links(alignments.select(*columns), schema, each)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = aligned(docs, *paths).drop("text")
    digest = F.when(F.col("alignment.n_a") > 0, F.sha2("alignment.groups", 256)).otherwise(F.lit(""))
    sizes = [f.name for f in _LONGS]
    slim = found.select(
        "doc_id",
        *[f"alignment.{n}" for n in sizes],
        digest.alias("groups_sha256"),
        F.struct("alignment.links").alias("alignment"),
    )
    done = scored(staged(slim, "alignments"), link_pairs(*paths), keep=["doc_id", *sizes, "groups_sha256"])
    return done.select("doc_id", *sizes, "scores.*", "groups_sha256")
