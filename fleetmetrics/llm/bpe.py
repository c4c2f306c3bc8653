"""Operator 9: byte-level BPE encoding and decoding with a pair occurrence index.

Texts stay Arrow columns: words are byte ranges of the column, found by array operations on the
classes of its code points, and the distinct words of a slice (a dictionary) are encoded
together. An index maps every pair of neighbouring symbols that has a merge rank to all its
places; active ranks are taken in ascending order, every place of the pair is merged, and the
lists of the pairs that arise left and right are extended. A merge can only create pairs of
higher rank (its product did not exist before), so one ascending sweep gives the same tokens
as merging word by word. No word is remembered beyond its slice.

Vocabulary and merges come from a tokenizer file whose path is a parameter; the file's
content goes to tasks as a broadcast of fixed size. Added tokens (such as an end marker)
found in a text are one token each, as the tokenizers library does by default.

Defined cases: null and empty texts have no tokens and decode to the empty text; any length
of text or word is encoded whole; repeated rows get the same tokens; an empty table gives
an empty result; all other columns pass through, unless they are named ``ids`` or
``decoded``, which the result replaces.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from .common import built_once, sliced, text_bytes

#: The pattern that splits a text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = 1 << 30
#: Bytes of text encoded together, cut into words together, and handed to Spark together; longer
#: texts are taken alone.
BATCH_BYTES = 8 << 20
CUT_BYTES = 1 << 19
GIVEN_BYTES = 1 << 19
#: Classes of code points in ``PATTERN``; those on whose class libraries differ are unsure.
OTHER, SPACE, LETTER, NUMBER, UNSURE = range(5)


def _kinds() -> np.ndarray:
    """The class of every code point.

    Unsure are letters and numbers newer than the interpreter's Unicode tables.
    """
    kinds = np.zeros(0x110000, np.uint8)
    points = np.arange(len(kinds), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for kind, of in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for run in regex.finditer(of, points):
            kinds[run.start() : run.end()] = kind
    named = np.flatnonzero(kinds >= LETTER).tolist()
    kinds[[p for p in named if unicodedata.category(points[p]) == "Cn"]] = UNSURE
    return kinds


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable, else from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return letters


class Bpe:
    """Encoder and decoder over one tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_ids = np.array([vocab.get(letter, -1) for letter in letters], np.int64)
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        pairs = np.array([a << 32 | b for a, b, _ in self.merges], np.int64)
        self._pairs, rank = np.unique(pairs, return_index=True)
        self._pair_rank = rank.astype(np.int32)
        value = {letter: byte for byte, letter in enumerate(letters)}
        self.pieces = {i: bytes(value[c] for c in token) for token, i in vocab.items() if all(c in value for c in token)}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.pieces |= {i: token.encode() for token, i in self.added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self._split = regex.compile("|".join(map(regex.escape, longest_first))) if self.added else None
        self._added = pa.array([token.encode() for token in self.added], pa.binary())
        self._piece_of = pa.array([self.pieces.get(i) for i in range(max(self.pieces, default=-1) + 1)], pa.binary())
        self._kinds = _kinds()
        self._splitter = ByteLevel(add_prefix_space=False, use_regex=True)

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and where those of each start and end.

        All are merged together through the pair occurrence index.
        """
        data, ends = text_bytes(words)
        nowhere = len(data)  # before the first and after the last byte of a word
        symbol = np.append(self.byte_ids[data], -1).astype(np.int32)
        after, before = np.arange(1, nowhere + 2, dtype=np.int32), np.arange(-1, nowhere, dtype=np.int32)
        after[ends[1:][ends[1:] > ends[:-1]] - 1] = nowhere
        before[ends[:-1]] = nowhere
        after[nowhere] = nowhere
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(left: np.ndarray) -> None:
            """Enter these places of a pair into the index, if the pair has a rank."""
            rank = self.rank_of(symbol[left], symbol[after[left]])
            ranked = (rank < NO_RANK).nonzero()[0]
            if not len(ranked):
                return
            rank = rank[ranked]
            order = rank.argsort(kind="stable")
            rank, left = rank[order], left[ranked[order]]
            cuts = [0, *((rank[1:] != rank[:-1]).nonzero()[0] + 1).tolist(), len(rank)]
            for r, a, b in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if r in places:
                    places[r].append(left[a:b])
                else:
                    places[r] = [left[a:b]]
                    heapq.heappush(active, r)

        note((after[:nowhere] < nowhere).nonzero()[0].astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            lists = places.pop(rank)
            left = lists[0] if len(lists) == 1 else np.concatenate(lists)
            first, second, product = self.merges[rank]
            # A merge of a lower rank may have used a place.
            right = after[left]
            left = left[(symbol[left] == first) & (symbol[right] == second)]
            if not len(left):
                continue
            left.sort()
            right = after[left]
            if first == second:  # in a run of equal symbols, pairs go from the left
                n = np.arange(len(left))
                begins = np.append(True, left[1:] != right[:-1])
                left = left[(n - np.maximum.accumulate(np.where(begins, n, 0))) % 2 == 0]
                right = after[left]
            symbol[left], symbol[right] = product, -1
            beyond = after[right]
            after[left] = beyond
            before[beyond] = left
            ahead = before[left]
            # What lies ahead may be the product just before.
            apart = np.append(True, ahead[1:] != left[:-1])
            note(np.concatenate((left, ahead[apart])))
        alive = symbol >= 0
        return symbol[alive], np.append(0, np.cumsum(alive))[ends]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NO_RANK if it has none."""
        if not len(self._pairs):
            return np.full(len(left), NO_RANK)
        key = left.astype(np.int64) << 32 | right
        at = self._pairs.searchsorted(key)
        at[at == len(self._pairs)] = 0
        return np.where(self._pairs[at] == key, self._pair_rank[at], NO_RANK)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the words of texts start, in bytes; every byte belongs to a word, none crosses texts.

        ``PATTERN`` as array operations: a word is a run of one class. The last space before
        another class is apart from the spaces before it, and goes with what follows if it is
        a blank. An apostrophe that starts a word may take one or two letters.
        """
        text = data.tobytes().decode()
        if len(text) == len(data):
            code, at, bounds = data, None, offsets
        else:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            at = np.flatnonzero((data & 0xC0) != 0x80)
            bounds = np.searchsorted(at, offsets)
        if not len(code):
            return np.zeros(0, np.int64)
        tokens = []
        if any(token in text for token in self.added):
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                tokens += [(a + m.start(), a + m.end()) for m in self._split.finditer(text[a:b])]
        kind = self._kinds[code]
        first = np.zeros(len(code) + 1, bool)  # of a text, of an added token and of what follows it
        first[bounds] = True
        for token in tokens:
            first[list(token)] = True
        start = first[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])
        start[last] = True
        start[last[code[last] == ord(" ")] + 1] = False
        mark = np.flatnonzero(code == ord("'"))
        mark = mark[start[mark]].tolist()
        for i in mark:
            if first[i + 1]:
                continue
            after = text[i + 1 : i + 3]
            size = 1 if after[0] in "stmd" else 2 * (after in ("re", "ve", "ll") and not first[i + 2])
            if size:
                start[i + 1] = False
                if i + 1 + size < len(code):
                    start[i + 1 + size] = True
        unsure = np.flatnonzero(kind == UNSURE)
        if len(unsure):  # as the library cuts what lies between added tokens
            edges = np.flatnonzero(first).tolist()
            if edges[-1] != len(code):
                edges.append(len(code))
            for n in np.unique(np.searchsorted(edges, unsure, "right") - 1).tolist():
                a, b = edges[n], edges[n + 1]
                start[a:b] = False
                start[[a + x for _, (x, _) in self._splitter.pre_tokenize_str(text[a:b])]] = True
        for a, b in tokens:
            start[a:b] = False
            start[a] = True
        return np.flatnonzero(start) if at is None else at[start]

    def encode_all(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of each."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        starts, done = [], 0
        while done < len(column):
            base = offsets[done]
            last = max(done + 1, int(np.searchsorted(offsets, base + CUT_BYTES, "right")) - 1)
            part = self.cut(data[base : offsets[last]], offsets[done : last + 1] - base)
            starts.append((part + base).astype(np.int32))
            done = last
        bounds = np.append(np.concatenate(starts), np.int32(len(data)))
        words = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        words = words.dictionary_encode()
        flat, ends = self.merge(words.dictionary)
        begin, size = ends[:-1], np.diff(ends)
        if self.added:
            which = pc.index_in(words.dictionary, self._added)
            found = which.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
            begin[found], size[found] = len(flat) + which.drop_null().to_numpy(), 1
            flat = np.append(flat, np.array([*self.added.values()], np.int32))
        word = words.indices.to_numpy()
        ends = np.append(0, np.cumsum(size[word]))
        shift = np.repeat((begin[word] - ends[:-1]).astype(np.int32), size[word])
        shift += np.arange(len(shift), dtype=np.int32)
        return flat[shift], ends[np.searchsorted(bounds, offsets)]

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each run of ids; bytes that are no UTF-8 are replaced."""
        pieces = self._piece_of.take(pa.array(ids))
        if pieces.null_count:
            raise KeyError("an id that the tokenizer file does not name")
        data, at = text_bytes(pieces)
        at = at[offsets] if len(ids) else offsets
        where = pa.py_buffer(at.astype(np.int32))
        out = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, where, pa.py_buffer(np.ascontiguousarray(data))])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            whole = data.tobytes()
            return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string())
        return out


def encoded(docs: DataFrame, path: str, column: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if asked for, the text ``decoded`` from them."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    key = uuid.uuid4().hex
    kept = [f for f in docs.schema.fields if f.name not in ("ids", "decoded")]
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    added += [T.StructField("decoded", T.StringType())] if decode else []
    place = [f.name for f in kept].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built_once(key, lambda: Bpe(content.value))
        for batch in batches:
            for part in sliced(batch, place, BATCH_BYTES):
                flat, offsets = bpe.encode_all(part.column(place))
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
                if decode:
                    columns.append(bpe.decode_all(flat, offsets))
                whole = pa.RecordBatch.from_arrays(columns, [f.name for f in (*kept, *added)])
                yield from sliced(whole, place, GIVEN_BYTES)

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, T.StructType([*kept, *added]))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), decode=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
