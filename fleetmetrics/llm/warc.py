"""Operator 11: WARC archives with a two-level capture index.

Archives hold one gzip member for each record, so a record is read with one range read. The
first level of the index is the sorted list of captures, one line for each record with its
place: the key is the URL with its host reversed (``com,example,blog)/path?query``), then the
page. Lines are cut into compressed blocks. The second level is a sparse directory with the
first key of every block, which stands behind the blocks of its file. A lookup searches the
first keys of the index files, then the directory of one file, then one block, each time in
halves, and only then reads its range of the archive.

Lookups are a Spark job: queries are dealt out in key order, so a task reads the directory and
the blocks of its stretch once, and the places they find are dealt out in archive order, so
neighbouring records are read together. The driver holds one line for each index file (as many
as there are shuffle partitions), whatever the number of captures.

Equal payloads are kept once: the record with the smallest page id is a response, the others
are revisit records that name it. A payload is known by its SHA-1, which the archives carry.

Tasks write archive and index files under names that no other attempt uses and return the
places as rows, which Spark stages; files of lost attempts are never referred to. Folders may
be local shared paths or any URI that ``pyarrow.fs`` opens.

Defined cases: a null payload is an empty one; a null url has no target line in its record and
comes back as null, control characters in a url are percent-encoded; rows repeated with one
page id and payload are records of their own of the same type; a null page id is greater than
any other (if all are null, all are responses) and comes back as null; payloads are read and
written whole; an empty table gives no archive and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_folder, staged

#: An archive is closed when it has this many bytes, and a new one begun.
ARCHIVE_BYTES = 1 << 30
#: Lines in a block of the index.
BLOCK_LINES = 3000
#: Neighbouring records are read together up to this many bytes.
READ_BYTES = 4 << 20

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

_URL = r"(?is)^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/]*\]|[^:/?#]*)(?::(\d*))?([^#]*)"
_CAPTURE = "key string, page_id long, file string, offset long, length long"
_RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
)


# ---------------------------------------------------------------- files


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if re.match(r"^file:", uri):
        return pa.fs.LocalFileSystem(), re.sub(r"^file:(//[^/]*)?", "", uri)
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


class _Written:
    """A new file under ``folder`` with a name of its own, and how far it is written."""

    def __init__(self, folder: str, kind: str):
        self.uri = f"{folder}/{kind}-{uuid.uuid4().hex}.gz"
        files, path = _opened(self.uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = files.open_output_stream(path, compression=None)
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Append, and return (offset, length)."""
        self._out.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)

    def close(self) -> None:
        self._out.close()


class _Ranges:
    """Range reads; the file last read stays open."""

    def __init__(self):
        self._uri, self._file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self._uri:
            self.close()
            files, path = _opened(uri)
            self._uri, self._file = uri, files.open_input_file(path)
        return self._file.read_at(length, offset)

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._uri, self._file = None, None


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder all executors share, which goes when the driver ends."""
    uri = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return uri


# ---------------------------------------------------------------- records


def url_key(url: Column) -> Column:
    """The URL with its host reversed, without scheme, user, default port and fragment."""
    host, port, rest = (F.regexp_extract(url, _URL, n) for n in (1, 2, 3))
    reversed_host = F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ",")
    port_part = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.when(url.rlike(_URL), F.concat(reversed_host, port_part, F.lit(")"), path)).otherwise(url)
    return F.regexp_replace(F.coalesce(key, F.lit("-")), r"[\x00-\x20\x7F]", "%")


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def _page_of(record_id: str) -> int | None:
    page = record_id.split(":")[2]
    return int(page) if page else None


def record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record: the payload, or a revisit of the record of page ``first``."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}"]
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Type: {HTTP_TYPE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields (lower-case names), HTTP fields and payload of one record; refuses a damaged one."""

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode().split("\r\n")[1:]
        return {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}

    head, _, rest = data.partition(b"\r\n\r\n")
    names = fields(head)
    block = rest[: int(names["content-length"])]
    if not head.startswith(VERSION.encode()) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"damaged WARC record: {head[:200]!r}")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = fields(http_head)
    if names["warc-type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if names["warc-payload-digest"] != f"sha1:{digest}" or len(payload) != int(http["content-length"]):
            raise ValueError(f"damaged payload: {names['warc-record-id']}")
    return names, http, payload


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html`` with ``first`` (page of the response) and ``revisit``.

    Only digests that occur twice come back to the pages, so the second side of the join is as
    small as the copies are few; Spark broadcasts it if it measures it as small.
    """
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= min_bytes
    copies = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("digest", "first")
    )
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(copies, "digest", "left").select("page_id", "url", "html", "first", other.alias("revisit"))


def write_archives(
    pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Write a record for each row of :func:`with_revisits`; return the captures, staged."""
    rows = pages.select("page_id", "url", "html", "first", "revisit", url_key(F.col("url")).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        try:
            for batch in batches:
                found = []
                columns = [c.to_pylist() for c in batch.columns]
                for page, url, html, first, revisit, key in zip(*columns):
                    data = gzip.compress(record(page, url, (html or "").encode(), first, revisit, date), 6, mtime=0)
                    if out is not None and out.size + len(data) > archive_bytes:
                        out.close()
                        out = None
                    if out is None:
                        out = _Written(folder, "archive.warc")
                        info = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\n"
                        info += f"WARC-Date: {date}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                        out.add(gzip.compress(info.encode(), 6, mtime=0))
                    found.append((key, page, out.uri, *out.add(data)))
                yield _rows(found, ["key", "page_id", "file", "offset", "length"], "sisii")
        finally:
            if out is not None:
                out.close()

    return staged(rows.mapInArrow(run, _CAPTURE), "captures")


def _rows(rows: list[tuple], names: list[str], kinds: str) -> pa.RecordBatch:
    types = {"s": pa.string(), "i": pa.int64(), "b": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names)


# ---------------------------------------------------------------- index


@dataclass(frozen=True)
class CaptureIndex:
    """The index files in key order: first entry of each, and where its directory stands."""

    firsts: tuple[tuple, ...]
    files: tuple[tuple[str, int, int], ...]


def _entry(key: str, page: int | None) -> tuple[str, bool, int]:
    """What entries are ordered by: key, then page, pages without an id first."""
    return key, page is not None, page or 0


def _order(*more: str) -> list[Column]:
    return [F.col("key").asc(), F.col("page_id").asc_nulls_first(), *(F.col(c).asc() for c in more)]


def _packed(lines: list[list]) -> bytes:
    return gzip.compress("\n".join(map(json.dumps, lines)).encode(), 6, mtime=0)


def _unpacked(data: bytes) -> list[list]:
    return [json.loads(line) for line in gzip.decompress(data).decode().split("\n")]


def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sort the captures into index files of compressed blocks with a directory behind them.

    Files are cut between rows, not between keys, so a URL with any number of captures is
    spread over files like all others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, open_block = None, [], []

        def close_block():
            directory.append([*open_block[0][:2], *out.add(_packed(open_block))])
            open_block.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or _Written(folder, "index.cdx")
                open_block.append(list(line))
                if len(open_block) == block_lines:
                    close_block()
        if out is not None:
            if open_block:
                close_block()
            place = out.add(_packed(directory))
            out.close()
            key, page = directory[0][:2]
            yield _rows([(key, page, out.uri, *place)], ["key", "page_id", "file", "offset", "length"], "sisii")

    order = _order("file", "offset")
    sorted_rows = captures.repartitionByRange(partitions(captures.sparkSession), *order).sortWithinPartitions(*order)
    # One row for each index file.
    files = staged(sorted_rows.mapInArrow(run, _CAPTURE), "index").collect()
    files.sort(key=lambda r: _entry(r.key, r.page_id))
    return CaptureIndex(
        tuple(_entry(r.key, r.page_id) for r in files), tuple((r.file, r.offset, r.length) for r in files)
    )


def _span(keys: list[tuple], low: tuple, high: tuple) -> range:
    """The pieces, known by their first keys, that can hold entries from ``low`` to ``high``."""
    return range(max(0, bisect_left(keys, low) - 1), bisect_right(keys, high))


class _Lookup:
    """Binary search in one index file after the other; directory and block last read stay."""

    def __init__(self, index: CaptureIndex):
        self._index, self._ranges = index, _Ranges()
        self._part = self._block = None

    def find(self, part: int, low: tuple, high: tuple) -> Iterator[list]:
        file, offset, length = self._index.files[part]
        if part != self._part:
            self._directory = _unpacked(self._ranges.read(file, offset, length))
            self._firsts = [_entry(key, page) for key, page, _, _ in self._directory]
            self._part, self._block = part, None
        for number in _span(self._firsts, low, high):
            if number != self._block:
                self._lines = _unpacked(self._ranges.read(file, *self._directory[number][2:]))
                self._entries = [_entry(line[0], line[1]) for line in self._lines]
                self._block = number
            yield from self._lines[bisect_left(self._entries, low) : bisect_right(self._entries, high)]

    def close(self) -> None:
        self._ranges.close()


def find_captures(index: CaptureIndex, queries: DataFrame) -> DataFrame:
    """Captures of the queries: ``key`` (see :func:`url_key`) and, unless all pages are asked for, ``page_id``."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index)
    one_page = "page_id" in queries.columns
    asked = queries.select("key", *(["page_id"] if one_page else []))
    schema = "part long, key string, page_id long"

    def bounds(key: str, page: int | None) -> tuple[tuple, tuple]:
        return (_entry(key, page),) * 2 if one_page else ((key, False, 0), (key, True, 1 << 63))

    def rows_of(batch: pa.RecordBatch, at: int = 0) -> Iterator[tuple]:
        columns = [c.to_pylist() for c in batch.columns]
        return zip(*columns) if one_page or at else ((*row, None) for row in zip(*columns))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = list(shared.value.firsts)
        for batch in batches:
            found = [(p, key, page) for key, page in rows_of(batch) for p in _span(firsts, *bounds(key, page))]
            yield _rows(found, ["part", "key", "page_id"], "isi")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        for batch in batches:
            found = []
            for part, key, page in rows_of(batch, 1):
                found += map(tuple, lookup.find(part, *bounds(key, page)))
            yield _rows(found, ["key", "page_id", "file", "offset", "length"], "sisii")
        lookup.close()

    order = [F.col("part").asc(), *_order()]
    routed = asked.mapInArrow(route, schema).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return routed.mapInArrow(search, _CAPTURE)


def read_records(captures: DataFrame, payload: bool = False) -> DataFrame:
    """Read the records back by range reads, in archive order; ``payload`` adds the bytes of responses."""
    order = [F.col("file").asc(), F.col("offset").asc()]
    n = partitions(captures.sparkSession)
    placed = captures.select("file", "offset", "length").repartitionByRange(n, *order).sortWithinPartitions(*order)
    names = [part.split(" ")[0] for part in _RECORD.split(", ")] + ["payload"] * payload

    def members(rows: list[tuple]) -> Iterator[bytes]:
        """The bytes of each record; neighbours are read together."""
        ranges, first = _Ranges(), 0
        while first < len(rows):
            file, start, length = rows[first]
            end, last = start + length, first + 1
            while last < len(rows) and rows[last][:2] == (file, end) and end + rows[last][2] - start <= READ_BYTES:
                end, last = end + rows[last][2], last + 1
            data = ranges.read(file, start, end - start)
            for _, offset, size in rows[first:last]:
                yield data[offset - start : offset - start + size]
            first = last
        ranges.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for data in members(list(zip(*(c.to_pylist() for c in batch.columns)))):
                fields, http, content = parsed(gzip.decompress(data))
                revisit = fields["warc-type"] == "revisit"
                row = (
                    _page_of(fields["warc-record-id"]),
                    fields.get("warc-target-uri"),
                    fields["warc-type"],
                    _page_of(fields["warc-refers-to"]) if revisit else None,
                    fields["warc-payload-digest"].removeprefix("sha1:"),
                    int(http["content-length"]),
                )
                found.append((*row, None if revisit else content) if payload else row)
                held += len(content) if payload else 0
                if held > READ_BYTES:
                    yield _rows(found, names, "issisib")
                    found, held = [], 0
            yield _rows(found, names, "issisib")

    return placed.mapInArrow(run, _RECORD + (", payload binary" if payload else ""))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write an archive record for every page, then look every page up and read its record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    captures = write_archives(with_revisits(pages), folder)
    index = build_index(captures, folder)
    asked = pages.select(url_key(F.col("url")).alias("key"), "page_id").distinct()
    return read_records(find_captures(index, asked)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _base32(hexadecimal: str) -> str:
    """SQL: 40 hexadecimal digits as 32 base-32 letters, 20 bits at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for group in range(8):
        bits = f"CAST('0x' || substr({hexadecimal}, {5 * group + 1}, 5) AS INTEGER)"
        parts += [f"substr('{letters}', (({bits} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


OP11_SQL = f"""
SELECT page_id, payload_bytes, {_base32('digest')} AS payload_digest,
       CASE WHEN other THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN other THEN first END AS refers_to
FROM (SELECT *, first IS NOT NULL AND page_id IS DISTINCT FROM first AS other
      FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest,
                   min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
            FROM pages))"""
