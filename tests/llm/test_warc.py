"""WARC archives and their capture index, on odd, repeated and empty pages."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetmetrics.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, first string"


def sha1(text: str | None) -> str:
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, min_bytes=0):
    """(page, bytes, digest, type, refers to) of every row."""
    ids = defaultdict(list)
    for page, _, html, *_ in rows:
        ids[html or ""].append(page)
    out = []
    for page, _, html, *_ in rows:
        text = html or ""
        known = [i for i in ids[text] if i is not None]
        first = min(known) if known and len(ids[text]) > 1 and len(text.encode()) >= min_bytes else page
        revisit = page != first
        out.append((page, len(text.encode()), sha1(text), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def through_archives(spark, pages, folder, queries=None, min_bytes=0, **sizes):
    captures = warc.write_archives(
        warc.with_revisits(pages, min_bytes), folder, archive_bytes=sizes.get("archive_bytes", 1 << 30)
    )
    index = warc.build_index(captures, folder, sizes.get("block_lines", 3000))
    if queries is None:
        queries = pages.select(warc.url_key(F.col("url")).alias("key"), "page_id").distinct()
    return index, warc.read_records(warc.find_captures(index, queries), payload=True)


def decisions(records):
    picked = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, picked.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    hosts = ["one.example.com", "two.example.com", "EXAMPLE.org:8080", "example.org"]
    many = [
        (i, f"https://{random.choice(hosts)}/p/{random.randrange(40)}?q={i % 7}", f"<p>{random.randrange(90)}</p>" * 3)
        for i in range(400)
    ]
    many += [(1000 + i, "https://hot.example.com/", "hot") for i in range(200)]  # one URL, one payload
    odd = [
        (5001, None, None), (5002, "", ""), (5003, "not a url", "é\r\n\r\nü"), (5004, "http://a/\r\nX: y", "z"),
        (5005, "//h.example.com", "z"), (None, "http://null.example.com/", "null id"), (None, "http://null.example.com/", "hot"),
        (5006, "http://a/", "same"), (5006, "http://a/", "same"), (5007, "http://b/#frag", "same"),
        (5008, "http://long.example.com/" + "x" * 5000, "long " * 200_000),
    ]
    return [(*r, "mine", "clash") for r in many + odd]


def test_pages_come_back_through_the_index(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index, records = through_archives(spark, pages, str(tmp_path), block_lines=7, archive_bytes=20_000)
    assert len(list(tmp_path.glob("archive.warc-*.gz"))) > 3 and len(index.files) > 1
    assert decisions(records) == expected(rows)
    html = {(r[0], sha1(r[2])): (r[2] or "").encode() for r in rows}
    for row in records.collect():
        if row.record_type == "response":
            assert bytes(row.payload) == html[row.page_id, row.payload_digest]
    urls = {r.page_id: r.url for r in records.collect()}
    assert urls[5001] is None and urls[5002] == "" and urls[5004] == "http://a/%0D%0AX: y"
    assert urls[3] == rows[3][1]


def test_small_payloads_are_all_responses(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, SCHEMA)
    _, records = through_archives(spark, pages, str(tmp_path), min_bytes=10)
    assert decisions(records) == expected(rows, 10)


def test_lookup_by_url_finds_all_its_captures_and_no_others(spark, rows, tmp_path):
    pages = spark.createDataFrame(rows, SCHEMA)
    urls = ["https://hot.example.com/", rows[0][1], "https://nobody.example.com/", "http://a/"]
    asked = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(F.col("url")).alias("key"))
    _, records = through_archives(spark, pages, str(tmp_path), asked, block_lines=11)
    key = {r.url: r.key for r in spark.createDataFrame([(r[1],) for r in rows], "url string")
           .select("url", warc.url_key(F.col("url")).alias("key")).distinct().collect()}
    wanted = {key[u] for u in urls if u in key}
    got = sorted((r.page_id for r in records.collect()), key=repr)
    assert got == sorted((r[0] for r in rows if key[r[1]] in wanted), key=repr)


def test_archives_are_gzip_members_of_whole_records(spark, rows, tmp_path):
    captures = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, SCHEMA)), str(tmp_path))
    for row in captures.collect():
        with open(row.file, "rb") as file:
            file.seek(row.offset)
            fields, http, _ = warc.parsed(gzip.decompress(file.read(row.length)))
        assert fields["warc-record-id"].startswith(f"<urn:page:{'' if row.page_id is None else row.page_id}:")
        assert fields["warc-payload-digest"] and http["content-length"].isdigit()
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("archive.warc-*.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(rows) + len(list(tmp_path.glob("archive.warc-*.gz")))


def test_a_damaged_record_is_refused():
    data = warc.record(1, "http://a/", b"payload", None, False, "2020-01-01T00:00:00Z")
    assert warc.parsed(data)[2] == b"payload"
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(data.replace(b"payload", b"PAYLOAD"))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(data[:-2])


def test_url_keys(spark):
    urls = {
        "https://Blog.Example.COM/a?b=1#top": "com,example,blog)/a?b=1",
        "http://example.org:80": "org,example)/",
        "http://u:p@example.org:8080/x y": "org,example:8080)/x%y",
        "plain": "plain",
        None: "-",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.key for r in df.select("url", warc.url_key(F.col("url")).alias("key")).collect()} == urls


def test_no_pages(spark, tmp_path):
    index, records = through_archives(spark, spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert index.files == () and records.collect() == []
