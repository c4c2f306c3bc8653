"""Token alignment and periodic runs against brute force, and on odd and empty tables."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetmetrics.llm import periodic_runs, token_alignment
from fleetmetrics.llm.bpe import byte_letters

from .conftest import ODD
from .test_operators import SF

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def sha(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


# ---------------------------------------------------------------- 12


class Plain:
    """Both tokenizers through their own libraries, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])

    def tokens(self, text: str) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        coded = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            b.append((i, bytes.fromhex(byte[1]) if byte else piece.replace("▁", " ").encode()))
        return a, b

    def align(self, text: str | None):
        if not text:
            return None
        a, b = self.tokens(text)
        whole = (" " + text).encode()
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            return None
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        at_b = {e: i for (i, _), e in zip(b, ends[1])}
        links = [(i, at_b[e]) for (i, _), e in zip(a, ends[0]) if e in at_b]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for number, (side, end) in enumerate(zip((a, b), ends)):
            for (i, _), e in zip(side, end):
                groups[bisect.bisect_left(cuts, e)][number].append(str(i))
        return len(a), len(b), links, ";".join("|".join(map(",".join, g)) for g in groups)


def expected(rows):
    plain = Plain()
    found = [(i, plain.align(t)) for i, t in rows]
    counts = Counter(link for _, x in found if x for link in x[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, groups = x
        top = sum(counts[link] == best[link[1]] for link in links)
        out.append((i, n_a, n_b, groups.count(";") + 1, len(links), top, sum(counts[k] for k in links), sha(groups)))
    return sorted(out)


def test_alignment_equals_brute_force(spark, texts):
    query = token_alignment.op12_token_alignment(spark, SF)
    assert query.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert sorted(map(tuple, query.collect())) == expected(texts)


def test_alignment_outputs_on_odd_texts(spark):
    odd = [None, "", " ", "x", "▁", "a▁b", "<s> <|endoftext|> <0x41>", "naïve 😀😀 ünï\x00", "日本語 text", "a\n\n  b\t", "  "]
    rows = spark.createDataFrame(list(enumerate(odd)), "alignment long, text string")
    rows = rows.selectExpr("text", "alignment AS number", "1 AS links")
    found = token_alignment.aligned(rows, *PATHS, outputs=tuple(token_alignment.OUTPUTS))
    pairs = token_alignment.link_pairs(*PATHS)
    plain = Plain()
    for row in found.collect():
        got, want = row.alignment, plain.align(row.text)
        if want is None:
            assert (got.n_a, got.n_b, got.n_groups, got.groups, got.links, got.overlaps) == (0, 0, 0, "", [], [])
            continue
        assert (got.n_a, got.n_b, got.groups) == (want[0], want[1], want[3])
        assert [(int(pairs[x]) >> 32, int(pairs[x]) & 0xFFFFFFFF) for x in got.links] == want[2]
        starts = [[0, *e[:-1]] for e in (got.ends_a, got.ends_b)]
        meet = [
            (x, y)
            for x in range(got.n_a)
            for y in range(got.n_b)
            if max(starts[0][x], starts[1][y]) < min(got.ends_a[x], got.ends_b[y])
        ]
        assert [tuple(o) for o in got.overlaps] == meet


def test_alignment_of_odd_and_empty_tables(spark, odd, nothing):
    done = token_alignment.scored(token_alignment.aligned(odd, *PATHS), token_alignment.link_pairs(*PATHS))
    assert done.columns == [*odd.columns, "alignment", "scores"]
    got = sorted((r.doc_id or -1, r.alignment.n_a, r.alignment.n_b, r.alignment.n_groups, *r.scores, r.alignment.groups)
                 for r in done.collect())
    want = expected([(r[0] or -1, r[1]) for r in ODD])
    assert [(*g[:-1], sha(g[-1]) if g[1] else "") for g in got] == want
    empty = token_alignment.scored(token_alignment.aligned(nothing, *PATHS), token_alignment.link_pairs(*PATHS))
    assert empty.collect() == []


def test_links_are_counted_and_scored_in_small_slices(spark, texts, monkeypatch):
    sizes, limit = [0, 5, 3, 9, 0, 2, 2], 6
    links = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([links], ["links"])], ["alignment"])
    monkeypatch.setattr(token_alignment, "BATCH_LINKS", limit)
    for whole in (batch, batch.slice(2, 4), batch.slice(7)):
        wanted = whole.column(0).field("links").to_pylist()
        found = []
        for some, offsets, flat in token_alignment.linked(iter([whole]), 0):
            lists = [flat[x:y].tolist() for x, y in zip(offsets, offsets[1:])]
            assert len(flat) <= limit + max(sizes) and some.num_rows == len(lists)
            found += lists
        assert found == wanted


def test_links_do_not_come_back_from_the_scoring_tasks(spark):
    query = token_alignment.op12_token_alignment(spark, SF)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    scoring = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "alignment" not in scoring.split(", [")[-1]


def test_every_linked_pair_is_in_the_table():
    a, b = {0: b"ab", 1: b"b", 2: b"xab", 5: b"c"}, {3: b"b", 4: b" ab", 6: b"b"}
    pairs = {(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in token_alignment.suffix_pairs(a, b)}
    assert pairs == {(x, y) for x in a for y in b if a[x].endswith(b[y]) or b[y].endswith(a[x])}


# ---------------------------------------------------------------- 13


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Longest stretches of each period, that of the smallest period for equal ends."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 4 + 1):
        same = [words[i] == words[i - q] for i in range(q, len(words))] + [False]
        begin = None
        for i, equal in enumerate(same):
            if equal and begin is None:
                begin = i
            elif not equal and begin is not None:
                length = i - begin + q
                if length >= max(6, 4 * q):
                    found.setdefault((begin, length), q)
                begin = None
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs) -> str:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def op13(doc_id, text) -> tuple:
    words = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *longest, sha(listed), sha(collapsed(words, runs)))


def test_find_runs_equals_brute_force():
    random.seed(11)
    for _ in range(2500):
        n, letters = random.randint(0, 100), random.choice([1, 2, 3, 6])
        words = [random.randrange(letters) for _ in range(n)]
        if n > 8 and random.random() < 0.6:
            a = random.randrange(n)
            p = 1 + random.randrange((n - a) // 3 + 1)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        got = periodic_runs.find_runs(np.array(words, np.int64)).tolist()
        assert list(map(tuple, got)) == runs_of(words)


def test_runs_of_a_long_text_of_one_word_and_of_nested_periods():
    assert periodic_runs.find_runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    inner = [0, 0, 0, 0, 0, 0, 1]  # runs of the period 7, with a run of one word in each period
    got = periodic_runs.find_runs(np.array(inner * 6, np.int64)).tolist()
    assert list(map(tuple, got)) == runs_of(inner * 6)
    every_other = np.arange(20_000)
    every_other[::2] = -1  # all even lags match at every other word: no run
    assert len(periodic_runs.find_runs(every_other)) == 0


def test_runs_equal_brute_force(spark, texts):
    query = periodic_runs.op13_periodic_runs(spark, SF)
    assert query.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    mine = sorted(map(tuple, query.collect()))
    assert any(row[1] for row in mine)
    short = [(i, t) for i, t in texts if len(t or "") < 20_000]
    assert len(short) > 190
    kept = {i for i, _ in short}
    assert [r for r in mine if r[0] in kept] == sorted(op13(i, t) for i, t in short)


def test_runs_on_odd_and_empty_tables(spark, odd, nothing):
    clash = odd.selectExpr("*", "'mine' AS runs", "doc_id AS _top")
    found = periodic_runs.periodic_runs(clash)
    assert found.columns == [*odd.columns, "_top", "n_words", "runs", "collapsed"]
    got = sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found.collect())
    want = []
    for row in ODD:
        words = WORDS.findall(row[1] or "")
        runs = [(0, 30_000, 1)] if row[0] == 9 else runs_of(words)
        want.append((row[0] or -1, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(nothing).collect() == []
