"""No group of documents is lost, and no column of the user's, whatever its name."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from fleetmetrics.llm import line_dedup, mixing, ngram_join, suffix_dedup

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASHING = ["_n_dropped", "_kept", "_spans", "spans", "a.b", "_check", "_doc", "check", "doc", "row", "first", "label", "keep", "alone"]


def text(word: str, last: str = "") -> str:
    return " ".join(f"{word}{i}" for i in range(60)) + last


@pytest.fixture
def clashing(spark):
    rows = spark.createDataFrame(
        [(i, text("same" if i < 3 else f"w{i}-") + "\na line that three documents share here", "en", "a", 10) for i in range(6)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for n, name in enumerate(CLASHING):
        rows = rows.withColumn(name, F.concat(F.lit(f"{n}-"), "doc_id"))
    return rows


def user_columns(df):
    return sorted(tuple(r[c] for c in ("doc_id", *CLASHING)) for r in df.collect())


def test_operators_keep_clashing_columns(clashing):
    before = user_columns(clashing)
    cut = suffix_dedup.without_repeats(clashing, suffix_dedup.repeated_spans(clashing))
    assert user_columns(cut) == before
    rest = clashing.drop("_kept", "_n_dropped")
    applied = line_dedup.apply_bitmaps(rest, line_dedup.keep_bitmaps(rest))
    assert applied.columns == [*rest.columns, "_kept", "_n_dropped"] and applied.count() == 6
    kept = ngram_join.one_of_each(clashing, ngram_join.similar_documents(clashing))
    assert kept.columns == clashing.columns
    assert user_columns(kept) == [r for r in before if r[0] in (0, 3, 4, 5)]
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns and set(user_columns(mixed)) <= set(before)


def test_stages_keep_clashing_columns(spark, clashing):
    before = user_columns(clashing)
    dropped = pipeline.drop_repeated_lines(spark, clashing, SF)
    assert dropped.columns == clashing.columns and user_columns(dropped) == before
    lines = {r.doc_id: r.text.count("\n") for r in dropped.collect()}
    assert lines == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    for stage in (pipeline.keep_quality, pipeline.drop_near_duplicates, pipeline.mix_sources):
        after = stage(spark, clashing, SF)
        assert after.columns == clashing.columns and set(user_columns(after)) <= set(before)


def test_one_row_of_every_group_stays(spark):
    """Groups that share an id, groups without ids, and rows without shingles."""
    a, b, c = text("a"), text("b"), text("c")
    rows = [
        (1, a), (1, b), (2, text("a", " more")), (3, text("b", " more")),  # two groups, least id 1 in both
        (None, c), (None, text("c", " more")), (None, text("c", " less")),  # a group without ids
        (7, "short"), (7, "short"), (7, ""), (None, None), (8, text("d")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in ngram_join.one_of_each(docs, ngram_join.similar_documents(docs)).collect()]
    assert sorted(t for i, t in kept if i == 1) == [a, b]
    assert not [i for i, _ in kept if i in (2, 3)]
    assert len([t for i, t in kept if i is None and t and t.startswith("c0")]) == 1
    assert sorted(t for i, t in kept if i == 7) == ["", "short"]
    assert (None, None) in kept and len([i for i, _ in kept if i == 8]) == 1 and len(kept) == 7
