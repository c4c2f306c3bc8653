"""The stages of the pipeline, each against what its operator says of its own input."""

from __future__ import annotations

import os

import corpus_pipeline as pipeline
from fleetmetrics.llm import line_dedup, ngram_join
from fleetmetrics.llm.common import staged

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
        if name == "line_dedup":
            assert line_dedup.repeated_lines(docs).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "ngram_jaccard_join":
            assert ngram_join.similar_documents(docs).where("n_links > 0").count() == 0
    tokens = pipeline.encode_tokens(spark, docs, SF)
    assert tokens.count() == docs.count()
    assert tokens.where("NOT round_trip OR n_tokens <> size(ids)").count() == 0


def test_odd_and_empty_tables(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), name)
            if name != "bpe":
                assert docs.columns == odd.columns
