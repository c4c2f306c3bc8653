from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fleetmetrics import top_sql, top_sql_overview
from fleetmetrics.functions.text import top_sql_line
from fleetmetrics.operators.inventory import load_enabled_split
from fleetmetrics.operators.topsql import (
    attach_findings,
    average_load,
    normalize_findings,
    top_statements,
    total_load,
    truncate_statements,
    with_display_text,
)
from fleetmetrics.schemas import FINDINGS, INSTANCES, SQL_LOAD

from .helpers import ACCOUNT, REGION, at, curated, inventory, rows_of

NOW = at("2026-08-20T12:00:00")


def load(spark, rows):
    return spark.createDataFrame(
        [(r, NOW - timedelta(minutes=m), q, f"select {q}", float(v)) for r, m, q, v in rows], SQL_LOAD
    )


def test_average_counts_samples_without_the_statement(spark):
    samples = load(spark, [("a", 1, "q1", 2), ("a", 1, "q2", 1), ("a", 2, "q1", 1), ("a", 3, "q2", 3), ("b", 1, "q1", 5)])
    rows = {(r.resource_id, r.sql_id): r.avg_active_sessions for r in average_load(samples).collect()}
    assert rows == {("a", "q1"): 1.0, ("a", "q2"): round(4 / 3, 4), ("b", "q1"): 5.0}
    given = {(r.resource_id, r.sql_id): r.avg_active_sessions for r in average_load(samples, 10).collect()}
    assert given["a", "q1"] == 0.3


def test_rank_ties_and_k(spark):
    samples = load(spark, [("a", 1, f"q{i}", 1 if i < 5 else i) for i in range(9)])
    ranked = top_sql(samples, NOW, k=6).orderBy("rank").collect()
    assert [(r.rank, r.sql_id) for r in ranked] == [(1, "q8"), (2, "q7"), (3, "q6"), (4, "q5"), (5, "q0"), (6, "q1")]
    assert sum(r.load_share for r in ranked) == pytest.approx(1, abs=1e-3)


def test_window_bounds_and_lookback(spark):
    samples = load(spark, [("a", 0, "now", 1), ("a", 9, "in", 1), ("a", 10, "edge", 1), ("a", -1, "later", 1)])
    assert sorted(r.sql_id for r in top_sql(samples, NOW).collect()) == ["in", "now"]
    with pytest.raises(ValueError):
        top_sql(samples, NOW, lookback_minutes=0)


def test_total_load_and_idle(spark):
    samples = load(spark, [("busy", 1, "q1", 3), ("busy", 1, "q2", 0.5), ("idle", 1, "q1", 0.25)])
    totals = rows_of(total_load(top_sql(samples, NOW)), "resource_id", "total_active_sessions", "ranked_statements", "load_note")
    assert totals == [("busy", 3.5, 2, None), ("idle", 0.25, 1, "idle")]


def test_truncation_edges(spark):
    texts = {"none": None, "fits": "x" * 1200, "cut": "é" * 1201, "emoji": "😀" * 1201, "empty": ""}
    df = spark.createDataFrame(list(texts.items()), "id string, sql_text string")
    rows = {r.id: r for r in with_display_text(truncate_statements(df)).collect()}
    assert (rows["none"].sql_text, rows["none"].sql_text_truncated) == (None, False)
    assert (rows["fits"].sql_text, rows["fits"].sql_text_truncated) == ("x" * 1200, False)
    assert rows["fits"].display_text == "x" * 400 + "…" and rows["fits"].display_shortened
    assert (rows["cut"].sql_text, rows["cut"].sql_text_truncated) == ("é" * 1200 + "…", True)
    assert rows["emoji"].sql_text == "😀" * 1200 + "…"
    assert not rows["empty"].display_shortened and not rows["none"].display_shortened


def findings(spark, entries):
    return spark.createDataFrame([("overall", entries)], FINDINGS)


def test_findings_are_normalized(spark):
    df = findings(
        spark,
        [
            ("a", "2", "slow scan", "add index", "high"),
            ("a", "first", "x", None, None),
            (None, "1", "x", None, None),
            ("a", "1", "  ", None, None),
            (" a ", "3", " y ", None, None),
            ("a", "0", "x", None, None),
            ("a", "3.0", "x", None, None),
            ("a", None, "x", None, None),
        ],
    )
    assert rows_of(normalize_findings(df), "resource_id", "rank", "finding", "suggestion", "confidence") == [
        ("a", 2, "slow scan", "add index", "high"),
        ("a", 3, "y", "", "low"),
    ]


def test_numeric_ranks_are_cut_to_integers(spark):
    note = "struct<resource_id:string,rank:double,finding:string,suggestion:string,confidence:string>"
    lists = [("o", [("a", 3.7, "x", None, None), ("a", 0.9, "x", None, None), ("a", None, "x", None, None)])]
    df = spark.createDataFrame(lists, f"overall string, queries array<{note}>")
    assert rows_of(normalize_findings(df), "resource_id", "rank") == [("a", 3)]


def test_last_finding_of_a_statement_stands(spark):
    notes = normalize_findings(findings(spark, [("a", "1", "z first", "s", "high"), ("a", "1", "a last", "s", "low")]))
    ranked = spark.createDataFrame([("a", 1, False)], "resource_id string, rank int, sql_text_truncated boolean")
    (row,) = attach_findings(ranked, notes).collect()
    assert (row.finding, row.confidence) == ("a last", "low")


def test_load_split_by_account_and_region(spark):
    entry = {"identifier": "db-a", "region": "r1", "performance_insights_enabled": True}
    instances = spark.createDataFrame(
        [
            {**{f: None for f in INSTANCES.fieldNames()}, **entry, "account_id": account, "dbi_resource_id": source}
            for account, source in (("1", "db-ONE"), ("2", "db-TWO"))
        ],
        INSTANCES,
    )
    asked = spark.createDataFrame([("1", "r1", "db-a"), ("2", "r1", "db-a"), ("2", "r2", "db-a")], "account_id string, region string, resource_id string")
    found = {(r.account_id, r.region): r.dbi_resource_id for r in load_enabled_split(asked, instances).collect()}
    assert found == {("1", "r1"): "db-ONE", ("2", "r1"): "db-TWO", ("2", "r2"): None}


def test_findings_never_attach_to_another_rank(spark):
    samples = load(spark, [("a", 1, f"q{i}", 10 - i) for i in range(3)] + [("b", 1, "q0", 1)])
    notes = findings(spark, [("a", "2", "f", "s", "medium"), ("a", "9", "gone", "", "high"), ("c", "1", "gone", "", "high")])
    rows = {(r.resource_id, r["rank"]): r for r in top_sql(samples, NOW, findings=notes).collect()}
    assert len(rows) == 4
    assert (rows["a", 2].finding, rows["a", 2].confidence_label) == ("f", "가능성 보통")
    assert all(rows[k].finding is None for k in rows if k != ("a", 2))


def test_truncated_statement_caps_confidence(spark):
    ranked = top_statements(
        spark.createDataFrame([("a", "q", "x" * 2000, 1.0)], "resource_id string, sql_id string, sql_text string, avg_active_sessions double")
    )
    note = normalize_findings(findings(spark, [("a", "1", "f", "s", "high")]))
    row = attach_findings(ranked, note).first()
    assert (row.confidence, row.capped_confidence) == ("high", "low")


def test_load_enabled_split(spark):
    def instance(name, enabled, dbi):
        return (ACCOUNT, REGION, 0, name, dbi, "mysql", "1", "c", "a", "available", False, "gp3", enabled, None, None)

    instances = spark.createDataFrame(
        [instance("on", True, "db-A"), instance("off", False, "db-B"), instance("noid", True, None)], INSTANCES
    )
    ids = spark.createDataFrame([("on",), ("off",), ("noid",), ("unknown",)], "resource_id string")
    assert rows_of(load_enabled_split(ids, instances), "resource_id", "dbi_resource_id", "has_load") == [
        ("noid", None, False), ("off", None, False), ("on", "db-A", True), ("unknown", None, False),
    ]


def test_overview_says_why_there_is_no_load(spark):
    _, _, instances = inventory(spark, {"c": ["a", "quiet"]})
    samples = load(spark, [("a", 1, "q1", 2), ("off", 1, "q1", 2)])
    metrics = curated(spark, [("a", "mysql", "writer", "CPUUtilization", NOW, 42)])
    df = top_sql_overview(samples, metrics, instances, ACCOUNT, REGION, ["off", "quiet", "a"], NOW)
    assert [(r.resource_id, r.load_status, r.total_active_sessions, r.cpu_avg) for r in df.orderBy("position").collect()] == [
        ("off", "not_enabled", None, None), ("quiet", "no_load_data", None, None), ("a", "ok", 2.0, 42.0),
    ]


def test_line(spark):
    df = top_sql(load(spark, [("a", 1, "q1", 2)]), NOW)
    assert top_sql_line(df).first().line == (
        "[a] Top SQL #1: avg_active_sessions=2.0, sql_id=q1, sql_text_truncated=false, sql_text=select q1"
    )
    assert F is not None


def test_finding_documents_keep_the_type_of_a_rank(spark):
    from fleetmetrics.operators.topsql import normalize_finding_documents

    ranks = ["3.7", '"3.7"', '" 2 "', "4", "null", "true", '"first"', "0.9", "[1]", '"-1"']
    texts = ['{"queries": [{"resource_id": "r%d", "rank": %s, "finding": " f "}]}' % (n, rank) for n, rank in enumerate(ranks)]
    texts += ['{"queries": [{"resource_id": "gone", "finding": "no rank"}, 7, "x", {"resource_id": 0, "rank": 1, "finding": "f"}]}']
    texts += ['{"queries": null}', "{}", '{"queries": [{"resource_id": 12, "rank": 1, "finding": 5, "confidence": ""}]}']
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("parse_json(text) AS document")
    got = rows_of(normalize_finding_documents(rows), "resource_id", "rank", "finding", "confidence")
    assert got == [("12", 1, "5", "low"), ("r0", 3, "f", "low"), ("r2", 2, "f", "low"), ("r3", 4, "f", "low"), ("r5", 1, "f", "low")]
