"""Every registered query against its SQL oracle, and the shape of its plan."""

from __future__ import annotations

import os
import sys

import pytest

from __spark_entry__ import entry
from fleetmetrics.workload.oracle import ORACLES
from fleetmetrics.workload.queries import QUERIES

from .compare import connect, difference, oracle_result, spark_result

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
EAGER = (
    "curate_roundtrip",
    "incremental_roundtrip",
    "published_roundtrip",
    "live_stream",
    "baseline_from_states",
    "monthly_from_states",
    "landed_summary",
    "raw_objects",
    "payload_regions",
    "registered_hours",
    "described_members",
    "described_instances",
    "described_clusters",
    "observed_batches",
    "variant_guard",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    mine = spark_result(spark, QUERIES[name], SF_DIR)
    assert mine[1], "no rows"
    assert difference(mine, oracle_result(con, ORACLES[name])) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_plan_has_no_python_and_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoop"):
        assert node not in plan


def test_entry(spark):
    df = entry(spark)
    assert {"resource_id", "cpu_avg", "cpu_avg_baseline", "cpu_deviation"} <= set(df.columns)
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_library_queries_stay_when_a_package_of_the_others_is_missing(monkeypatch):
    import __spark_entry__ as entry_module

    for name in [n for n in sys.modules if n.startswith("fleetmetrics.llm")]:
        monkeypatch.delitem(sys.modules, name)
    for missing in ("zstandard", "pyarrow", "tiktoken"):
        monkeypatch.setitem(sys.modules, missing, None)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())
