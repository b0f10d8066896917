"""Every registered query against its SQL, and a look at the plans."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import TABLES, rows_of
from workload.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
WITH_PYTHON = {"sentiment_ml"}
RUN_AT_BUILD = {
    name for name in QUERIES
    if name.startswith(("stream_", "table_", "quality_")) or name in
    {"parquet_sink", "export_sample", "append_records", "outcome_prediction", "model_metrics",
     "agent_performance", "contact_sequence", "checkout_funnel", "keyed_load", "keyed_load_report",
     "stored_feedback"}
}


@pytest.fixture(scope="module")
def database():
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return db


def test_entry(spark):
    assert entry(spark).count() > 0


def test_all_are_registered():
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, database, name):
    df = QUERIES[name](spark, SMALL)
    want = database.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUN_AT_BUILD))
def test_plan(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("EvalPython" in plan or "ArrowEval" in plan) == (name in WITH_PYTHON)


@pytest.mark.parametrize("name", [
    "leads_profile", "lead_signals", "conversations_enriched", "lead_scoring", "personas", "campaign_roi",
    "sentiment", "silence_gaps", "early_features", "fcr_summary",
])
def test_one_scan(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
