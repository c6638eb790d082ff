"""Registered queries against their SQL on the driver tables (``ALL_QUERIES=1`` runs every one)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from plantlume.workload.roles import SOURCES
from tools.check import plain

QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
QUICK = (
    "line_hour", "equipment_day", "line_shift", "plant_week", "top_lines_by_loss", "global_criticality", "stop_hours_by_shift",
    "scored_line_days", "equipment_anomaly_scores", "line_criticality_scores", "rank_correlation_of_item_measures",
    "scenario_table", "scenario_ranking", "portfolio_selection", "investment_prioritization", "issue_log", "contract_checks",
    "readiness_summary", "lineage_levels", "recommendation_trace", "sector_benchmark", "headline_figures",
    "quantity_quantiles_by_supplier", "supplier_daily_trend", "order_value_positions", "claim_patterns_in_documents",
)
NAMES = sorted(ORACLES) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def sf_dir():
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("driver tables not available")
    return path


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in SOURCES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUICK) <= set(ORACLES)


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(v) for v in r) for r in df.select(*cols).collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    want = sorted("|".join(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want
