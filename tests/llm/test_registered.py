"""Every registered query of the training-data operators on the smallest driver tables, against its SQL where there is one."""

import os

import duckdb
import pytest

from plantlume import llm
from plantlume.workload.roles import SOURCES
from tools.check import plain

ORACLES = llm.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in SOURCES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query_runs_and_equals_sql(spark, con, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(v) for v in r) for r in df.select(*cols).collect())
    if name not in ORACLES:
        assert got
        return
    rel = con.sql(ORACLES[name])
    order = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted("|".join(plain(r[i]) for i in order) for r in rel.fetchall())
