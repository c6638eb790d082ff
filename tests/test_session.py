"""Life of stored tables: owned by scopes, gone when released, layers follow their input files."""

import os
import shutil

import pytest

from plantlume import session
from plantlume.workload import all_queries
from plantlume.workload.layers import Layers


def tables_in(spark):
    root = os.path.join(session.durable_dir(spark), "plantlume")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_scope_deletes_its_tables(spark):
    before = tables_in(spark)
    with session.stored_tables():
        a = session.durable(spark.range(5), "a")
        with session.stored_tables():
            b = session.durable(a.selectExpr("id + 1 AS id"), "b")
            c = session.keep(session.durable(b, "c"))
            assert len(tables_in(spark) - before) == 3
        assert session.is_stored(a) and not session.is_stored(b) and c.count() == 5
        session.release(a, spark.range(3))
        assert not session.is_stored(a) and len(tables_in(spark) - before) == 1
    assert tables_in(spark) == before


def test_scope_deletes_after_an_error(spark):
    before = tables_in(spark)
    with pytest.raises(ZeroDivisionError), session.stored_tables():
        session.durable(spark.range(2), "lost")
        1 / 0  # noqa: B018
    assert tables_in(spark) == before


def test_query_leaves_nothing(spark, sf_dir):
    before = tables_in(spark)
    with session.stored_tables():
        first = all_queries()["plant_week"](spark, sf_dir).collect()
        assert tables_in(spark) > before
    assert tables_in(spark) == before
    with session.stored_tables():  # the cached layers of the first run are gone and built again
        assert sorted(map(str, all_queries()["plant_week"](spark, sf_dir).collect())) == sorted(map(str, first))


def test_rewritten_input_is_read_anew(spark, sf_dir, tmp_path):
    for name in ("events", "nation", "region"):
        source = f"{sf_dir}/{name}.parquet"
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / f"{name}.parquet")
    with session.stored_tables():
        whole = Layers(spark, str(tmp_path)).stored("line_hour")
        n = whole.count()
        assert Layers(spark, str(tmp_path)).stored("line_hour") is whole
        half = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 2 = 0").toPandas()
        half.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
        spark.catalog.clearCache()
        assert 0 < Layers(spark, str(tmp_path)).stored("line_hour").count() < n


def test_tables_are_written_by_code_that_the_jvm_compiles(spark, monkeypatch):
    """Methods above 8000 bytes would be interpreted; the caller's setting is back afterwards, also after an error."""
    from pyspark.sql import functions as F
    from pyspark.sql.readwriter import DataFrameWriter

    from plantlume.session import HUGE_METHOD, durable, release

    before, write, seen = spark.conf.get(HUGE_METHOD), DataFrameWriter.parquet, []

    def noted(self, path, *args, **kwargs):
        seen.append(int(spark.conf.get(HUGE_METHOD)))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    release(durable(spark.range(3)))
    with pytest.raises(Exception, match="no such row"):
        durable(spark.range(3).select(F.raise_error(F.lit("no such row")).alias("x")))
    assert seen == [8000, 8000] and spark.conf.get(HUGE_METHOD) == before


def test_structural_checks_count_without_wide_tables(spark, sf_dir):
    with session.stored_tables():
        before = tables_in(spark)
        planned = all_queries()["structural_checks"](spark, sf_dir).collect()
        assert {name.rpartition("-")[0] for name in tables_in(spark) - before} <= {"value_pool"}
        for name in ("scored_line_days", "equipment_scores", "scenario_table"):
            Layers(spark, sf_dir).stored(name)
        assert all_queries()["structural_checks"](spark, sf_dir).collect() == planned  # now from the written tables
