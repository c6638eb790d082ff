"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plantlume", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans expect: UTC wall clock, AQE with skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where master and executors are one machine may it be unset; a temporary folder serves then.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="plantlume-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
COMPILED_BYTES = 8000


@contextmanager
def compiled_code(spark: SparkSession) -> Iterator[None]:
    """Plans run inside with generated code that the JVM compiles.

    The JVM compiles no method above 8000 bytes and interprets it row by row. Spark's own limit is
    65535; below this one the columns of a wide table are computed in many small methods instead.
    """
    before = spark.conf.get(HUGE_METHOD)
    spark.conf.set(HUGE_METHOD, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(HUGE_METHOD, before)


# Paths of stored tables that exist, by the scope that owns them; the outermost scope is the session.
_SCOPES: list[dict[str, SparkSession]] = [{}]


def durable(df: DataFrame, name: str = "stage", folder: str = "plantlume", codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one scan, and keeps column pruning and
    filter pushdown for the readers. The innermost ``stored_tables`` scope owns the table; without
    one it stays until ``release`` or the end of the process.
    """
    spark = df.sparkSession
    path = os.path.join(durable_dir(spark), folder, f"{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("overwrite")
    _SCOPES[-1][path] = spark  # owned before it is written: a failed write leaves nothing either
    with compiled_code(spark):
        (writer.option("compression", codec) if codec else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def is_stored(df: DataFrame) -> bool:
    """Is ``df`` a table of ``durable`` that still exists?"""
    path = getattr(df, "_stored_at", None)
    return any(path in owned for owned in _SCOPES)


def _delete(owned: dict[str, SparkSession], paths: list[str]) -> None:
    for path in paths:
        spark = owned.pop(path)
        if spark.sparkContext._jsc is None:  # stopped: its folder is out of reach
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``durable`` that nothing reads any more; other DataFrames are left alone.

    What was written from them stands on its own. DataFrames still to be run must not read them.
    """
    for df in tables:
        path = getattr(df, "_stored_at", None)
        for owned in _SCOPES:
            if path in owned:
                _delete(owned, [path])


@contextmanager
def stored_tables() -> Iterator[None]:
    """Scope that owns the tables stored inside it and deletes them at its end, also after an error.

    Results must be collected or written before the scope ends, or be passed to ``keep``.
    """
    _SCOPES.append({})
    try:
        yield
    finally:
        owned = _SCOPES.pop()
        _delete(owned, list(owned))


def keep(df: DataFrame) -> DataFrame:
    """Hand the stored table ``df`` to the scope outside the innermost one."""
    path = getattr(df, "_stored_at", None)
    if len(_SCOPES) > 1 and path in _SCOPES[-1]:
        _SCOPES[-2][path] = _SCOPES[-1].pop(path)
    return df


@atexit.register
def _leave_nothing() -> None:
    for owned in _SCOPES:
        try:
            _delete(owned, list(owned))
        except Exception:  # noqa: BLE001 - the JVM may be gone; its temporary folder goes with the machine
            owned.clear()


def inputs_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of every file behind ``paths``; changes when an input is rewritten."""
    found = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)]
    return tuple(sorted(found))
