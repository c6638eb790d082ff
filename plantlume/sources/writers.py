"""Sinks."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import top_rows
from ..operators.tables import fingerprint, stack_rows
from .readers import TIMESTAMPS


def materialize(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace a Parquet table and read it back with its schema."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def publish_views(objects: Mapping[str, DataFrame]) -> None:
    """Session views, for SQL on top of the plans."""
    for name, df in objects.items():
        df.createOrReplaceTempView(name)


@dataclass(frozen=True)
class Published:
    """A version of an exported table: where it is, and what it holds."""

    name: str
    version: str
    path: str
    filas: int
    fingerprint: str
    fmt: str


def publish(
    df: DataFrame, root: str, name: str, version: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
    order: Sequence[Column] = (),
) -> Published:
    """Write a version of a table so that readers see all of it or nothing.

    The rows go to a staging folder, are read back, and must have the row count and fingerprint of
    ``df``; only then the folder gets its name and the manifest its entry. A version that the
    manifest has is not written again, so a rerun after a failure at any point ends in the same
    state. Empty texts come back as NULL from CSV and count as such. ``order`` sorts the rows
    globally over part files whose names follow it.
    """
    spark = df.sparkSession
    known = _entry(spark, root, name, version)
    if known:
        return known
    staging, final = f"{root}/{name}/_staging-{uuid.uuid4().hex}", f"{root}/{name}/version={version}"
    rows = df.orderBy(*order) if order else df
    writer = rows.write.mode("overwrite").partitionBy(*partition_by).option("timestampNTZFormat", TIMESTAMPS)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(staging)
    kept = df if fmt != "csv" else df.select(*[F.nullif(c, F.lit("")).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes])
    want, got = (fingerprint(x).first() for x in (kept, _read(spark, staging, df, fmt)))
    fs, path = _fs(spark, root)
    if (want["filas"], want["fingerprint"]) != (got["filas"], got["fingerprint"]):
        fs.delete(path(staging), True)
        raise ValueError(f"{name}: {got['filas']} rows written, {want['filas']} expected, or their contents differ")
    fs.delete(path(final), True)  # left by a run that failed before its entry was written
    if not fs.rename(path(staging), path(final)):
        raise OSError(f"{name}: {final} could not be published")
    entry = Published(name, version, final, want["filas"], want["fingerprint"], fmt)
    line = spark.createDataFrame([(json.dumps(asdict(entry)),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{root}/_manifest/{name}/{version}")
    return entry


def _fs(spark: SparkSession, root: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(root).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _entry(spark: SparkSession, root: str, name: str, version: str) -> Published | None:
    fs, path = _fs(spark, root)
    at = f"{root}/_manifest/{name}/{version}"
    if not fs.exists(path(f"{at}/_SUCCESS")):
        return None
    return Published(**json.loads(spark.read.text(at).first()[0]))


def _read(spark: SparkSession, path: str, like: DataFrame, fmt: str) -> DataFrame:
    reader = spark.read.schema(like.schema).option("timestampNTZFormat", TIMESTAMPS)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path).select(*like.columns)


def read_published(spark: SparkSession, root: str, name: str, version: str, like: DataFrame) -> DataFrame:
    """The rows of a published version, with the schema of ``like``."""
    entry = _entry(spark, root, name, version)
    if entry is None:
        raise ValueError(f"{name} has no version {version}")
    return _read(spark, entry.path, like, entry.fmt)


def export(objects: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    """Write several objects, each below its own folder."""
    for name, df in objects.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{root}/{name}")


def export_ordered(df: DataFrame, path: str, order: Sequence[Column]) -> None:
    """Globally ordered CSV: range-sorted part files whose names follow the order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def export_by_profile(objects: Mapping[str, DataFrame], root: str, key: str = "sector_profile_id") -> None:
    """One partitioned table per object; all profiles are written by the same job."""
    for name, df in objects.items():
        df.write.mode("overwrite").partitionBy(key).parquet(f"{root}/{name}")


def export_json(document: DataFrame, path: str) -> None:
    """Nested serving documents as JSON lines."""
    document.write.mode("overwrite").json(path)


def sample_head(df: DataFrame, order: Sequence[Column], rows: int) -> DataFrame:
    """The first rows by key, a reproducible sample."""
    return top_rows(df, order, rows)


def sample_manifest(samples: Mapping[str, DataFrame]) -> DataFrame:
    """Name, rows and columns of every sample."""
    return stack_rows(
        *[
            df.agg(F.count("*").alias("filas")).select(
                F.lit(name).alias("muestra"), "filas", F.lit(len(df.columns)).alias("columnas")
            )
            for name, df in samples.items()
        ]
    )
