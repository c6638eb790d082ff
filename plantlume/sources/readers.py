"""Scans. Every source has a fixed schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.tables import stack_rows
from . import schemas


def _schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(schemas.RAW_TABLES[table][0])


REJECTED = "rejected_record"
TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def read_checked(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", **options: object
) -> tuple[DataFrame, DataFrame]:
    """Records that fit the schema, and those that don't, as they were read (``REJECTED``), from CSV or JSON.

    A field that can't be parsed or a wrong number of fields rejects the whole record; nothing is
    lost: every record is in one of the two. All columns are parsed whatever is read later, so
    pruning columns can't turn a bad record into a good one.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    checked = T.StructType([*fields.fields, T.StructField(REJECTED, T.StringType())])
    reader = spark.read.schema(checked).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED)
    if fmt == "csv":
        reader = reader.option("header", True).option("columnPruning", False).option("timestampNTZFormat", TIMESTAMPS)
    else:
        reader = reader.option("timestampNTZFormat", TIMESTAMPS)
    for key, value in options.items():
        reader = reader.option(key, value)
    # Always true, but it names all columns: a reader parses only what is asked for.
    read = F.hash(*fields.names) >= F.lit(-(2**31))
    rows = reader.format(fmt).load(path).where(read)
    return rows.where(F.col(REJECTED).isNull()).drop(REJECTED), rows.where(F.col(REJECTED).isNotNull())


def read_staged(spark: SparkSession, root: str, table: str) -> tuple[DataFrame, DataFrame]:
    """A raw CSV table after staging, and its rejected records with the name of the table."""
    good, bad = read_checked(spark, f"{root}/{table}.csv", _schema(table))
    return stage(good, table), bad.select(F.lit(table).alias("tabla"), REJECTED)


def staging_report(spark: SparkSession, root: str, tables: Iterable[str]) -> DataFrame:
    """Good and rejected records of every table: ``tabla, good, rejected``."""
    parts = []
    for table in tables:
        good, bad = read_staged(spark, root, table)
        marks = good.select(F.lit(1).alias("g")).unionByName(bad.select(F.lit(0).alias("g")))
        parts.append(
            marks.agg(F.count_if(F.col("g") == 1).alias("good"), F.count_if(F.col("g") == 0).alias("rejected"))
            .select(F.lit(table).alias("tabla"), "good", "rejected")
        )
    return stack_rows(*parts)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header row and a fixed schema; dates and timestamps are parsed by it."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_raw(spark: SparkSession, root: str, table: str, fmt: str = "csv") -> DataFrame:
    """One raw table with its typed columns, from CSV or Parquet."""
    schema = _schema(table)
    if fmt == "csv":
        df = read_csv(spark, f"{root}/{table}.csv", schema)
    else:
        df = spark.read.format(fmt).load(f"{root}/{table}")
    return stage(df, table)


def stage(df: DataFrame, table: str, present_only: bool = False) -> DataFrame:
    """Cast list of a raw table; an empty equipment id of an initiative becomes NULL.

    ``present_only`` passes over columns that the source does not have.
    """
    fields = [f for f in _schema(table) if not present_only or f.name in df.columns]
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
    if table == "iniciativas_mejora":
        out = out.withColumn("equipo_id", F.nullif("equipo_id", F.lit("")))
    return out


def read_all(
    spark: SparkSession, root: str, tables: Iterable[str] = tuple(schemas.RAW_TABLES), fmt: str = "csv"
) -> dict[str, DataFrame]:
    """Named lazy scans."""
    return {t: read_raw(spark, root, t, fmt) for t in tables}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON documents (one per file, globs allowed)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
