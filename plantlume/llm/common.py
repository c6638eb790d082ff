"""Shared pieces of the training-data operators: Arrow passes, stored tables, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import durable

BATCH_ROWS = 10_000
BATCH_BYTES = 8 << 20

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
SPACES = b" \t\n\x0b\x0c\r"

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches small enough for texts of any length.

    The session's Arrow batch limits are lowered to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes,
    so that a Python worker holds a few megabytes of text at a time.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it back.

    The copy survives lost executors, and row numbers or sampled borders in it can't change
    between two readers. ``release`` deletes it once it has been read for the last time.
    """
    return durable(df, name, "llm", "zstd")


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, null where it is null."""
    return column.cast(pa.binary()).to_pylist()


def columns_of(schema: pa.Schema, **values) -> pa.RecordBatch:
    """A batch of ``schema`` from one list or array per column."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=schema.field(k).type) for k, v in values.items()],
        schema=pa.schema([schema.field(k) for k in values]),
    )


def row_numbers(start: int, n: int) -> range:
    """Numbers of ``n`` rows of this task; unlike those of all other tasks of the stage."""
    base = (TaskContext.get().partitionId() << 36) + start
    return range(base, base + n)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in schema.fields])
