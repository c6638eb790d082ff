"""Small table operators: projections, set operations, constants, serving shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import with_table_stats


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Inline constant relation."""
    return spark.createDataFrame(list(rows), schema)


def typed(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Projection with one explicit cast per column."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def rounded(df: DataFrame, digits: int, half_even: bool = True) -> DataFrame:
    """Round every floating column, leave the others."""
    f = F.bround if half_even else F.round
    floating = (T.DoubleType, T.FloatType)
    return df.select(
        *[f(F.col(x.name), digits).alias(x.name) if isinstance(x.dataType, floating) else F.col(x.name) for x in df.schema]
    )


def keep_matching_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition, or every row when none does (one plan, no action)."""
    tagged = df.withColumn("__hit", F.coalesce(condition, F.lit(False)).cast("int"))
    return (
        with_table_stats(tagged, {"__any": F.max("__hit")})
        .where((F.col("__hit") == 1) | (F.col("__any") == 0))
        .drop("__hit", "__any")
    )


def latest_period(df: DataFrame, period: str) -> DataFrame:
    """Rows of the last period."""
    return df.where(F.col(period) == df.agg(F.max(period)).scalar())


def stack_rows(*parts: DataFrame) -> DataFrame:
    """Union by name; columns missing in a part become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def metrics_to_rows(row: DataFrame, metrics: Sequence[str], name: str, value: str) -> DataFrame:
    """One wide row of figures as (name, value) rows."""
    return row.unpivot([], list(metrics), name, value)


SHARE_ROWS = 250_000


def spread_distinct(df: DataFrame) -> DataFrame:
    """Distinct rows, found by tasks that each hold a bounded share of them.

    A plain ``distinct`` first collects in a table what a task reads, which for a well compressed file
    are many millions of rows. Here the rows are dealt before; the number of tasks follows the rows.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, df.count() // SHARE_ROWS + 1), *df.columns).distinct()


def edge_ends(edges: DataFrame, first: str, second: str, id_col: str, carry: Sequence[str]) -> DataFrame:
    """Both ends of an edge list under one id column."""
    a = edges.select(F.col(first).alias(id_col), *carry)
    return a.unionByName(edges.select(F.col(second).alias(id_col), *carry))


def missing_from(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected rows without a counterpart."""
    return expected.join(present.select(*on).distinct(), list(on), "left_anti")


def split_list(df: DataFrame, column: str, out: str, separator: str = ";") -> DataFrame:
    """One row per entry of a delimited text list."""
    return df.withColumn(out, F.explode(F.split(F.col(column), separator)))


def pivot_mean(
    df: DataFrame, rows: Sequence[str], across: str, values: Sequence[str], measure: str, fill: float = 0.0
) -> DataFrame:
    """Mean of ``measure`` per row key and column label; empty cells are filled.

    The labels are given, so no extra job looks for them.
    """
    return df.groupBy(*rows).pivot(across, list(values)).agg(F.avg(measure)).fillna(fill, list(values))


def _code(c: Column, kind: T.DataType) -> Column:
    """Canonical text of a value: a letter for its type and digits, or a text behind its length in bytes.

    Floating point is written as three whole numbers: its floor, and twice 53 binary digits of the
    rest. No part depends on how an engine prints numbers or dates.
    """
    text = F.lit
    if isinstance(kind, T.StringType):
        out = F.concat(text("s"), F.octet_length(c).cast("string"), text(":"), c)
    elif isinstance(kind, T.IntegralType):
        out = F.concat(text("i"), c.cast("string"))
    elif isinstance(kind, T.BooleanType):
        out = F.when(c, "b1").when(~c, "b0")
    elif isinstance(kind, T.DateType):
        out = F.concat(text("d"), F.unix_date(c).cast("string"))
    elif isinstance(kind, T.TimestampType):
        out = F.concat(text("t"), F.unix_micros(c).cast("string"))
    elif isinstance(kind, T.TimestampNTZType):
        out = F.concat(text("t"), F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")).cast("string"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        x = c.cast("double")
        fine = (x - F.floor(x)) * BINARY_DIGITS
        parts = [F.floor(v).cast("string") for v in (x, fine, (fine - F.floor(fine)) * BINARY_DIGITS)]
        out = F.when(F.isnan(x), "fn").when(F.abs(x) == float("inf"), F.when(x > 0, "f+").otherwise("f-")).otherwise(
            F.concat(text("f"), parts[0], text(","), parts[1], text(","), parts[2])
        )
    elif isinstance(kind, T.DecimalType):
        out = F.concat(text("m"), c.cast("string"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: _code(x, kind.elementType))
        out = F.concat(text("a"), F.size(c).cast("string"), text(":"), F.array_join(items, ""))
    else:
        out = F.concat(text("j"), F.octet_length(F.to_json(c)).cast("string"), text(":"), F.to_json(c))
    return F.coalesce(out, F.lit("n"))


BINARY_DIGITS = float(2**53)


def row_code(df: DataFrame) -> Column:
    """Canonical text of a row: its values by the names of their columns."""
    return F.concat(*[_code(F.col(f"`{f.name}`"), f.dataType) for f in sorted(df.schema, key=lambda f: f.name)])


def fingerprint(df: DataFrame, out: str = "fingerprint") -> DataFrame:
    """Order-free content fingerprint of a table and its row count.

    Rows are hashed where they are read. All 256 bits count: eight 32-bit lanes are summed apart,
    which is all that travels, and the sums are hashed once more. Any engine that writes
    ``row_code`` gets the same.
    """
    row = F.sha2(row_code(df), 256)
    lanes = [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)) for k in range(8)]
    joined = F.concat_ws(",", *[lane.cast("string") for lane in lanes])
    return df.agg(F.sha2(joined, 256).alias(out), F.count("*").alias("filas"))
