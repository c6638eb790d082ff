"""Profiles and checks of any table: nulls, distinct values, quantiles, duplicates, rules."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .ordering import exact_quantiles
from .tables import stack_rows


def duplicate_rows(df: DataFrame, keys: Sequence[str], out: str = "duplicates") -> DataFrame:
    """Rows beyond the first of every key; NULL keys count as equal."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("long").alias(out))


CELLS = "place int, a long, b long, x double, n long"
HELD_ROWS = 400_000  # rows whose cells a task holds before it counts them


def cell_counts(df: DataFrame) -> DataFrame:
    """``CELLS``: how often each value of each column occurs (``place``: number of the column), in one scan.

    A value is named by numbers of fixed width: whole numbers by themselves, floating point by
    its bits, everything else (texts, dates, decimals) by two 64-bit hashes of its typed value, so no
    text leaves its task. ``x`` is the number of numeric columns. Nulls have no ``a``. Tasks count column
    by column in arrays and send one row per value they hold.
    """
    lanes, kinds = [], []
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        number = isinstance(f.dataType, T.NumericType)
        if isinstance(f.dataType, T.IntegralType):
            lanes.append(c.cast("long").alias(f"a{i}"))
            kinds.append("whole")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            lanes.append(c.cast("double").alias(f"a{i}"))
            kinds.append("real")
        else:
            lanes += [F.when(c.isNotNull(), F.xxhash64(c)).alias(f"a{i}"), F.xxhash64(F.lit(i), c).alias(f"b{i}")]
            if number:
                lanes.append(c.cast("double").alias(f"x{i}"))
            kinds.append("number" if number else "other")
    counted = df.select(*lanes).mapInArrow(partial(_count_cells, kinds=kinds), CELLS)
    return counted.groupBy("place", "a", "b", "x").agg(F.sum("n").alias("n"))


def _count_cells(batches: Iterator[pa.RecordBatch], kinds: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("place", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.float64()), ("n", pa.int64())])

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)

        def numbers(name: str) -> np.ndarray:
            return table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)

        for i, kind in enumerate(kinds):
            known = pc.is_valid(table.column(f"a{i}")).to_numpy()
            a = numbers(f"a{i}")[known]
            if kind == "real":  # one name for both zeros and for all that is not a number
                a = np.where(np.isnan(a), np.nan, a + 0.0).view(np.int64)
            if kind in ("whole", "real"):
                a, n = np.unique(a, return_counts=True)
                b = np.zeros(len(a), np.int64)
                x = a.astype(np.float64) if kind == "whole" else a.view(np.float64)
            else:
                b, x = numbers(f"b{i}")[known], numbers(f"x{i}")[known] if kind == "number" else None
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate([[len(a) > 0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
                n = np.diff(np.append(first, len(a)))
                a, b = a[first], b[first]
                x = pa.nulls(len(a), pa.float64()) if x is None else x[order][first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), i, np.int32)), pa.array(a), pa.array(b), x if isinstance(x, pa.Array) else pa.array(x), pa.array(n.astype(np.int64))],
                schema=schema,
            )
            if not known.all():
                yield pa.RecordBatch.from_pylist([{"place": i, "n": int((~known).sum())}], schema=schema)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD_ROWS:
            yield from counted(held)
            held, rows = [], 0
    if rows:
        yield from counted(held)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def column_profile(df: DataFrame, table: str, temporal: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """Null rate, distinct values, extremes and quantiles per column, with the column's role."""
    numeric = numeric_columns(df)
    # Both the statistics and the quantiles read the counts.
    counts = durable(cell_counts(df), "cell-counts")
    stats = counts.groupBy("place").agg(
        F.sum("n").alias("filas"),
        (F.sum(F.when(F.col("a").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_rate"),
        F.count("a").alias("n_unique"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    quantiles = exact_quantiles(counts.where(F.col("x").isNotNull()), "x", {"p50": 0.5, "p95": 0.95}, ["place"], weight="n")
    names = F.array(*[F.lit(c) for c in df.columns])
    profile = stats.join(quantiles, "place", "left").withColumn("columna", F.element_at(names, F.col("place") + 1))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    dtype = F.create_map(*[F.lit(x) for item in kinds.items() for x in item])[F.col("columna")]
    return profile.select(
        F.lit(table).alias("tabla"),
        "columna",
        column_role(numeric, temporal, labels).alias("clasificacion"),
        dtype.alias("dtype"),
        F.round("null_rate", 6).alias("null_rate"),
        "n_unique",
        "min",
        "p50",
        "p95",
        "max",
    )


def column_role(numeric: Sequence[str], temporal: Sequence[str], labels: Sequence[str]) -> Column:
    """identifier, temporal, boolean, metric, dimension or structural, from name and profile."""
    name = F.lower("columna")
    zero_one = (F.col("n_unique") == 0) | (
        (F.col("n_unique") <= 2)
        & F.col("min").isin(0.0, 1.0)
        & F.col("max").isin(0.0, 1.0)
    )
    return (
        F.when(name.endswith("_id") | name.isin(*labels), "identificadores")
        .when(name.isin(*temporal), "temporales")
        .when(name.endswith("_flag") | F.coalesce(zero_one, F.lit(False)), "booleanas")
        .when(F.col("columna").isin(*numeric), "metricas")
        .when(F.col("n_unique") <= F.greatest(F.lit(100.0), F.col("filas") * 0.02), "dimensiones")
        .otherwise("estructurales")
    )


def table_profile(df: DataFrame, table: str, key: Sequence[str], time_columns: Sequence[str]) -> DataFrame:
    """Rows, columns, time coverage, mean null rate, key duplicates and mean cardinality."""
    coverage = next((c for c in time_columns if c in df.columns), None)
    nulls = [F.avg(F.col(c).isNull().cast("double")) for c in df.columns]
    total: Column = nulls[0]
    for n in nulls[1:]:
        total = total + n
    width = len(df.columns)
    limits = (
        [F.min(coverage).cast("string").alias("cobertura_inicio"), F.max(coverage).cast("string").alias("cobertura_fin")]
        if coverage
        else [F.lit(None).cast("string").alias("cobertura_inicio"), F.lit(None).cast("string").alias("cobertura_fin")]
    )
    row = df.agg(F.count("*").alias("filas"), (total / width).alias("null_rate_promedio"), *limits)
    distinct = cell_counts(df).groupBy("place").agg(F.count("a").alias("u")).agg(F.avg("u").alias("u"))
    return row.select(
        F.lit(table).alias("tabla"),
        F.lit(" + ".join(key)).alias("candidate_key"),
        "filas",
        F.lit(width).alias("columnas"),
        F.lit(coverage).alias("columna_temporal_referencia"),
        "cobertura_inicio",
        "cobertura_fin",
        F.round("null_rate_promedio", 6).alias("null_rate_promedio"),
        duplicate_rows(df, key).scalar().alias("duplicados_candidate_key"),
        F.round(distinct.scalar(), 2).alias("cardinalidad_promedio_columnas"),
    )


@dataclass(frozen=True)
class Rule:
    """Rows that meet ``condition`` are an issue of ``table``."""

    severity: str
    table: str
    issue: str
    condition: str
    impact: str = ""
    recommendation: str = ""


def rule_counts(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """Number of offending rows per rule: one scan per table whatever the number of rules."""
    parts = []
    for name, df in tables.items():
        own = [r for r in rules if r.table == name]
        if not own:
            continue
        counted = df.agg(*[F.count_if(F.expr(r.condition)).alias(f"r{i}") for i, r in enumerate(own)])
        entries = F.array(
            *[
                F.struct(
                    F.lit(r.severity).alias("severity"),
                    F.lit(r.table).alias("table"),
                    F.lit(r.issue).alias("issue"),
                    F.col(f"r{i}").alias("issue_count"),
                    F.lit(r.impact).alias("impact"),
                    F.lit(r.recommendation).alias("recommendation"),
                )
                for i, r in enumerate(own)
            ]
        )
        parts.append(counted.select(F.explode(entries).alias("e")).select("e.*"))
    return stack_rows(*parts)


def contract_checks(
    tables: Mapping[str, DataFrame], assets: Sequence[Mapping[str, object]]
) -> DataFrame:
    """Required columns, grain uniqueness and invariants of every contracted asset.

    All invariants of an asset are counted in one scan; an unknown value fails its invariant, and
    an expression that does not resolve is reported as a warning.
    """
    parts: list[DataFrame] = []
    for asset in assets:
        name, df = str(asset["name"]), tables.get(str(asset["name"]))
        if df is None:
            spark = next(iter(tables.values())).sparkSession
            parts.append(_check_rows(spark.range(1), name, [("asset_exists", "not found", F.lit(1))]))
            continue
        missing = [c for c in asset.get("required_columns", ()) if c not in df.columns]
        detail = "missing=" + ",".join(missing) if missing else "all_present"
        rows: list[tuple[str, str, Column | None]] = [("required_columns", detail, F.lit(len(missing)))]
        grain = list(asset.get("grain", ()))
        usable = bool(grain) and all(c in df.columns for c in grain)
        aggregates, bad = [], set()
        for i, text in enumerate(asset.get("invariants", ())):
            try:
                df.select(F.expr(text))
                aggregates.append(F.count_if(~F.coalesce(F.expr(text), F.lit(False))).alias(f"i{i}"))
            except AnalysisException:
                bad.add(i)
        counted = df.agg(*aggregates) if aggregates else df.sparkSession.range(1)
        if usable:
            rows.append(("grain_uniqueness", "grain=" + ",".join(grain), duplicate_rows(df, grain).scalar()))
        else:
            rows.append(("grain_uniqueness", "grain columns unavailable", None))
        for i, text in enumerate(asset.get("invariants", ())):
            rows.append(("invariant", text, None if i in bad else F.col(f"i{i}")))
        parts.append(_check_rows(counted, name, rows))
    return stack_rows(*parts)


def _check_rows(row: DataFrame, asset: str, checks: Sequence[tuple[str, str, Column | None]]) -> DataFrame:
    entries = F.array(
        *[
            F.struct(
                F.lit(asset).alias("asset"),
                F.lit(kind).alias("check_type"),
                (F.lit("WARN") if failed is None else F.when(failed == 0, "OK").otherwise("ERROR")).alias("status"),
                F.lit(detail).alias("detail"),
                (F.lit(0) if failed is None else failed).cast("long").alias("failed_count"),
            )
            for kind, detail, failed in checks
        ]
    )
    return row.select(F.explode(entries).alias("c")).select("c.*")


@dataclass(frozen=True)
class Check:
    """One recorded check, computed from the columns of a one-row table."""

    domain: str
    check: str
    severity: str
    ok: Column
    observed: Column
    expected: str
    detail: str
    risk_type: str
    evidence_grade: str
    warn: Column | None = None


def record_checks(row: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Checks as rows with status, evidence and issue id."""

    def status(c: Check) -> Column:
        out = F.when(c.ok, "OK")
        if c.warn is not None:
            out = out.when(c.warn, "WARN")
        return out.otherwise("ERROR")

    entries = F.array(
        *[
            F.struct(
                F.lit(c.domain).alias("domain"),
                F.lit(c.check).alias("check"),
                F.lit(c.severity).alias("severity"),
                status(c).alias("status"),
                c.observed.cast("string").alias("observed"),
                F.lit(c.expected).alias("expected"),
                F.lit(c.detail).alias("detail"),
                F.lit(c.risk_type).alias("risk_type"),
                F.lit(c.evidence_grade).alias("evidence_grade"),
                F.lit(f"ISS_{c.check}").alias("issue_id"),
            )
            for c in checks
        ]
    )
    return row.select(F.explode(entries).alias("c")).select("c.*")


@dataclass(frozen=True)
class Reconciliation:
    """Two figures of a one-row table that should agree."""

    check: str
    observed: Column
    expected: Column
    tier: str
    tolerance: float = 0.0
    warn_tolerance: float | None = None
    text: bool = False


def reconcile_figures(row: DataFrame, checks: Sequence[Reconciliation]) -> DataFrame:
    """Compare figures (within a tolerance, with an optional warning band) or texts."""

    def entry(c: Reconciliation) -> Column:
        if c.text:
            status = F.when(c.observed.eqNullSafe(c.expected), "OK").otherwise("ERROR")
            detail = F.lit("string_or_id_compare")
        else:
            gap = F.abs(c.observed - c.expected)
            status = F.when(gap <= c.tolerance, "OK")
            if c.warn_tolerance is not None:
                status = status.when(gap <= c.warn_tolerance, "WARN")
            status = status.otherwise("ERROR")
            detail = F.concat(F.lit("delta="), gap.cast("decimal(38,8)").cast("string"))
        return F.struct(
            F.lit(c.check).alias("check"),
            status.alias("status"),
            F.lit(c.tier).alias("tier"),
            c.observed.cast("string").alias("observed"),
            c.expected.cast("string").alias("expected"),
            detail.alias("detail"),
        )

    return row.select(F.explode(F.array(*[entry(c) for c in checks])).alias("c")).select("c.*")
