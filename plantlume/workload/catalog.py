"""Registry of queries and of the SQL text that checks each of them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .roles import ROLES, role_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

DIGITS = 4


def nudge(digits: int) -> str:
    """Added before rounding on both sides.

    Many inputs are short decimals whose sums end exactly on a rounding tie; there the last bit,
    and with it the summation order, would decide the digit. The shift is far below one unit of
    the last digit kept.
    """
    return f"{0.000317 * 10 ** -digits:.3e}"


def define(name: str, text: str) -> None:
    """A named SQL relation that oracle texts may use."""
    CTES[name] = text


for _name in ROLES:
    define(_name, role_sql(_name))


def with_ctes(text: str) -> str:
    """Prefix ``text`` with the definitions it needs, in dependency order."""
    ordered: list[str] = []
    open_names: set[str] = set()

    def visit(t: str) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", t)):
            if word in CTES and word not in ordered and word not in open_names:
                open_names.add(word)
                visit(CTES[word])
                ordered.append(word)

    visit(text)
    if not ordered:
        return text
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in ordered) + "\n" + text


def columns(spec: str, digits: int = DIGITS) -> str:
    """Select list: ``name~`` is rounded like the Spark result, plain names are passed on."""
    out = []
    for c in spec.split():
        out.append(f"round({c[:-1]}::DOUBLE + {nudge(digits)}, {digits}) + 0.0 AS {c[:-1]}" if c.endswith("~") else c)
    return ", ".join(out)


def final(source: str, spec: str, digits: int = DIGITS, tail: str = "") -> str:
    return f"SELECT {columns(spec, digits)} FROM {source} {tail}"


def _comparable(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name).cast("double") + float(nudge(digits)), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register a query; ``sql`` is its equivalent on the same tables."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _comparable(fn(spark, sf_dir), digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register
