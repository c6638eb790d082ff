"""Trailing windows over daily series.

The frame rows are days: the input holds one row per key and day, so the longest window
partition is the calendar length and stays small whatever the raw volume of the key.
All outputs of one call share a single sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trailing:
    """``kind`` over the last ``rows`` rows; NULL (slope: 0) below ``minimum`` observations."""

    kind: str  # mean | sum | slope
    value: str
    rows: int
    minimum: int = 1


def with_trailing(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: Mapping[str, Trailing]
) -> DataFrame:
    series = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("__i", F.row_number().over(series))

    def measure(t: Trailing) -> Column:
        frame = series.rowsBetween(-(t.rows - 1), 0)
        if t.kind == "slope":
            # Least squares against the row number; a run shorter than half the window gives 0.
            enough = F.count(F.lit(1)).over(frame) >= max(3, t.rows // 2)
            slope = F.regr_slope(F.col(t.value), F.col("__i").cast("double")).over(frame)
            return F.when(enough, slope).otherwise(F.lit(0.0))
        total = (F.avg if t.kind == "mean" else F.sum)(t.value).over(frame)
        return F.when(F.count(t.value).over(frame) >= t.minimum, total)

    return numbered.withColumns({name: measure(t) for name, t in outputs.items()}).drop("__i")
