"""Anchored scores: a fixed reference band per score, so values compare between releases."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import ColumnLike, clip, col

# Tags written next to every score.
SCALE_VERSION = "anchored_reference_v1"
SCALING_METHOD = "anchored_reference_linear"
ABSOLUTE = "absolute_comparable_inter_release"
CONTEXTUAL = "contextual_comparable_inter_release"
NON_COMPARABLE = "non_comparable_cross_window"
COMPARABILITY_TAGS = (ABSOLUTE, CONTEXTUAL, NON_COMPARABLE)


@dataclass(frozen=True)
class Band:
    """Reference band of a score: ``low`` maps to 0 and ``high`` to 100 (swapped by ``invert``)."""

    low: float
    high: float
    invert: bool = False

    @property
    def usable(self) -> bool:
        span = self.high - self.low
        return span > 0 and span != float("inf")


def anchored(value: ColumnLike, band: Band, limits: tuple[float, float] = (0.0, 100.0)) -> Column:
    """Position of ``value`` inside ``band`` as a score, NULL kept, 50 for an empty band."""
    if not band.usable:
        return F.lit(50.0)
    share = 100.0 * (col(value).cast("double") - band.low) / (band.high - band.low)
    return clip(100.0 - share if band.invert else share, *limits)


def unit(value: ColumnLike, low: float, high: float, invert: bool = False) -> Column:
    """``anchored`` scaled to 0..1, the form the composites use."""
    return anchored(value, Band(low, high, invert)) / 100.0


def anchored_by_group(
    value: ColumnLike, group: ColumnLike, bands: Mapping[str, Band], default: Band
) -> Column:
    """Anchored score with one band per group label and a default for other or missing labels.

    The bands are constants, so they are folded into the expression and no join is needed.
    """
    out: Column | None = None
    for label, band in bands.items():
        hit = col(group) == F.lit(label)
        out = F.when(hit, anchored(value, band)) if out is None else out.when(hit, anchored(value, band))
    fallback = anchored(value, default)
    return fallback if out is None else out.otherwise(fallback)


def scaled_between(value: ColumnLike, low: Column, high: Column, invert: bool = False) -> Column:
    """Min-max score for limits known only at run time; 50 when the range is empty or unknown."""
    v = col(value).cast("double")
    spread = F.nullif(high - low, F.lit(0.0))
    share = F.when(spread.isNull(), F.lit(50.0)).otherwise(100.0 * (v - low) / spread)
    return clip(100.0 - share if invert else share, 0.0, 100.0)
