"""Value of an improvement over a monthly horizon, in closed form.

Monthly savings start after ``delay`` months, grow linearly over ``ramp`` months and then stay
flat. The discounted sum of such a profile is an arithmetic-geometric series, so a value is a
constant number of arithmetic operations per row: no month spine, no extra rows, no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expr import ColumnLike, col

HORIZON_MONTHS = 72
DISCOUNT_RATE = 0.10
NO_PAYBACK = 999.0
RATE_RANGE = (-0.90, 3.00)


def _monthly_factor(rate: float) -> float:
    return (1.0 + rate) ** (-1.0 / 12.0)


def _bounded(c: Column, low: Column | int, high: Column | int) -> Column:
    low = F.lit(low) if isinstance(low, int) else low
    high = F.lit(high) if isinstance(high, int) else high
    return F.greatest(low, F.least(c, high))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time inside a lambda."""
    return F.transform(F.array(value), use)[0]


def captured_months(months: ColumnLike, delay: ColumnLike, ramp: ColumnLike) -> Column:
    """Undiscounted capture summed over the first ``months`` months, in full-capture months."""
    m, d, r = (col(x).cast("double") for x in (months, delay, ramp))
    growing = _bounded(m - d, F.lit(0.0), r)
    flat = F.greatest(m - d - r, F.lit(0.0))
    return growing * (growing + 1.0) / (2.0 * r) + flat


def discounted_months(
    months: ColumnLike, delay: ColumnLike, ramp: ColumnLike, rate: float = DISCOUNT_RATE
) -> Column:
    """Discounted capture summed over the first ``months`` months.

    Month ``m`` (from 0) is discounted by ``v ** (m + 1)``.
    """
    v = _monthly_factor(rate)
    m, d, r = (col(x).cast("double") for x in (months, delay, ramp))
    g = _bounded(m - d, F.lit(0.0), r)
    vg = F.pow(F.lit(v), g)
    ramping = v * (1.0 - (g + 1.0) * vg + g * vg * v) / ((1.0 - v) ** 2) / r
    flat = F.greatest(m - d - r, F.lit(0.0))
    steady = F.pow(F.lit(v), r + 1.0) * (1.0 - F.pow(F.lit(v), flat)) / (1.0 - v)
    return F.pow(F.lit(v), d) * (ramping + steady)


def net_present_value(
    capex: ColumnLike,
    annual: ColumnLike,
    delay: ColumnLike,
    ramp: ColumnLike,
    rate: float = DISCOUNT_RATE,
    months: int = HORIZON_MONTHS,
) -> Column:
    return -col(capex) + col(annual) / 12.0 * discounted_months(F.lit(months), delay, ramp, rate)


def _repayment(months: int, discount: float, rate_range: tuple[float, float], never: float):
    """Array kernel of ``repayment``; self-contained, so executors need no package import."""
    years, steps = months // 12, (months + 1).bit_length()
    v = (1.0 + discount) ** (-1.0 / 12.0)

    def kernel(capex: pd.Series, annual: pd.Series, delay: pd.Series, ramp: pd.Series) -> pd.DataFrame:
        c, a, d, r = (x.to_numpy(dtype=float) for x in (capex, annual, delay, ramp))

        def worth(m):
            grown = np.clip(m - d, 0.0, r)
            power = v**grown
            ramping = v * (1 - (grown + 1) * power + grown * power * v) / (1 - v) ** 2 / r
            steady = v ** (r + 1) * (1 - v ** np.maximum(m - d - r, 0.0)) / (1 - v)
            return -c + a / 12.0 * v**d * (ramping + steady)

        lo, hi = np.zeros(len(c)), np.full(len(c), months + 1.0)
        for _ in range(steps):
            mid = np.maximum(np.floor((lo + hi) / 2), 1.0)
            repaid = worth(mid) >= 0
            lo, hi = np.where(repaid, lo, mid), np.where(repaid, mid, hi)
        payback = np.where(hi <= months, hi, never)

        def full_months(m):
            grown = np.clip(m - d, 0.0, r)
            return grown * (grown + 1) / (2 * r) + np.maximum(m - d - r, 0.0)

        ends = [full_months(12 * y) for y in range(years + 1)]
        flows = [-c] + [a / 12.0 * (ends[y + 1] - ends[y]) for y in range(years)]

        def present(rate):
            total = flows[-1]
            for flow in reversed(flows[:-1]):
                total = flow + total / (1.0 + rate)
            return total

        low, high = (np.full(len(c), end) for end in rate_range)
        at_low = present(low)
        gain, loss = np.max(flows, axis=0) > 0, np.min(flows, axis=0) < 0
        solvable = gain & loss & (at_low * present(high) <= 0)
        for _ in range(60):
            mid = (low + high) / 2
            at_mid = present(mid)
            left = at_low * at_mid <= 0
            low, high = np.where(left, low, mid), np.where(left, mid, high)
            at_low = np.where(left, at_low, at_mid)
        rate = np.where(solvable, 100.0 * (low + high) / 2, np.nan)
        return pd.DataFrame({"payback": payback, "rate_pct": rate})

    return kernel


def repayment(capex: ColumnLike, annual: ColumnLike, delay: ColumnLike, ramp: ColumnLike) -> Column:
    """First month that repays the investment (999 if none) and the internal rate of return.

    Struct of ``payback`` and ``rate_pct``. Both are searches, which as expressions would be
    interpreted per row; over Arrow batches each halving step is one array operation.
    """
    kind = T.StructType([T.StructField("payback", T.DoubleType()), T.StructField("rate_pct", T.DoubleType())])
    udf = F.pandas_udf(_repayment(HORIZON_MONTHS, DISCOUNT_RATE, RATE_RANGE, NO_PAYBACK), kind)
    return udf(*[col(x).cast("double") for x in (capex, annual, delay, ramp)])


def yearly_flows(
    capex: ColumnLike,
    annual: ColumnLike,
    delay: ColumnLike,
    ramp: ColumnLike,
    months: int = HORIZON_MONTHS,
) -> list[Column]:
    """Investment followed by the saving of each year."""
    flows = [-col(capex)]
    for year in range(months // 12):
        upto = captured_months(F.lit(12 * (year + 1)), delay, ramp)
        before = captured_months(F.lit(12 * year), delay, ramp)
        flows.append(col(annual) / 12.0 * (upto - before))
    return flows


def present_value(flows: Column, years: int, rate: Column) -> Column:
    """Yearly flows (an array) discounted at ``rate``, by Horner's rule."""
    x = 1.0 + rate
    value = flows[years]
    for year in range(years - 1, -1, -1):
        value = flows[year] + value / x
    return value


def internal_rate_pct(
    flows: Column, years: int, low: float = RATE_RANGE[0], high: float = RATE_RANGE[1], steps: int = 60
) -> Column:
    """Internal rate of return in percent by bisection, NULL without a sign change.

    ``flows`` is an array column of ``years + 1`` values of any sign pattern. For the standard
    investment profile ``repayment`` gives the same figure faster.
    """
    has_loss = F.exists(flows, lambda f: f < 0)
    has_gain = F.exists(flows, lambda f: f > 0)
    at_low = present_value(flows, years, F.lit(low))
    at_high = present_value(flows, years, F.lit(high))

    def halve(state: Column, _: Column) -> Column:
        mid = (state["lo"] + state["hi"]) / 2.0
        return once(
            F.struct(mid.alias("m"), present_value(flows, years, mid).alias("v")),
            lambda t: F.struct(
                F.when(state["at"] * t["v"] <= 0, state["lo"]).otherwise(t["m"]).alias("lo"),
                F.when(state["at"] * t["v"] <= 0, t["m"]).otherwise(state["hi"]).alias("hi"),
                F.when(state["at"] * t["v"] <= 0, state["at"]).otherwise(t["v"]).alias("at"),
            ),
        )

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), at_low.alias("at"))
    root = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: 100.0 * (s["lo"] + s["hi"]) / 2.0
    )
    return F.when(has_loss & has_gain & (at_low * at_high <= 0), root)


def simple_payback_months(capex: ColumnLike, annual: ColumnLike, opex: ColumnLike) -> Column:
    """Months to repay from net yearly savings, kept within 2.5 and 180."""
    net = F.greatest(F.lit(1500.0), col(annual) - F.greatest(F.lit(0.0), col(opex)))
    return F.least(F.greatest(col(capex) / (net / 12.0), F.lit(2.5)), F.lit(180.0))


def payback_horizon(months: ColumnLike) -> Column:
    """Horizon label of a payback."""
    m = col(months)
    return (
        F.when(m <= 12, "0-12 meses")
        .when(m <= 24, "12-24 meses")
        .when(m <= 48, "24-48 meses")
        .otherwise("48+ meses")
    )
