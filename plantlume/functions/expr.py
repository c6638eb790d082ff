"""Column expressions shared by the plans. Everything stays a built-in JVM expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """``num / den``, NULL where the denominator is zero."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def ratio_if_positive(num: ColumnLike, den: ColumnLike, otherwise: float | None = None) -> Column:
    """``num / den`` where ``den > 0``, else ``otherwise``."""
    return F.when(col(den) > 0, ratio(num, den)).otherwise(F.lit(otherwise).cast("double"))


def ratio_from(num: ColumnLike, den: ColumnLike, floor: float) -> Column:
    """``num / den`` only where the denominator reaches ``floor``; avoids exploding ratios."""
    return F.when(col(den) >= floor, ratio(num, den))


def or_zero(c: ColumnLike) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def clip(c: ColumnLike, low: float | Column | None, high: float | Column | None) -> Column:
    """Bounded value that keeps NULL (``least``/``greatest`` alone would replace it by a bound)."""
    c = col(c)
    bounded = c
    if low is not None:
        bounded = F.greatest(bounded, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(c.isNotNull(), bounded)


def finite_or_zero(c: ColumnLike) -> Column:
    """NULL, NaN and infinities become 0."""
    c = col(c).cast("double")
    unusable = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(unusable, F.lit(0.0)).otherwise(c)


def half_even(c: ColumnLike, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def flag(condition: Column) -> Column:
    """0/1 integer; an unknown condition counts as 0."""
    return F.when(condition, 1).otherwise(0)


def bands(c: ColumnLike, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first ``(minimum, label)`` step that ``c`` reaches, scanned in order."""
    c = col(c)
    (first_min, first_label), *rest = steps
    out = F.when(c >= first_min, first_label)
    for minimum, label in rest:
        out = out.when(c >= minimum, label)
    return out.otherwise(otherwise)


def lookup(c: ColumnLike, table: Mapping[str, float | int | str], otherwise=None) -> Column:
    """Constant map lookup with a fallback for unknown or NULL keys."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(c)), F.lit(otherwise))


def weighted(weights: Mapping[str, float], terms: Mapping[str, Column] | None = None) -> Column:
    """``sum(weight * term)``; terms default to the columns of the same name."""
    parts = [F.lit(float(w)) * (terms[name] if terms else F.col(name)) for name, w in weights.items()]
    return reduce(lambda a, b: a + b, parts)


def first_largest(candidates: Mapping[str, ColumnLike]) -> Column:
    """Label of the largest candidate; on ties the one listed first. NULL counts as lowest."""
    lowest = F.lit(float("-inf"))
    values = {k: F.coalesce(col(v).cast("double"), lowest) for k, v in candidates.items()}
    top = F.greatest(*values.values())
    label: Column | None = None
    for name, value in values.items():
        label = F.when(value == top, name) if label is None else label.when(value == top, name)
    return label


def top_contributions(contributions: Mapping[str, Column], k: int = 3) -> Column:
    """``name:value`` of the k largest contributions in a row, joined by ``;``.

    Ties keep the listed order.
    """
    entries = F.array(
        *[
            F.struct((-v).alias("neg"), F.lit(i).alias("at"), F.lit(name).alias("name"))
            for i, (name, v) in enumerate(contributions.items())
        ]
    )
    leading = F.slice(F.array_sort(entries), 1, k)
    return F.concat_ws(
        ";", F.transform(leading, lambda e: F.concat(e["name"], F.lit(":"), fixed(-e["neg"], 2)))
    )


def fixed(c: ColumnLike, digits: int) -> Column:
    """Plain decimal text with a fixed number of digits.

    The number is first settled at four digits more and then rounded half up as a decimal, so
    that the last binary digit of a computed figure can't decide a tie.
    """
    return col(c).cast(f"decimal(32,{digits + 4})").cast(f"decimal(28,{digits})").cast("string")


def json_text(c: Column, kind: T.DataType, digits: int = 4) -> Column:
    """JSON of a value with a fixed pattern: numbers as ``fixed`` text, keys in the order of the type, nulls kept."""
    if isinstance(kind, T.StructType):
        cells = [F.concat(F.lit(f'"{f.name}":'), json_text(c.getField(f.name), f.dataType, digits)) for f in kind.fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
        return F.when(c.isNull(), "null").otherwise(out)
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: json_text(x, kind.elementType, digits))
        return F.coalesce(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), F.lit("null"))
    if isinstance(kind, T.StringType):
        text = c
        for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(plain), F.lit(escaped))
        return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(fixed(c, digits), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def grouped_number(c: ColumnLike, digits: int = 0) -> Column:
    """Number text with thousands separators."""
    return F.format_number(col(c), digits)


def sequence_label(prefix: str, n: ColumnLike, width: int = 2) -> Column:
    """``prefix`` + zero-padded number; wider numbers keep all their digits."""
    text = col(n).cast("string")
    padded = F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
    return F.concat(F.lit(prefix), padded)


def pattern_hits(text: ColumnLike, patterns: Sequence[str]) -> Column:
    """Total number of case-insensitive matches of all patterns in the whole text."""
    counts = [F.coalesce(F.regexp_count(col(text), F.lit("(?i)" + p)), F.lit(0)) for p in patterns]
    return reduce(lambda a, b: a + b, counts)


def hour_start(ts: ColumnLike) -> Column:
    return F.date_trunc("hour", col(ts)).cast("timestamp_ntz")


def month_start(ts: ColumnLike) -> Column:
    return F.date_trunc("month", col(ts)).cast("timestamp_ntz")


def week_start(ts: ColumnLike) -> Column:
    return F.date_trunc("week", col(ts)).cast("timestamp_ntz")


def day(ts: ColumnLike) -> Column:
    return col(ts).cast("date")


def period(ts: ColumnLike) -> Column:
    """Month text ``yyyy-MM``."""
    return F.date_format(col(ts), "yyyy-MM")


def shift_of(ts: ColumnLike) -> Column:
    """Shift A from 06:00, B from 14:00, C otherwise."""
    h = F.hour(col(ts))
    return F.when(h.between(6, 13), "A").when(h.between(14, 21), "B").otherwise("C")


def shift_day(ts: ColumnLike, night_to_previous_day: bool = False) -> Column:
    """Calendar day of the shift.

    With ``night_to_previous_day`` the hours before 06:00 belong to the C shift that began the
    evening before; otherwise they keep their own date.
    """
    if not night_to_previous_day:
        return day(ts)
    return F.date_sub(day(ts), F.when(F.hour(col(ts)) < 6, 1).otherwise(0))


def lenient_timestamp(text: ColumnLike) -> Column:
    """Timestamp or NULL when the text cannot be parsed."""
    return F.try_to_timestamp(col(text).cast("string"))


def months_spanned(first: ColumnLike, last: ColumnLike) -> Column:
    """Number of calendar months touched by the closed date range."""
    months = (F.year(col(last)) - F.year(col(first))) * 12 + F.month(col(last)) - F.month(col(first))
    return months + 1


def content_hash(*columns: ColumnLike) -> Column:
    return F.sha2(F.concat_ws("|", *[col(c).cast("string") for c in columns]), 256)
