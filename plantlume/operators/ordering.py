"""Total orders at scale: positions, running totals, ranks, exact quantiles, top rows.

A window without a partition key, or over a key that holds a third of the data, runs in one
task. These operators sort by range instead, so the rows of one key may span many slices, and
only the per-slice totals (a few rows per key) are combined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

Order = Sequence[Column]


def top_rows(df: DataFrame, order: Order, k: int) -> DataFrame:
    """The first ``k`` rows of an order with a unique tie-break (a per-task heap, then a merge)."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Order, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group.

    Spark limits each group to ``k`` rows before the shuffle (WindowGroupLimit), so a hot group
    never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def _sliced(df: DataFrame, keys: Sequence[str], order: Order, slices: int | None) -> DataFrame:
    """Rows in range-sorted slices, with the slice number and the place inside it, written down.

    The slice borders come from sampling, so the layout is stored once and read by both the
    totals and the rows; a recomputed border can then never disagree with a counted one.
    """
    # Without a given number AQE sizes the slices from the shuffled bytes.
    count = [slices] if slices else []
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    laid = (
        df.repartitionByRange(*count, *by)
        .sortWithinPartitions(*by)
        .withColumn("__slice", F.spark_partition_id())
        .withColumn(
            "__at",
            F.monotonically_increasing_id() - F.shiftleft(F.col("__slice").cast("long"), 33),
        )
    )
    return durable(laid, "sliced")


def _match(keys: Sequence[str], extra: Sequence[str] = ()) -> Column | None:
    conds = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    conds += [F.col(k) == F.col(f"__{k}") for k in extra]
    return reduce(lambda a, b: a & b, conds) if conds else None


def with_position(
    df: DataFrame, out: str, order: Order, keys: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """1-based position of every row, per key or over the whole table.

    ``order`` needs a unique tie-break. Equal to ``row_number`` over the same window.
    """
    return with_running_sum(df, {out: F.lit(1)}, order, keys, slices)


def with_running_sum(
    df: DataFrame,
    sums: dict[str, Column],
    order: Order,
    keys: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Running totals (current row included) per key or over the whole table."""
    values = {f"__v{i}": c for i, c in enumerate(sums.values())}
    columns = df.columns
    laid = _sliced(df.withColumns(values), keys, order, slices)

    totals = laid.groupBy(*keys, "__slice").agg(*[F.sum(v).alias(v) for v in values])
    # One row per slice and key in it: at most (slices + keys) rows, whatever the data size.
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__slice").alias("____slice"),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__o{v}") for v in values],
    )
    inside = (
        Window.partitionBy(*keys, "__slice")
        .orderBy("__at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = laid.withColumns({v: F.sum(v).over(inside) for v in values})
    joined = running.join(offsets, _match(keys, ["__slice"]))
    return joined.select(
        *columns, *[(F.col(v) + F.col(f"__o{v}")).alias(n) for v, n in zip(values, sums)]
    )


def value_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Average rank of every distinct value (ties share the mean of their places).

    Works on (key, value) counts, so a value shared by a third of the rows is one row here.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    placed = with_running_sum(counts, {"__upto": F.col("__n")}, [F.col(value).asc()], keys)
    mean_place = F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2.0
    return placed.select(*keys, value, mean_place.alias(out))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    keys: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, per key or for the table.

    ``weight`` names a column that holds how often each row counts.

    The built-in ``percentile`` keeps all distinct values of a group in one buffer; here they are
    counted, laid out by range and only the two neighbouring values of each quantile are picked.
    """
    times = F.sum(weight) if weight else F.count("*")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("__n"))
    placed = with_running_sum(counts, {"__upto": F.col("__n")}, [F.col(value).asc()], keys)
    total = placed.groupBy(*keys).agg(F.max("__upto").alias("__total"))
    if keys:
        right = total.select(*[F.col(k).alias(f"__{k}") for k in keys], "__total")
        sized = placed.join(right, _match(keys)).drop(*[f"__{k}" for k in keys])
    else:
        sized = placed.withColumn("__total", total.scalar())

    def picked(place: Column) -> Column:
        here = (place >= F.col("__upto") - F.col("__n")) & (place < F.col("__upto"))
        return F.max(F.when(here, F.col(value)))

    aggregates, results = [], []
    for i, (name, p) in enumerate(probabilities.items()):
        place = F.lit(float(p)) * (F.col("__total") - 1)
        aggregates += [
            picked(F.floor(place)).alias(f"__lo{i}"),
            picked(F.ceil(place)).alias(f"__hi{i}"),
            F.max(place - F.floor(place)).alias(f"__f{i}"),
        ]
        lo = F.col(f"__lo{i}").cast("double")
        results.append((lo + F.col(f"__f{i}") * (F.col(f"__hi{i}") - lo)).alias(name))
    return sized.groupBy(*keys).agg(*aggregates).select(*keys, *results)


def most_common(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mode per group, the smallest value on ties, from counts instead of a per-group map."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    best = top_per_group(counts, keys, [F.col("__n").desc(), F.col(value).asc()], 1)
    return best.select(*keys, F.col(value).alias(out))


def capacity_waves(
    df: DataFrame,
    order: Order,
    id_cols: Sequence[str],
    qualifies: Column,
    first: int,
    second: int,
    keys: Sequence[str] = (),
    out: str = "wave",
    labels: tuple[str, str, str] = ("OLA_1", "OLA_2", "OLA_3"),
) -> DataFrame:
    """Fill limited waves along an order.

    The first ``first`` qualifying rows form wave 1, the next ``second`` of all other rows
    wave 2, and the rest wave 3. Both waves are top-k selections, so no running count over the
    whole order is needed.
    """
    on = [*keys, *id_cols]
    wave_1 = top_per_group(df.where(qualifies), keys, order, first).select(*on)
    others = df.join(wave_1, on, "left_anti")
    wave_2 = top_per_group(others, keys, order, second).select(*on)
    placed = wave_1.withColumn(out, F.lit(labels[0])).unionByName(wave_2.withColumn(out, F.lit(labels[1])))
    return df.join(placed, on, "left").withColumn(out, F.coalesce(F.col(out), F.lit(labels[2])))


def steps_down(df: DataFrame, keys: Sequence[str], order: Order, value: str) -> DataFrame:
    """Rows per key (``initiatives``), and how often ``value`` falls from one row of the order to the next (``rises``).

    Neighbours meet in slices of a range layout; at the borders only the first and last row of
    each slice are compared, so no key needs one task.
    """
    laid = _sliced(df, keys, order, None)
    before = F.lag(value).over(Window.partitionBy(*keys, "__slice").orderBy("__at"))
    inside = laid.select(*keys, "__slice", "__at", value, before.alias("__before"))
    slices = inside.groupBy(*keys, "__slice").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) < F.col("__before")).alias("falls"),
        F.min_by(value, "__at").alias("first"), F.max_by(value, "__at").alias("last"),
    )
    joined = slices.withColumn("__before", F.lag("last").over(Window.partitionBy(*keys).orderBy("__slice")))
    border = (F.col("first") < F.col("__before")).cast("long")
    return joined.groupBy(*keys).agg(F.sum("n").alias("initiatives"), F.sum(F.col("falls") + F.coalesce(border, F.lit(0))).alias("rises"))
