"""Joins with structure: null-safe keys, intervals, calendar spines, bands, latest match."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import day, or_zero
from ..session import durable, release
from .ordering import _sliced, top_per_group


def one_row(df: DataFrame) -> Column:
    """A one-row aggregate as a struct-valued scalar subquery, so that no join is planned for it."""
    return df.select(F.struct("*").alias("row")).scalar()


def left_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi join that also matches NULL keys; the key columns are kept once."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"__{k}" for k in keys])


def with_group_stats(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """Add whole-group aggregates to every row.

    A window over the group would put a hot group into one task. Here the statistics are
    pre-aggregated on the map side and joined back; the joined side has one row per group, and
    AQE broadcasts it when its measured size allows or splits the hot keys otherwise.
    """
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    return left_on(df, grouped, keys)


def with_table_stats(df: DataFrame, stats: Mapping[str, Column]) -> DataFrame:
    """Add whole-table aggregates to every row through a one-row scalar subquery."""
    row = one_row(df.agg(*[c.alias(n) for n, c in stats.items()]))
    tagged = df.withColumn("__stats", row)
    return tagged.select(*df.columns, *[F.col(f"__stats.{n}").alias(n) for n in stats])


def pre_aggregated_fan_in(
    driver: DataFrame, parts: Sequence[DataFrame], keys: Sequence[str], zero: Sequence[str]
) -> DataFrame:
    """Left join several streams that are already aggregated to the same keys; gaps become 0."""
    joined = reduce(lambda acc, part: acc.join(part, list(keys), "left"), parts, driver)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


def map_lookup(
    df: DataFrame,
    mapping: DataFrame,
    on: Mapping[str, str],
    value: str,
    out: str,
    fallback: Column,
) -> DataFrame:
    """Replace a value through a mapping table; rows without a match take ``fallback``.

    ``on`` maps columns of ``df`` to columns of ``mapping``.
    """
    right = mapping.select(
        *[F.col(m).alias(f"__{m}") for m in on.values()], F.col(value).alias(f"__{out}")
    )
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{m}") for c, m in on.items()])
    return (
        df.join(right, cond, "left")
        .withColumn(out, F.coalesce(F.col(f"__{out}"), fallback))
        .drop(f"__{out}", *[f"__{m}" for m in on.values()])
    )


def overlap_by_hour(
    events: DataFrame, keys: Sequence[str], start: str, end: str, out: str, cap: float | None = 1.0
) -> DataFrame:
    """Hours of every event that fall into each clock hour, summed per key.

    An event expands into one row per touched hour before a map-side combined aggregation, so
    a key with a third of all events is still reduced where it is read.
    """
    usable = events.where(F.col(end) > F.col(start))
    first = F.date_trunc("hour", F.col(start))
    touched = usable.withColumn(
        "hora", F.explode(F.sequence(first, F.col(end).cast("timestamp"), F.expr("interval 1 hour")))
    )
    hour_end = F.col("hora") + F.expr("interval 1 hour")
    inside = F.least(F.col(end).cast("timestamp"), hour_end).cast("double") - F.greatest(
        F.col(start).cast("timestamp"), F.col("hora")
    ).cast("double")
    total = F.sum(inside / 3600.0)
    return (
        touched.where(inside > 0)
        .groupBy(*keys, F.col("hora").cast("timestamp_ntz").alias("hora"))
        .agg((F.least(total, F.lit(cap)) if cap is not None else total).alias(out))
    )


def overlap_by_shift(
    events: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    out: str,
    cap: float | None = 8.0,
    night_to_previous_day: bool = True,
) -> DataFrame:
    """Hours of every event inside each shift; the C shift runs from 22:00 to 06:00.

    Shifts are eight hours long and start at 06:00, so moving the clock back by six hours turns
    them into thirds of a day and the touched shifts into a plain sequence.
    """
    usable = events.where(F.col(end) > F.col(start))
    back = F.expr("interval 6 hours")
    s = (F.col(start).cast("timestamp") - back).cast("double")
    e = (F.col(end).cast("timestamp") - back).cast("double")
    eight = 8 * 3600.0
    slots = usable.withColumn(
        "__slot",
        F.explode(
            F.sequence(F.floor(s / eight).cast("long"), F.floor(e / eight).cast("long"), F.lit(1))
        ),
    )
    inside = F.least(e, (F.col("__slot") + 1) * eight) - F.greatest(s, F.col("__slot") * eight)
    third = F.pmod(F.col("__slot"), F.lit(3))
    started = F.timestamp_seconds(F.col("__slot") * eight)
    shift_date = day(started)
    if night_to_previous_day:
        keyed = slots.select("*", inside.alias("__inside"), shift_date.alias("fecha"), third.alias("__third"))
    else:
        # The night hours after midnight keep their own date: split the C slot at midnight.
        midnight = (F.floor(F.col("__slot") / 3) * 3 + 2) * eight + 2 * 3600.0
        before = F.greatest(F.least(e, midnight) - F.greatest(s, F.col("__slot") * eight), F.lit(0.0))
        pieces = F.when(
            third == 2,
            F.array(
                F.struct(before.alias("h"), shift_date.alias("d")),
                F.struct((inside - before).alias("h"), F.date_add(shift_date, 1).alias("d")),
            ),
        ).otherwise(F.array(F.struct(inside.alias("h"), shift_date.alias("d"))))
        keyed = (
            slots.select("*", third.alias("__third"), F.explode(pieces).alias("__piece"))
            .withColumns({"__inside": F.col("__piece.h"), "fecha": F.col("__piece.d")})
        )
    label = F.when(F.col("__third") == 0, "A").when(F.col("__third") == 1, "B").otherwise("C")
    total = F.sum(F.col("__inside") / 3600.0)
    return (
        keyed.where(F.col("__inside") > 0)
        .groupBy(*keys, "fecha", label.alias("turno"))
        .agg((F.least(total, F.lit(cap)) if cap is not None else total).alias(out))
    )


def fill_hours(
    facts: DataFrame, keys: Sequence[str], hour: str, values: Sequence[str], span: DataFrame | None = None
) -> DataFrame:
    """Complete hourly calendar per key; hours without a fact get 0.

    ``span`` may hold the first and last hour (``lo``, ``hi``); by default it is taken from the
    facts. Each key expands on its own, so keys are spread over the cluster.
    """
    limits = one_row(span if span is not None else facts.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")))
    spine = (
        facts.select(*keys)
        .distinct()
        .withColumn("__span", limits)
        .select(
            *keys,
            F.explode(
                F.sequence(
                    F.col("__span.lo").cast("timestamp"),
                    F.col("__span.hi").cast("timestamp"),
                    F.expr("interval 1 hour"),
                )
            ).alias(hour),
        )
        .withColumn(hour, F.col(hour).cast("timestamp_ntz"))
    )
    return spine.join(facts, [*keys, hour], "left").withColumns({v: or_zero(v) for v in values})


CELL_ROWS, TASK_PAIRS = 2000, 20_000_000


def join_in_cells(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, cell: int = CELL_ROWS
) -> DataFrame:
    """Equi join of two sides with few and large keys, whose pairs far outnumber their rows.

    The rows of a key are dealt into parts of about ``cell`` rows, and every two parts meet in a cell of
    their own. The number of tasks follows the pairs: AQE, which sees only the small sides, would
    put many cells into one task.
    """
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("l")).join(
        right.groupBy(*keys).agg(F.count(F.lit(1)).alias("r")), list(keys)
    )
    top, pairs = sizes.agg(F.max(F.greatest("l", "r")), F.sum(F.col("l").cast("double") * F.col("r"))).first()
    parts = max(1, -(-(top or 0) // cell))
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, int((pairs or 0) // TASK_PAIRS) + 1)
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    on = [*keys, "__l", "__r"]

    def dealt(side: DataFrame, id_col: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int")
        return side.select("*", part.alias(own), every.alias(other)).repartition(tasks, *on)

    return dealt(left, left_id, "__l", "__r").join(dealt(right, right_id, "__r", "__l"), on).drop("__l", "__r")


def near_value_pairs(
    df: DataFrame, groups: Sequence[str], id_col: str, value: str, gap: float, carry: Sequence[str] = ()
) -> DataFrame:
    """Unordered pairs of the same group whose values differ by at most ``gap``.

    Band join: values are cut into buckets of width ``gap``, a row meets only its own and the
    next bucket, and large buckets are dealt over many tasks. The lower (value, id) comes first.
    """
    rows = df.select(*groups, id_col, value, *carry).withColumn("__b", F.floor(F.col(value) / gap))
    left = rows.select(
        *groups,
        "__b",
        F.col(id_col).alias("id_1"),
        F.col(value).alias("value_1"),
        *[F.col(c).alias(f"{c}_1") for c in carry],
    )
    right = rows.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b")))).select(
        *groups,
        "__b",
        F.col(id_col).alias("id_2"),
        F.col(value).alias("value_2"),
        *[F.col(c).alias(f"{c}_2") for c in carry],
    )
    after = (F.col("value_2") > F.col("value_1")) | (
        (F.col("value_2") == F.col("value_1")) & (F.col("id_2") > F.col("id_1"))
    )
    return (
        join_in_cells(left, right, [*groups, "__b"], "id_1", "id_2")
        .where(after & (F.col("value_2") - F.col("value_1") <= gap))
        .drop("__b")
    )


RUN_ROWS, BLOCK_ROWS = 200, 4000


def value_blocks(df: DataFrame, groups: Sequence[str], id_col: str, value: str) -> DataFrame:
    """Rows of every group along (value, id), packed into stored blocks of at most ``BLOCK_ROWS`` rows.

    A block has a number, its size ``n``, its least and largest value ``lo`` and ``hi``, its sorted ``rows`` (``value``,
    ``id``), and the same rows in ``runs`` of ``RUN_ROWS`` with ``lo`` and ``hi`` of their own. Rows without group or value
    take no part.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*groups, value)])
    narrow = df.where(present).select(*groups, F.col(value).alias("value"), F.col(id_col).alias("id"))
    laid = _sliced(narrow, groups, [F.col("value").asc(), F.col("id").asc()], None)
    packed = laid.groupBy(*groups, "__slice", F.floor(F.col("__at") / BLOCK_ROWS)).agg(
        F.sort_array(F.collect_list(F.struct("value", "id"))).alias("rows")
    )
    n = F.size("rows")

    def at(place: Column) -> Column:
        return F.get("rows", place)["value"]

    def run(k: Column) -> Column:
        first, last = k * RUN_ROWS, F.least(n, (k + 1) * RUN_ROWS) - 1
        rows = F.slice("rows", first + 1, F.lit(RUN_ROWS))
        return F.struct(at(first).alias("lo"), at(last).alias("hi"), rows.alias("rows"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN_ROWS).cast("int")), run)
    blocks = durable(
        packed.select(
            *groups, F.monotonically_increasing_id().alias("block"), n.alias("n"),
            at(F.lit(0)).alias("lo"), at(n - 1).alias("hi"), "rows", runs.alias("runs"),
        ),
        "blocks",
    )
    release(laid)
    return blocks


def _may_be_near(lo: Column, hi: Column, gap: float | None) -> Column:
    """Can a value from ``lo`` on lie within ``gap`` above one up to ``hi``? A difference that is NaN tells nothing."""
    return F.lit(True) if gap is None else F.isnan(lo - hi) | (lo - hi <= gap)


def block_cells(blocks: DataFrame, groups: Sequence[str], where: Column, gap: float | None = None) -> DataFrame:
    """Two blocks each that may hold a pair of ``block_pairs``, and the product of their sizes."""
    ends = [c for c in blocks.columns if c not in (*groups, "rows", "runs")]
    left, right = (blocks.select(*groups, *[F.col(c).alias(f"{c}_{k}") for c in ends]) for k in (1, 2))
    meet = (F.col("hi_2") >= F.col("lo_1")) & _may_be_near(F.col("lo_2"), F.col("hi_1"), gap)
    return left.join(right, list(groups)).where(meet & where).select(
        *groups, "block_1", "block_2", (F.col("n_1").cast("long") * F.col("n_2")).alias("pairs")
    )


def block_pairs(blocks: DataFrame, groups: Sequence[str], where: Column, gap: float | None = None) -> DataFrame:
    """Pairs (``id_1``, ``id_2``) of one group whose second row follows the first by (value, id), at most ``gap`` above.

    ``where`` says by columns of the two blocks (``name_1``, ``name_2``) which blocks meet. Only blocks near each
    other do, each two in a cell; cells are dealt over as many tasks as their pairs need. A row of the first block
    walks over the near runs of the second, so few pairs are formed in vain, and cells are bounded whatever the group.
    """
    cells = durable(block_cells(blocks, groups, where, gap), "cells")
    pairs = cells.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS + 1)
    on = ["block_1", "block_2"]

    # The merge hints make cells and rows the streamed side: each cell meets one block, each row the runs of one
    # block, so Spark buffers no larger fan-out.
    def dealt(k: int, part: str) -> DataFrame:
        own = blocks.select(F.col("block").alias(f"block_{k}"), part).hint("merge")
        return cells.join(own, f"block_{k}").repartition(tasks, *on)

    rows = dealt(1, "rows").select(*groups, *on, F.explode("rows").alias("a"))
    runs = dealt(2, "runs").select(*on, F.explode("runs").alias("run"))
    left = rows.select(*groups, *on, F.col("a.value").alias("value_1"), F.col("a.id").alias("id_1"))
    right = runs.select(*[F.col(c).alias(f"__{c}") for c in on], "run.*").hint("merge")
    meet = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__{c}") for c in on])
    near = left.join(right, meet & (F.col("hi") >= F.col("value_1")) & _may_be_near(F.col("lo"), F.col("value_1"), gap))
    found = near.select(*groups, "value_1", "id_1", F.explode("rows").alias("b")).select(
        *groups, "value_1", "id_1", F.col("b.value").alias("value_2"), F.col("b.id").alias("id_2")
    )
    after = (F.col("value_2") > F.col("value_1")) | (
        (F.col("value_2") == F.col("value_1")) & (F.col("id_2") > F.col("id_1"))
    )
    close = F.lit(True) if gap is None else F.col("value_2") - F.col("value_1") <= gap
    return found.where(after & close).select(*groups, "id_1", "id_2")


def band_stats(
    df: DataFrame, groups: Sequence[str], value: str, gap: int, sums: Mapping[str, Column], maxima: Mapping[str, Column]
) -> DataFrame:
    """Per distinct (group, value): aggregates over all rows of the group within ``gap`` of it.

    ``gap`` is a whole number in the unit of ``value``.

    Rows are first combined per distinct value, then every bucket of width ``gap`` receives a
    copy of its two neighbours. The two ends of every value's band are marker rows among them, so
    that one running pass upwards and one downwards suffice: a sum is the difference of the running
    totals at its markers, and since a band covers its own bucket whole, a maximum is the larger of
    the running maxima from that bucket up to one end and down to the other. No frame slides and
    no pair is formed; a window holds at most the distinct values of three buckets.
    """
    from pyspark.sql import Window

    grouped = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in maxima.items()]
    )
    names = [*sums, *maxima]
    homed = grouped.withColumn("__home", F.floor(F.col(value) / gap))
    near = homed.withColumn("__b", F.explode(F.array(F.col("__home") - 1, F.col("__home"), F.col("__home") + 1)))
    rows = near.select(*groups, "__b", "__home", value, F.col(value).cast("double").alias("__at"), F.lit(1).alias("__kind"), *names)
    ends = F.array(
        F.struct((F.col(value) - gap).cast("double").alias("at"), F.lit(0).alias("kind")),
        F.struct((F.col(value) + gap).cast("double").alias("at"), F.lit(2).alias("kind")),
    )
    empty = [F.lit(None).cast(grouped.schema[n].dataType).alias(n) for n in names]
    markers = homed.select(*groups, F.col("__home").alias("__b"), "__home", value, F.explode(ends).alias("e")).select(
        *groups, "__b", "__home", value, F.col("e.at").alias("__at"), F.col("e.kind").alias("__kind"), *empty
    )
    place = ["__at", "__kind"]
    part = Window.partitionBy(*groups, "__b")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = part.orderBy(*place).rowsBetween(*so_far)
    down = part.orderBy(*[F.col(c).desc() for c in place]).rowsBetween(*so_far)
    lower, upper = F.col("__kind") == 0, F.col("__kind") == 2
    swept = rows.unionByName(markers).withColumns(
        {n: F.coalesce(F.sum(n).over(up), F.lit(0)) for n in sums}
        | {f"__up_{n}": F.max(F.when(F.col("__home") >= F.col("__b"), F.col(n))).over(up) for n in maxima}
        | {f"__down_{n}": F.max(F.when(F.col("__home") <= F.col("__b"), F.col(n))).over(down) for n in maxima}
    )
    return swept.where(F.col("__kind") != 1).groupBy(*groups, value).agg(
        *[(F.max(F.when(upper, F.col(n))) - F.max(F.when(lower, F.col(n)))).alias(n) for n in sums],
        *[F.greatest(F.max(F.when(upper, F.col(f"__up_{n}"))), F.max(F.when(lower, F.col(f"__down_{n}")))).alias(n) for n in maxima],
    )


def latest_valid(
    left: DataFrame, right: DataFrame, key: str, by: str, tie: Sequence[str]
) -> DataFrame:
    """Left join with the newest right row per key (largest ``by``, then ``tie`` ascending)."""
    newest = top_per_group(right, [key], [F.col(by).desc_nulls_last(), *[F.col(t).asc() for t in tie]], 1)
    return left.join(newest, key, "left")


def reconcile(
    a: DataFrame, b: DataFrame, key: Sequence[str], pairs: Mapping[str, tuple[str, str]], how: str = "inner"
) -> DataFrame:
    """Largest absolute difference per pair of columns over the joined keys, in one row."""
    left = a.select(*key, *[F.col(x).alias(f"__a_{n}") for n, (x, _) in pairs.items()])
    right = b.select(*key, *[F.col(y).alias(f"__b_{n}") for n, (_, y) in pairs.items()])
    return left.join(right, list(key), how).agg(
        *[F.max(F.abs(F.col(f"__a_{n}") - F.col(f"__b_{n}"))).alias(n) for n in pairs]
    )
