"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in shuffled order. A document finishes at its virtual
time, the words of its source up to and with it divided by the source's target; the mix is the
order of virtual times, cut where the total budget is reached. A source that may be repeated is
queued again behind itself.

Running totals never sort a whole source in one task: the rows of a source are dealt into about
sqrt(rows) slices by their shuffle key, the slice totals are summed up first (sqrt(rows) rows per
source), and windows run inside one slice only. The cut is found alike, on slices of virtual time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, size: Column, seed: int) -> Column:
    """Place in the shuffled order: the same for every run and every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string")))


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = 1.5, max_repeat: int = 2
) -> DataFrame:
    """Target of every source from its rows ``source, size``: ``source, rows, source_size, target``.

    ``weights`` are dealt in turn to the sources by code point, null last. The budget, ``ratio``
    of all sizes, is shared by weight; no target exceeds ``max_repeat`` times its source, and what
    that leaves over is shared anew among the others. That fixed point is a level: the sources
    with the least room per weight are full, the others get the level times their weight.

    The windows here run over one row per source, not over documents.
    """
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per_source.withColumn(
        "weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    )
    room = F.col("source_size") * max_repeat
    by_room = Window.orderBy(room / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("budget", F.sum("source_size").over(everything) * ratio)
        .withColumn("room", room)
        .withColumn("full", F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level if exactly the sources before this one were full
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("is_full", F.col("room") <= F.col("level") * F.col("weight"))
        .withColumn("last", F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("is_full"), F.col("room").cast("double")).otherwise(F.col("last") * F.col("weight"))
    return level.select("source", "rows", "source_size", target.alias("target"))


def _slice(key: Column, slices: Column) -> Column:
    """Slice of a row by the leading 32 bits of its key, in key order."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / 4294967296.0 * slices).cast("long")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    ratio: float = 1.5,
    max_repeat: int = 2,
    seed: int = 17,
) -> DataFrame:
    """Mix of ``docs`` (``doc_id``, ``text``, ``source``), one row per document row.

    Returns ``doc_id, source, size, source_size, target, virtual_time, times, taken``: the virtual
    finish time of the first copy (order by it to write the mix), how often the mix takes the
    document and the words that makes. Every source takes its target within one document; ties
    break by source, key and id. A null text has size 0 and is never taken, null sources are one
    source, rows repeated with one id are rows of their own. No rows give no rows; other columns
    are ignored. ``max_repeat`` bounds what is taken of a document.
    """
    sized = stored(
        docs.select("doc_id", "source", words_in(F.col("text")).alias("size")).withColumn(
            "key", shuffle_key(F.col("doc_id"), F.col("size"), seed)
        ),
        "mix-sizes",
    )
    targets = stored(source_targets(sized, weights, ratio, max_repeat), "mix-targets")
    per = targets.withColumnRenamed("source", "of_source")
    known = sized.join(per, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    dealt = known.withColumn("slice", _slice(F.col("key"), F.ceil(F.sqrt("rows"))))

    totals = dealt.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("o_source"), F.col("slice").alias("o_slice"),
        F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = (
        Window.partitionBy("source", "slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    queued = (
        dealt.withColumn("run", F.sum("size").over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")))
        .withColumn("cumulative", F.col("run") + F.col("offset"))
    )
    timed = stored(
        queued.select(
            "doc_id", "source", "size", "key", "source_size", "target", "rows", "cumulative",
            F.try_divide(F.col("cumulative").cast("double"), F.col("target")).alias("virtual_time"),
        ),
        "mix-queue",
    )

    budget, documents = min(ratio, max_repeat) * (targets.agg(F.sum("source_size")).first()[0] or 0), timed.count()
    cut = _cut(timed, budget, math.ceil(math.sqrt(documents)), max_repeat)
    times = F.lit(0)
    for turn in range(max_repeat):
        taken = F.lit(True) if cut is None else _place(_time(turn), turn) < cut
        times = times + F.when(taken, 1).otherwise(0)
    times = F.when((F.col("size") > 0) & (F.col("target") > 0), times).otherwise(0).cast("long")
    return timed.withColumn("times", times).select(
        "doc_id", "source", "size", "source_size", "target", "virtual_time", "times", (F.col("size") * F.col("times")).alias("taken")
    )


def _time(turn: int) -> Column:
    return F.try_divide(F.col("cumulative") + turn * F.col("source_size"), F.col("target"))


def _place(time: Column, turn: int | Column) -> Column:
    """A struct that orders the entries: virtual time, then source (null last), key, id (null last), turn."""
    return F.struct(
        time.alias("time"), F.col("source").isNull().alias("no_source"), F.col("source").alias("source"), F.col("key").alias("key"),
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), (F.lit(turn) if isinstance(turn, int) else turn).alias("turn"),
    )


def _cut(timed: DataFrame, budget: float, cells: int, max_repeat: int) -> Column | None:
    """Place of the first entry beyond the budget; None if all fit.

    All entries are counted in cells of equal time, behind time 2 of equal ratio, since a long
    document can finish late; only the cell in which the budget is reached is sorted. Three single
    rows come to the driver: the crossed cell, and the cut.
    """
    entries = (
        timed.where((F.col("size") > 0) & (F.col("target") > 0))
        .withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(max_repeat)])))
        .withColumn("time", F.try_divide(F.col("cumulative") + F.col("turn") * F.col("source_size"), F.col("target")))
        .withColumn("cell", F.floor(F.when(F.col("time") <= 2, F.col("time")).otherwise(1 + F.log2("time")) * cells))
    )
    counted = entries.groupBy("cell").agg(F.sum("size").alias("cell_size"))
    # a few times sqrt(documents) rows
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    crossed = (
        counted.withColumn("before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
        .where((F.col("before") <= budget) & (F.col("before") + F.col("cell_size") > budget))
        .first()
    )
    if crossed is None:
        return None
    place = _place(F.col("time"), F.col("turn"))
    upto = Window.partitionBy("cell").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = (
        entries.where(F.col("cell") == crossed["cell"])
        .withColumn("sum", F.sum("size").over(upto) + crossed["before"])
        .where(F.col("sum") > budget)
        .agg(F.min(place).alias("cut"))
    )
    kind, value = out.schema["cut"].dataType, out.first()["cut"]
    return F.struct(*[F.lit(value[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
