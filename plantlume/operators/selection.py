"""Budgeted selection over very many candidates.

Every portfolio (group) has limits on two costs and on the number of picks. Budgets are small
next to the candidate list, and they only shrink while items are taken: an item that does not fit
now, clashes with what is taken, or waits for an item that was passed over, never gets in later. So
each round looks at the next few candidates per group that none of this rules out, walks through
that short list in order, and continues behind it: rounds follow the picks, not the candidates. A
round reads the candidates once, in parallel; no group is ever gathered whole, and every candidate
is decided.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, release
from .ordering import top_per_group, with_running_sum


@dataclass(frozen=True)
class Candidates:
    """Column names of a candidate table."""

    id: str = "iniciativa_id"
    cost: str = "capex_estimado"
    cost_2: str = "implementation_opex"
    needs: str = "depends_on_iniciativa_id"  # NULL when nothing is needed
    group: str = "conflict_group"  # candidates of different groups never conflict
    quick: str = "quick_win_flag"


def _walk(conflict_gap: float, c: Candidates) -> Column:
    """Take-if-fits over the ordered short list ``items`` starting from the group's state."""

    def step(state: Column, x: Column) -> Column:
        taken = state["taken"]
        fits = (
            (state["n"] < state["max_n"])
            & (state["used"] + x["cost"] <= state["cap"] + 1e-6)
            & (state["used_2"] + x["cost_2"] <= state["cap_2"] + 1e-6)
        )
        has_needed = x["needs"].isNull() | F.exists(taken, lambda t: t["id"] == x["needs"])
        clash = F.exists(
            taken,
            lambda t: (t["grp"] == x["grp"])
            & ((F.abs(t["cost"] - x["cost"]) <= conflict_gap) | ((t["quick"] == 1) & (x["quick"] == 1))),
        )
        take = F.coalesce(fits & has_needed & ~clash, F.lit(False))
        kept = F.struct(x["id"].alias("id"), x["grp"].alias("grp"), x["cost"].alias("cost"), x["quick"].alias("quick"))
        return F.struct(
            F.when(take, F.concat(taken, F.array(kept))).otherwise(taken).alias("taken"),
            (state["n"] + F.when(take, 1).otherwise(0)).alias("n"),
            (state["used"] + F.when(take, x["cost"]).otherwise(0.0)).alias("used"),
            (state["used_2"] + F.when(take, x["cost_2"]).otherwise(0.0)).alias("used_2"),
            state["cap"].alias("cap"),
            state["cap_2"].alias("cap_2"),
            state["max_n"].alias("max_n"),
        )

    return F.aggregate("items", F.col("state"), step)


def _clashes(taken: Column, conflict_gap: float) -> Column:
    """Does the row clash with a taken item?"""
    return F.exists(
        taken,
        lambda t: (t["grp"] == F.col("grp"))
        & ((F.abs(t["cost"] - F.col("cost")) <= conflict_gap) | ((t["quick"] == 1) & (F.col("quick") == 1))),
    )


def _has_needed(taken: Column) -> Column:
    return F.exists(taken, lambda t: t["id"] == F.col("needs"))


TAKEN_TYPE = "array<struct<id: string, grp: string, cost: double, quick: int>>"


def initial_state(budgets: DataFrame, keys: Sequence[str], standing: DataFrame | None, c: Candidates) -> DataFrame:
    """State per portfolio before the walk: its limits and what a standing set already uses.

    ``budgets`` has ``capex_budget``, ``opex_budget`` and ``max_n`` per key. Only the totals of the
    standing set enter: its conflicts and the needs it meets are settled by joins beforehand, so
    it may be of any size.
    """
    limits = budgets.select(*keys, "capex_budget", "opex_budget", "max_n")
    if standing is None:
        base = limits.withColumns({"__n": F.lit(0), "__u": F.lit(0.0), "__u2": F.lit(0.0)})
    else:
        sums = standing.groupBy(*keys).agg(
            F.count("*").cast("int").alias("__n"), F.sum(c.cost).alias("__u"), F.sum(c.cost_2).alias("__u2")
        )
        base = limits.join(sums, list(keys), "left").fillna(0, ["__n", "__u", "__u2"])
    return base.select(
        *keys,
        F.struct(
            F.array().cast(TAKEN_TYPE).alias("taken"),
            F.col("__n").alias("n"),
            F.col("__u").cast("double").alias("used"),
            F.col("__u2").cast("double").alias("used_2"),
            F.col("capex_budget").cast("double").alias("cap"),
            F.col("opex_budget").cast("double").alias("cap_2"),
            F.col("max_n").cast("int").alias("max_n"),
        ).alias("state"),
    )


def take_if_fits(
    candidates: DataFrame,
    state: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    conflict_gap: float,
    c: Candidates = Candidates(),
    batch: int = 256,
) -> DataFrame:
    """Selected ids per portfolio.

    ``order`` names columns that sort the walk ascending and are unique together. ``state`` comes
    from ``initial_state``. Returns one row per portfolio with the final state.
    """
    place = F.struct(*[F.col(o) for o in order])
    pool = durable(
        candidates.select(
            *keys,
            place.alias("place"),
            F.col(c.id).cast("string").alias("id"),
            F.col(c.group).alias("grp"),
            F.col(c.cost).cast("double").alias("cost"),
            F.coalesce(F.col(c.cost_2).cast("double"), F.lit(0.0)).alias("cost_2"),
            F.col(c.needs).cast("string").alias("needs"),
            F.col(c.quick).cast("int").alias("quick"),
        ),
        "walk",
    )
    # Where the needed item stands in the walk; behind the item itself, or nowhere, it comes too late.
    needed = pool.select(*keys, F.col("id").alias("needs"), F.col("place").alias("needs_place"))
    pool = pool.join(needed, [*keys, "needs"], "left").where(F.col("needs").isNull() | (F.col("needs_place") < F.col("place")))
    pool = durable(pool, "candidates")
    no_place = F.lit(None).cast(pool.schema["place"].dataType)
    previous = current = durable(state.withColumn("behind", no_place), "selection")
    while True:
        open_state = F.col("state.n") < F.col("state.max_n")
        fitting = (
            pool.join(current.where(open_state), list(keys))
            .where(F.col("behind").isNull() | (F.col("place") > F.col("behind")))
            .where(F.col("cost") <= F.col("state.cap") - F.col("state.used") + 1e-6)
            .where(F.col("cost_2") <= F.col("state.cap_2") - F.col("state.used_2") + 1e-6)
            .where(~_clashes(F.col("state.taken"), conflict_gap))
            .where(F.col("needs").isNull() | F.col("behind").isNull() | (F.col("needs_place") > F.col("behind")) | _has_needed(F.col("state.taken")))
            .drop("state", "behind")
        )
        following = top_per_group(fitting, keys, [F.col("place").asc()], batch)
        entry = F.struct("place", "id", "grp", "cost", "cost_2", "needs", "quick")
        lists = following.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("items"))
        moved = durable(
            current.join(lists, list(keys), "left").select(
                *keys,
                F.when(F.col("items").isNull(), F.col("state")).otherwise(_walk(conflict_gap, c)).alias("state"),
                F.coalesce(F.element_at("items", -1)["place"], F.col("behind")).alias("behind"),
                F.col("items").isNotNull().alias("__moved"),
            ),
            "selection",
        )
        ended = moved.where("__moved").isEmpty()
        release(previous)
        previous, current = moved, moved.drop("__moved")
        if ended:
            release(pool)
            return current.drop("behind")


def selected_rows(state: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    return state.select(*keys, F.explode("state.taken").alias("__t")).select(
        *keys, F.col("__t.id").alias(id_col)
    )


def prefix_within_budget(
    df: DataFrame, budgets: DataFrame, keys: Sequence[str], order: Sequence[Column], costs: dict[str, str]
) -> DataFrame:
    """Longest leading part of every ordered portfolio that stays within all budgets.

    ``costs`` maps cost columns to budget columns. Uses distributed running totals, so a single
    portfolio may be arbitrarily long.
    """
    running = with_running_sum(df, {f"__run_{c}": F.col(c) for c in costs}, order, keys)
    limited = running.join(budgets, list(keys))
    over = None
    for c, b in costs.items():
        beyond = F.col(f"__run_{c}") > F.col(b) + 1e-6
        over = beyond if over is None else over | beyond
    return limited.withColumn("within_budget", F.when(over, 0).otherwise(1)).drop(
        *[f"__run_{c}" for c in costs]
    )


def trim_to_budget(
    forced: DataFrame, budgets: DataFrame, keys: Sequence[str], value: str, protected: Column, id_col: str,
    costs: dict[str, str],
) -> DataFrame:
    """Forced items with ``kept``: unprotected ones leave, lowest value first, until all budgets fit."""
    totals = forced.groupBy(*keys).agg(*[F.sum(c).alias(f"__all_{c}") for c in costs])
    marked = forced.withColumn("__protected", protected.cast("int"))
    removable = with_running_sum(
        marked.where("__protected = 0"),
        {f"__run_{c}": F.col(c) for c in costs},
        [F.col(value).asc_nulls_first(), F.col(id_col).asc()],
        keys,
    ).join(totals, list(keys)).join(budgets, list(keys))
    over = None
    for c, b in costs.items():
        # Still above the budget after everything of lower value has left.
        beyond = F.col(f"__all_{c}") - (F.col(f"__run_{c}") - F.col(c)) > F.col(b)
        over = beyond if over is None else over | beyond
    leaving = removable.where(over).select(*keys, id_col, F.lit(0).alias("kept"))
    return (
        forced.join(leaving, [*keys, id_col], "left").withColumn("kept", F.coalesce("kept", F.lit(1)))
    )
