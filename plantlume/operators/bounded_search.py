"""Best selection per portfolio under two budgets, a count, a minimum share, needs and conflicts.

The candidates of all portfolios stay a DataFrame while a Lagrangian bound is tightened: prices for
the budgets, for a place and for a missing member of the required kind turn the limits into one
number per item, and of items that exclude each other only the best counts. One aggregation tries
many prices for all portfolios at once. With the value of a first selection, the bound rules out
every item that could not be part of a better one. What is left of a portfolio, the core, is
searched depth first with the same bound over the rest; the core is bounded by ``core`` items and
``nodes`` steps, and where it does not close, the gap is reported, not hidden.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, release
from .ordering import top_per_group

PRICES = ("on_cost", "on_cost_2", "on_place", "on_kind")
FIRST_CORE = 96  # items of the first search, which only gives a value to beat
CORE = 1500
NODES = 200_000
ROUNDS = 5
FACTORS = (0.0, 0.5, 0.8, 1.25, 2.0)
OPENERS = (0.02, 0.1, 0.4, 1.0, 3.0)
EPS = 1e-6


def reduced() -> Column:
    """Value of an item after the prices of what it uses."""
    p = F.col("price")
    return (
        F.col("value") - p["on_cost"] * F.col("cost") - p["on_cost_2"] * F.col("cost_2") - p["on_place"]
        + p["on_kind"] * F.col("kind")
    )


def _room(limits_price: Column) -> Column:
    """What the limits themselves are worth at these prices."""
    p = limits_price
    return (
        p["on_cost"] * F.col("room") + p["on_cost_2"] * F.col("room_2") + p["on_place"] * F.col("places") - p["on_kind"] * F.col("missing")
    )


def _trials(unit: dict[str, str]) -> Column:
    """Prices to try: those at hand, and each of them varied alone (from a unit where it is zero)."""

    def prices(changed: str = "", value: str = "") -> str:
        return "named_struct(" + ", ".join(f"'{p}', {value if p == changed else f'price.{p}'}" for p in PRICES) + ")"

    tried = [prices()] + [
        prices(name, f"CASE WHEN price.{name} > 0 THEN price.{name} * {factor}D ELSE ({unit[name]}) * {opener}D END")
        for name in PRICES for factor, opener in zip(FACTORS, OPENERS)
    ]
    return F.expr(f"array({', '.join(tried)})")


def lagrangian(items: DataFrame, limits: DataFrame, keys: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """``keys, price, bound``: prices per portfolio and what no selection of its items can exceed.

    ``items``: keys, ``value, cost, cost_2, kind`` (1 counts for the minimum) and ``clique``, of which at
    most one item can be taken. ``limits``: keys, ``room, room_2, places, missing``.
    """
    zero = F.struct(*[F.lit(0.0).alias(p) for p in PRICES])
    state = limits.select(*keys, "room", "room_2", "places", "missing", zero.alias("price"), F.lit(None).cast("double").alias("bound"))
    for turn in range(rounds + 1):
        trials = F.array(F.col("price")) if turn == 0 else _trials(
            {
                "on_cost": "greatest(bound, 1D) / greatest(room, 1D)", "on_cost_2": "greatest(bound, 1D) / greatest(room_2, 1D)",
                "on_place": "greatest(bound, 1D) / greatest(places, 1D)", "on_kind": "CASE WHEN missing > 0 THEN greatest(bound, 1D) ELSE 0D END",
            }
        )
        varied = state.select(*keys, "room", "room_2", "places", "missing", F.posexplode(trials).alias("trial", "tried"))
        tried = varied.withColumnRenamed("tried", "price")
        best = (
            items.join(tried.select(*keys, "trial", "price"), list(keys))
            .groupBy(*keys, "trial", "clique").agg(F.max(reduced()).alias("r"))
            .groupBy(*keys, "trial").agg(F.sum(F.greatest("r", F.lit(0.0))).alias("sum"))
        )
        rated = tried.join(best, [*keys, "trial"], "left").withColumn("bound", F.coalesce("sum", F.lit(0.0)) + _room(F.col("price")))
        best_yet = durable(
            rated.groupBy(*keys).agg(
                *[F.first(c).alias(c) for c in ("room", "room_2", "places", "missing")],
                F.min(F.struct("bound", "trial", "price")).alias("best"),
            ).select(*keys, "room", "room_2", "places", "missing", "best.price", "best.bound"),
            "bounds",
        )
        release(state)
        state = best_yet
    return state


def search(
    items: pd.DataFrame, room: float, room_2: float, places: int, missing: int, price: dict, conflict_gap: float, nodes: int, beat: float
) -> dict:
    """Best set of the items by depth-first search; only values above ``beat`` are looked for.

    Items come after what they need; a branch is cut when its value and the bound over the items
    behind it don't exceed the best so far. Returns ids, value (None: nothing found), the greatest
    bound left open, and the number of nodes.
    """
    rows = items.to_dict("records")
    at = {r["id"]: k for k, r in enumerate(rows)}
    for r in rows:
        r["r"] = r["value"] - price["on_cost"] * r["cost"] - price["on_cost_2"] * r["cost_2"] - price["on_place"] + price["on_kind"] * r["kind"]
    waits = [sum(n in at for n in r["needs"]) for r in rows]
    able = [all(n in at for n in r["needs"]) for r in rows]
    users: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        for n in r["needs"]:
            if n in at:
                users.setdefault(at[n], []).append(k)
    ready = [(-r["r"], r["id"], k) for k, r in enumerate(rows) if not waits[k]]
    heapq.heapify(ready)
    order = []
    while ready:
        k = heapq.heappop(ready)[2]
        order.append(rows[k] | {"able": able[k]})
        for u in users.get(k, ()):
            waits[u] -= 1
            able[u] &= able[k]
            if not waits[u]:
                heapq.heappush(ready, (-rows[u]["r"], rows[u]["id"], u))
    order = [r for r in order if r["able"]]
    n = len(order)
    rest, kinds, best_of = [0.0] * (n + 1), [0] * (n + 1), {}
    for k in range(n - 1, -1, -1):
        old = best_of.get(order[k]["clique"], 0.0)
        best_of[order[k]["clique"]] = max(old, order[k]["r"])
        rest[k] = rest[k + 1] + max(old, order[k]["r"]) - old
        kinds[k] = kinds[k + 1] + order[k]["kind"]

    def clashes(x: dict, taken: tuple) -> bool:
        while taken:
            y, taken = taken
            if y["grp"] == x["grp"] and (abs(y["cost"] - x["cost"]) <= conflict_gap or (y["quick"] == 1 and x["quick"] == 1)):
                return True
        return False

    def has(taken: tuple, wanted: set) -> bool:
        while taken and wanted:
            wanted = wanted - {taken[0]["id"]}
            taken = taken[1]
        return not wanted

    def limit(k, value, a, b, s, q) -> float:
        return value + rest[k] + price["on_cost"] * a + price["on_cost_2"] * b + price["on_place"] * s - price["on_kind"] * q

    best, chosen, seen, left_open = beat, (), 0, float("-inf")
    stack = [(0, 0.0, room, room_2, places, missing, ())]
    while stack:
        k, value, a, b, s, q, taken = stack.pop()
        if q > min(kinds[k], s):
            continue
        reach = limit(k, value, a, b, s, q)
        if reach <= best + EPS:
            continue
        if seen >= nodes:
            left_open = max(left_open, reach)
            continue
        seen += 1
        if k == n or s == 0:
            if q <= 0 and value > best + EPS:
                best, chosen = value, taken
            continue
        x = order[k]
        stack.append((k + 1, value, a, b, s, q, taken))
        if x["cost"] <= a + EPS and x["cost_2"] <= b + EPS and has(taken, set(x["needs"])) and not clashes(x, taken):
            stack.append((k + 1, value + x["value"], a - x["cost"], b - x["cost_2"], s - 1, q - x["kind"], (x, taken)))
    ids = []
    while chosen:
        ids.append(chosen[0]["id"])
        chosen = chosen[1]
    return {"ids": sorted(ids), "value": best if best > beat else None, "open": left_open, "nodes": seen}


FOUND = "ids array<string>, value double, open double, nodes long"


def _searched(items: DataFrame, state: DataFrame, keys: Sequence[str], conflict_gap: float, nodes: int) -> DataFrame:
    """``search`` per portfolio; ``state`` has its limits, prices and the value to beat."""
    kinds = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        got = search(
            pdf[["id", "grp", "clique", "value", "cost", "cost_2", "kind", "quick", "needs"]], first["room"], first["room_2"],
            int(first["places"]), int(first["missing"]), {p: first[p] for p in PRICES}, conflict_gap, nodes, first["beat"],
        )
        return pd.DataFrame([[*key, got["ids"], got["value"], got["open"], got["nodes"]]], columns=[*keys, "ids", "value", "open", "nodes"])

    priced = items.join(
        state.select(*keys, "room", "room_2", "places", "missing", "beat", *[F.col("price")[p].alias(p) for p in PRICES]), list(keys)
    )
    return priced.groupBy(*keys).applyInPandas(one, f"{kinds}, {FOUND}")


def best_selection(
    candidates: DataFrame, limits: DataFrame, keys: Sequence[str], conflict_gap: float, core: int = CORE, nodes: int = NODES,
    first_core: int = FIRST_CORE, rounds: int = ROUNDS,
) -> DataFrame:
    """``keys, ids, value, bound, nodes, core_items`` per portfolio of ``limits``.

    ``candidates``: keys, ``id, grp, value, cost, cost_2, kind, quick, needs`` (array: ids that must be
    taken too). Two items of a ``grp`` exclude each other if their costs are within ``conflict_gap``
    or both are ``quick``. ``limits``: keys, ``room, room_2, places, missing`` (how many of ``kind``
    1 must be taken). ``value`` and ``ids`` are NULL where nothing feasible was found. ``bound`` is
    what no selection exceeds: the value itself where the search is complete, NULL where it is
    complete and nothing is feasible.
    """
    bucket = F.when(F.col("quick") == 1, F.lit("quick")).otherwise(F.floor(F.col("cost") / conflict_gap).cast("string"))
    items = durable(candidates.withColumn("clique", F.concat_ws("|", "grp", bucket)), "candidates")
    state = lagrangian(items, limits, keys, rounds)
    worth = items.join(state.select(*keys, "price"), list(keys)).withColumn("r", reduced()).drop("price")
    nothing = F.lit(float("-inf"))
    opening = top_per_group(worth, keys, [F.desc("r"), F.asc("id")], first_core)
    enablers = opening.select(*keys, F.explode("needs").alias("id")).distinct()  # one step down; the second search has all
    opening = opening.unionByName(worth.join(enablers, [*keys, "id"], "left_semi")).dropDuplicates([*keys, "id"])
    first = durable(_searched(opening, state.withColumn("beat", nothing), keys, conflict_gap, nodes), "first-search")
    aimed = durable(
        state.join(first.select(*keys, "ids", F.col("value").alias("found")), list(keys), "left")
        .withColumn("beat", F.coalesce("found", nothing)),
        "value-to-beat",
    )
    # With the item, its clique counts for it instead of for the best: if that can't beat the value found, it is out.
    tops = worth.groupBy(*keys, "clique").agg(F.greatest(F.max("r"), F.lit(0.0)).alias("top"))
    rated = worth.join(tops, [*keys, "clique"]).join(aimed.select(*keys, "bound", "beat"), list(keys))
    needed = candidates.select(*keys, F.explode("needs").alias("id")).distinct().withColumn("is_needed", F.lit(1))
    rated = rated.join(needed, [*keys, "id"], "left").withColumn("with_it", F.col("bound") - F.col("top") + F.col("r"))
    alive = durable(
        rated.where((F.col("with_it") > F.col("beat") + EPS) | F.col("is_needed").isNotNull()).drop("top", "bound", "beat", "is_needed"), "core"
    )
    inside = durable(top_per_group(alive, keys, [F.desc("with_it"), F.asc("id")], core), "core")
    outside = alive.join(inside.select(*keys, "id"), [*keys, "id"], "left_anti").groupBy(*keys).agg(F.max("with_it").alias("outside"))
    second = _searched(inside, aimed, keys, conflict_gap, nodes)
    sizes = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("core_items"))
    joined = (
        aimed.join(second.withColumnsRenamed({"ids": "ids_2", "value": "value_2"}), list(keys), "left")
        .join(outside, list(keys), "left").join(sizes, list(keys), "left")
    )
    empty = F.when(F.col("missing") <= 0, 0.0)  # nothing to choose from: the empty selection, if it is feasible
    none = F.when(F.col("missing") <= 0, F.array().cast("array<string>"))
    value = F.coalesce("value_2", "found", empty)
    open_bound = F.least("bound", F.greatest("open", "outside"))
    return joined.select(
        *keys,
        F.when(F.col("value_2").isNotNull(), F.col("ids_2")).when(F.col("found").isNotNull(), F.col("ids")).otherwise(none).alias("ids"),
        value.alias("value"),
        F.when(F.greatest("open", "outside") > F.coalesce(value, nothing) + EPS, open_bound).otherwise(value).alias("bound"),
        F.coalesce("nodes", F.lit(0)).alias("nodes"),
        F.coalesce("core_items", F.lit(0)).alias("core_items"),
    )
