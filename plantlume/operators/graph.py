"""Directed graphs as edge tables: levels, cycles, closure, values along dependencies.

Levels come from peeling: nodes without an open parent leave, then those that waited only for
them. A round writes the nodes that leave and nothing else; the remaining edges are written again
only when half of them are gone. Once at most ``local_edges`` edges are left, the long thin rest of a deep
graph is peeled in one task, so that its depth costs no further rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .tables import spread_distinct

LOCAL_EDGES = 100_000


def nodes_of(edges: DataFrame, parent: str, child: str) -> DataFrame:
    return (
        edges.select(F.col(parent).alias("node"))
        .unionByName(edges.select(F.col(child).alias("node")))
        .distinct()
    )


def _peel(pdf: pd.DataFrame, start: int) -> pd.DataFrame:
    """Levels of the nodes of a small edge table, from ``start``; none for nodes on or behind a cycle."""
    codes, names = pd.factorize(pd.concat([pdf["p"], pdf["c"]], ignore_index=True))
    parent, child = codes[: len(pdf)], codes[len(pdf) :]
    order = np.argsort(parent, kind="stable")
    child, first = child[order], np.searchsorted(parent[order], np.arange(len(names) + 1))
    waits, level = np.bincount(child, minlength=len(names)), np.full(len(names), -1)
    frontier = np.flatnonzero(waits == 0)
    while len(frontier):
        level[frontier] = start
        start += 1
        reached = np.concatenate([child[first[k] : first[k + 1]] for k in frontier] or [np.empty(0, int)])
        np.subtract.at(waits, reached, 1)
        reached = np.unique(reached)
        frontier = reached[waits[reached] == 0]
    return pd.DataFrame({"node": names, "level": pd.array(np.where(level < 0, None, level), dtype="Int32")})


def topological_levels(edges: DataFrame, parent: str, child: str, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Level of every node (0 without parents); nodes on or behind a cycle get NULL.

    A node is placed as soon as its last parent is. Equal edges count once. Rows written: every
    edge and every node once, and halves of the edges while more than ``local_edges`` are left.
    """
    left = durable(spread_distinct(edges.select(F.col(parent).alias("p"), F.col(child).alias("c"))), "edges")
    kind = left.schema["p"].dataType.simpleString()
    n_left = n_stored = left.count()
    if n_left <= local_edges:
        return _peeled(left, kind, 0)
    placed: list[DataFrame] = []
    since: list[DataFrame] = []  # frontiers since the edges were written
    rest, level = left, 0
    free = left.select(F.col("p").alias("node")).distinct().join(left.select(F.col("c").alias("node")), "node", "left_anti")
    frontier = durable(free.withColumn("level", F.lit(level)), "levels")
    while True:
        if frontier.isEmpty():
            tail = nodes_of(rest, "p", "c").withColumn("level", F.lit(None).cast("int"))
            for f in placed:
                tail = tail.join(f, "node", "left_anti")
            break
        out = left.join(frontier.select(F.col("node").alias("p")), "p", "left_semi")
        n_left -= out.count()
        placed.append(frontier)
        since.append(frontier)
        rest = left
        for f in since:
            rest = rest.join(f.select(F.col("node").alias("p")), "p", "left_anti")
        level += 1
        free = out.select(F.col("c").alias("node")).distinct().join(rest.select(F.col("c").alias("node")), "node", "left_anti")
        frontier = durable(free.withColumn("level", F.lit(level)), "levels")
        if n_left <= local_edges:
            tail = _peeled(rest, kind, level).unionByName(frontier.join(nodes_of(rest, "p", "c"), "node", "left_anti"))
            break
        if 2 * n_left <= n_stored:
            left, since, n_stored = durable(rest, "edges"), [], n_left
    for f in placed:
        tail = tail.unionByName(f)
    return tail


def _peeled(edges: DataFrame, kind: str, start: int) -> DataFrame:
    """Levels of a small edge table, in one task."""
    return edges.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: _peel(pdf[["p", "c"]], start), f"node {kind}, level int")


def cyclic_nodes(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes that cannot be ordered; empty for an acyclic graph."""
    return topological_levels(edges, parent, child).where(F.col("level").isNull()).select("node")


def upstream_closure(seed: DataFrame, edges: DataFrame, node: str, needs: str, allowed: DataFrame) -> DataFrame:
    """``seed`` plus everything it needs, directly or not, as far as ``allowed`` goes.

    ``seed`` and ``allowed`` have the column ``node``. A step writes only the nodes that it reaches.
    """
    links = edges.select(F.col(node).alias("node"), F.col(needs).alias("needed")).distinct()
    reached = frontier = durable(seed.select("node").distinct(), "closure")
    while True:
        step = (
            frontier.join(links, "node")
            .select(F.col("needed").alias("node"))
            .distinct()
            .join(allowed.select("node"), "node", "left_semi")
            .join(reached, "node", "left_anti")
        )
        frontier = durable(step, "closure")
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def along_needs(items: DataFrame, node: str, needs: str, value: str, rate: str) -> DataFrame:
    """What each item is worth with all that builds on it, and how its chain of needs holds it back.

    An item may have rows for several needs; needs that are not among the items count as met. Adds
    * ``level``: steps from an item that needs nothing (NULL on or behind a cycle),
    * ``closure_value``: its value and that of everything that needs it, where positive: no set of
      items that includes it and what it needs gains more through it,
    * ``chain_rate``, ``chain_item``: the least ``rate`` on its way to an item that needs nothing (its
      own included) and the first item, from there, that has it.

    One pass per level in each direction; a pass writes the items of its level.
    """
    ends = items.select(F.col(node).alias(needs)).distinct()
    links = durable(items.select(node, needs).join(ends, needs, "left_semi").distinct(), "needs")
    base = items.groupBy(node).agg(F.first(value).alias("value"), F.first(rate).alias("rate"))
    if links.isEmpty():
        return base.select(
            node, F.lit(0).alias("level"), F.col("value").alias("closure_value"), F.col("rate").alias("chain_rate"), F.col(node).alias("chain_item")
        )
    levels = durable(topological_levels(links, needs, node).withColumnRenamed("node", node), "levels")
    linked = durable(base.join(levels, node), "levelled")
    depth = linked.agg(F.max("level")).first()[0]
    cyclic = linked.where(F.col("level").isNull()).select(
        node, "level", F.col("value").alias("closure_value"), F.col("rate").alias("chain_rate"), F.col(node).alias("chain_item")
    )
    alone = base.join(levels, node, "left_anti").select(
        node, F.lit(0).alias("level"), F.col("value").alias("closure_value"), F.col("rate").alias("chain_rate"), F.col(node).alias("chain_item")
    )
    worth: DataFrame | None = None
    for level in range(depth if depth is not None else -1, -1, -1):
        here = linked.where(F.col("level") == level)
        if worth is not None:
            gains = worth.where("closure_value > 0").join(links, node).groupBy(F.col(needs).alias(node)).agg(F.sum("closure_value").alias("gain"))
            here = here.join(gains, node, "left")
        else:
            here = here.withColumn("gain", F.lit(None).cast("double"))
        step = durable(here.select(node, "level", "rate", (F.col("value") + F.coalesce("gain", F.lit(0.0))).alias("closure_value")), "worth")
        worth = step if worth is None else worth.unionByName(step)
    if worth is None:
        return alone.unionByName(cyclic)
    chains: DataFrame | None = None
    for level in range(depth + 1):
        here = worth.where(F.col("level") == level)
        own = F.struct(F.col("rate").alias("chain_rate"), F.lit(level).alias("at"), F.col(node).alias("chain_item"))
        if chains is None:
            low = own
        else:
            above = chains.select(F.col(node).alias(needs), F.struct("chain_rate", "at", "chain_item").alias("held")).join(links, needs)
            here = here.join(above.groupBy(node).agg(F.min("held").alias("held")), node, "left")
            low = F.least(F.col("held"), own)  # equal rates: the item nearer to the start of the chain
        here = here.withColumn("low", low).select(node, "level", "closure_value", "low.chain_rate", "low.at", "low.chain_item")
        step = durable(here, "chains")
        chains = step if chains is None else chains.unionByName(step)
    return chains.drop("at").unionByName(alone).unionByName(cyclic)
