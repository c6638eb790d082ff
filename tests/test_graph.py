"""Levels, closures and values along dependencies against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from plantlume.operators import graph


def brute_levels(edges):
    edges = set(edges)
    nodes, levels, level = {n for e in edges for n in e}, {}, 0
    while free := {n for n in nodes - levels.keys() if all(p in levels for p, c in edges if c == n)}:
        levels.update(dict.fromkeys(free, level))
        level += 1
    return {n: levels.get(n) for n in nodes}


def levels_of(spark, edges, **how):
    df = spark.createDataFrame(edges, "p string, c string")
    got = graph.topological_levels(df, "p", "c", **how).collect()
    assert len(got) == len({r["node"] for r in got})
    return {r["node"]: r["level"] for r in got}


@pytest.mark.parametrize("local_edges", [100_000, 12, 0])
def test_levels_equal_brute_force(spark, local_edges):
    rng = random.Random(1)
    edges = [(f"n{a}", f"n{a + rng.randint(1, 9)}") for a in (rng.randrange(12) for _ in range(40))] * 2
    edges += [("x", "y"), ("y", "x"), ("y", "behind"), ("n1", "self"), ("self", "self")]
    assert levels_of(spark, edges, local_edges=local_edges) == brute_levels(edges)


def test_only_a_cycle(spark):
    assert levels_of(spark, [("a", "b"), ("b", "a")], local_edges=0) == {"a": None, "b": None}


def test_chain_is_written_once(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(graph, "durable", lambda df, name="x", keep=graph.durable: rows.append(keep(df, name)) or rows[-1])
    edges = [(f"n{k}", f"n{k + 1}") for k in range(200)]
    assert levels_of(spark, edges) == {f"n{k}": k for k in range(201)}
    assert sum(df.count() for df in rows) <= 200 + 201
    rows.clear()
    assert levels_of(spark, edges[:12], local_edges=4) == {f"n{k}": k for k in range(13)}
    assert sum(df.count() for df in rows) <= 2 * 12 + 13


def test_numbers_as_nodes(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "p long, c long")
    assert {(r["node"], r["level"]) for r in graph.topological_levels(df, "p", "c").collect()} == {(1, 0), (2, 1), (3, 2)}


def test_values_along_needs(spark):
    rng = random.Random(2)
    needs = {f"i{k}": {f"i{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 1, 2]))} for k in range(1, 25)} | {"i0": set()}
    needs |= {"a": {"b"}, "b": {"a"}, "after": {"a"}, "met": {"elsewhere"}}
    value = {i: float(rng.randint(-9, 9)) for i in needs}
    rate = {i: float(rng.randint(-5, 5)) for i in needs}
    rows = [(i, n, value[i], rate[i]) for i, ns in needs.items() for n in (ns or {None})]
    got = {r["i"]: r for r in graph.along_needs(spark.createDataFrame(rows, "i string, n string, v double, r double"), "i", "n", "v", "r").collect()}
    cyclic = {"a", "b", "after"}
    level = brute_levels([(n, i) for i, ns in needs.items() for n in ns if n in needs])

    def worth(i):
        return value[i] + sum(max(0.0, worth(d)) for d, ns in needs.items() if i in ns)

    def least(i):
        own = (rate[i], level.get(i, 0), i)
        return min([own, *(least(n) for n in needs[i] if n in needs)])

    assert got.keys() == needs.keys()
    for i in needs.keys() - cyclic:
        assert (got[i]["level"], got[i]["closure_value"]) == (level.get(i, 0), worth(i))
        assert (got[i]["chain_rate"], got[i]["chain_item"]) == (least(i)[0], least(i)[2])
    assert all(got[i]["level"] is None for i in cyclic)


def test_closure_of_a_chain_and_a_shared_enabler(spark):
    rows = [("e1", None, -1.0), ("e2", "e1", -1.0), ("d", "e2", 500.0), ("s", None, -10.0), ("x", "s", 6.0), ("y", "s", 7.0), ("z", "y", -3.0)]
    df = spark.createDataFrame(rows, "i string, n string, v double").withColumn("r", F.col("v"))
    got = {r["i"]: r["closure_value"] for r in graph.along_needs(df, "i", "n", "v", "r").collect()}
    assert got == {"e1": 498.0, "e2": 499.0, "d": 500.0, "s": 3.0, "x": 6.0, "y": 7.0, "z": -3.0}


def test_upstream_closure(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "no"), ("x", "y")], "i string, n string")
    seed = spark.createDataFrame([("a",)], "node string")
    allowed = spark.createDataFrame([("a",), ("b",), ("c",), ("y",)], "node string")
    assert sorted(r["node"] for r in graph.upstream_closure(seed, edges, "i", "n", allowed).collect()) == ["a", "b", "c"]
