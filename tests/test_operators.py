import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plantlume.operators import graph, joins, ordering, profile, robustness, selection, tables
from plantlume.operators.rolling import Trailing, with_trailing
from plantlume.session import durable


def skewed(spark, n=3000, seed=1):
    """One key holds a third of the rows, and one value a third of the values."""
    rng = random.Random(seed)
    rows = [
        (i, "hot" if rng.random() < 0.34 else f"k{rng.randint(0, 20)}", 0.0 if rng.random() < 0.34 else round(rng.uniform(0, 50), 2))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id int, k string, v double"), pd.DataFrame(rows, columns=["id", "k", "v"])


def test_positions_and_running_sums_over_hot_keys(spark):
    df, pdf = skewed(spark)
    got = ordering.with_position(df, "pos", [F.desc("v"), F.asc("id")], slices=7).toPandas().set_index("id")["pos"]
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).reset_index(drop=True)
    assert all(got[row.id] == i + 1 for i, row in enumerate(want.itertuples()))
    keyed = ordering.with_running_sum(
        df, {"s": F.col("v"), "n": F.lit(1)}, [F.asc("v"), F.asc("id")], ["k"], slices=7
    ).toPandas().set_index("id")
    ref = pdf.sort_values(["v", "id"])
    ref["s"], ref["n"] = ref.groupby("k")["v"].cumsum(), ref.groupby("k").cumcount() + 1
    ref = ref.set_index("id")
    assert np.allclose(keyed["s"].sort_index(), ref["s"].sort_index())
    assert (keyed["n"].sort_index() == ref["n"].sort_index()).all()


def test_null_keys_keep_their_positions(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, k string")
    rows = ordering.with_position(df, "pos", [F.asc("id")], ["k"]).orderBy("id").collect()
    assert [r.pos for r in rows] == [1, 2, 1]


def test_exact_quantiles_and_average_ranks(spark):
    df, pdf = skewed(spark)
    got = ordering.exact_quantiles(df, "v", {"p50": 0.5, "p95": 0.95}, ["k"]).toPandas().set_index("k")
    for k, group in pdf.groupby("k"):
        assert got.loc[k, "p50"] == pytest.approx(np.percentile(group["v"], 50))
        assert got.loc[k, "p95"] == pytest.approx(np.percentile(group["v"], 95))
    whole = ordering.exact_quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(pdf["v"].median())
    ranks = ordering.value_ranks(df, "v").toPandas().set_index("v")["rank"]
    want = pdf["v"].rank(method="average")
    assert np.allclose(pdf["v"].map(ranks), want)


def test_most_common_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("h", "z"), ("h", "z"), ("h", None)], "k string, v string")
    got = {r.k: r.m for r in ordering.most_common(df, ["k"], "v", "m").collect()}
    assert got == {"g": "a", "h": "z"}


def test_waves_equal_the_sequential_rule(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("pq"), rng.random(), rng.random() < 0.5) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, p string, score double, ok boolean")
    got = ordering.capacity_waves(df, [F.desc("score"), F.asc("id")], ["id"], F.col("ok"), 10, 10, ["p"], "w")
    got = {r.id: r.w for r in got.collect()}
    for p in "pq":
        one = two = 0
        for i, _, _, ok in sorted((r for r in rows if r[1] == p), key=lambda r: (-r[2], r[0])):
            if ok and one < 10:
                want, one = "OLA_1", one + 1
            elif two < 10:
                want, two = "OLA_2", two + 1
            else:
                want = "OLA_3"
            assert got[i] == want


def test_trailing_windows(spark):
    values = [1.0, 2.0, 4.0, 3.0, 5.0, 8.0, 2.0, 9.0, 1.0, 7.0]
    rows = [("long", i, v) for i, v in enumerate(values)] + [("short", 0, 3.0), ("short", 1, 4.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    out = with_trailing(
        df, ["k"], ["d"], {"s": Trailing("slope", "v", 7), "m": Trailing("mean", "v", 4, 3), "t": Trailing("sum", "v", 4, 3)}
    )
    rows = out.where("k = 'long'").orderBy("d").collect()
    for i, row in enumerate(rows):
        part = values[max(0, i - 6) : i + 1]
        want = 0.0 if len(part) < 3 else np.polyfit(np.arange(len(part)), part, 1)[0]
        assert row.s == pytest.approx(want, abs=1e-9)
        last = values[max(0, i - 3) : i + 1]
        assert row.m == (pytest.approx(np.mean(last)) if len(last) >= 3 else None)
        assert row.t == (pytest.approx(sum(last)) if len(last) >= 3 else None)
    assert [r.s for r in out.where("k = 'short'").collect()] == [0.0, 0.0]


STOPS = [
    ("inside", "2024-01-01 10:10:00", "2024-01-01 10:40:00"),
    ("across", "2024-01-01 10:50:00", "2024-01-01 11:20:00"),
    ("midnight", "2024-01-01 23:30:00", "2024-01-02 00:30:00"),
    ("empty", "2024-01-01 10:00:00", "2024-01-01 10:00:00"),
    ("reverse", "2024-01-01 11:00:00", "2024-01-01 10:00:00"),
    ("twice", "2024-01-01 10:00:00", "2024-01-01 11:00:00"),
    ("twice", "2024-01-01 10:30:00", "2024-01-01 11:00:00"),
]


def stops(spark):
    return spark.createDataFrame(STOPS, "k string, s string, e string").select(
        "k", F.col("s").cast("timestamp_ntz").alias("s"), F.col("e").cast("timestamp_ntz").alias("e")
    )


def test_overlap_by_hour(spark):
    got = {(r.k, r.hora.hour): r.h for r in joins.overlap_by_hour(stops(spark), ["k"], "s", "e", "h").collect()}
    assert got == {
        ("inside", 10): pytest.approx(0.5),
        ("across", 10): pytest.approx(1 / 6),
        ("across", 11): pytest.approx(1 / 3),
        ("midnight", 23): 0.5,
        ("midnight", 0): 0.5,
        ("twice", 10): 1.0,
    }


def test_overlap_by_shift_and_night_rule(spark):
    night = stops(spark).where("k = 'midnight'")
    one = joins.overlap_by_shift(night, ["k"], "s", "e", "h").collect()
    assert [(str(r.fecha), r.turno, r.h) for r in one] == [("2024-01-01", "C", 1.0)]
    two = joins.overlap_by_shift(night, ["k"], "s", "e", "h", night_to_previous_day=False).collect()
    assert sorted((str(r.fecha), r.turno, r.h) for r in two) == [("2024-01-01", "C", 0.5), ("2024-01-02", "C", 0.5)]


def test_fill_hours(spark):
    hourly = joins.overlap_by_hour(stops(spark), ["k"], "s", "e", "h")
    filled = joins.fill_hours(hourly, ["k"], "hora", ["h"])
    assert filled.count() == 4 * 15
    assert filled.where("h = 0").count() == 4 * 15 - 6


def test_pairs_and_band_stats_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), float(rng.randint(0, 900) * 1000), rng.randint(0, 1)) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, g string, v double, q int")
    pairs = {tuple(sorted((r.id_1, r.id_2))) for r in joins.near_value_pairs(df, ["g"], "id", "v", 50_000.0).collect()}
    want = {
        (a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 50_000
    }
    assert pairs == want
    stats = joins.band_stats(df, ["g"], "v", 50_000, {"n": F.lit(1)}, {"top": F.col("id")})
    for r in stats.collect():
        near = [x for x in rows if x[1] == r.g and abs(x[2] - r.v) <= 50_000]
        assert (r.n, r.top) == (len(near), max(x[0] for x in near))


def test_null_safe_join_and_group_stats(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    out = joins.with_group_stats(df, ["k"], {"m": F.avg("v")}).collect()
    assert sorted((str(r.k), r.m) for r in out) == [("None", 2.0), ("None", 2.0), ("a", 5.0)]


def test_spearman_overlap_and_outlier(spark):
    df, pdf = skewed(spark)
    pdf["w"] = pdf["v"] * 2 + (pdf["id"] % 17)
    both = df.withColumn("w", F.col("v") * 2 + F.col("id") % 17)
    got = robustness.spearman(both, "v", "w").first()[0]
    assert got == pytest.approx(pdf["v"].rank().corr(pdf["w"].rank()))
    flat = robustness.spearman(both.withColumn("c", F.lit(1.0)), "v", "c").first()[0]
    assert flat == 0.0
    overlap = robustness.topk_overlap(both, "v", "w", ["id"], 10).first()[0]
    a = set(pdf.sort_values(["v", "id"], ascending=[False, True]).head(10)["id"])
    b = set(pdf.sort_values(["w", "id"], ascending=[False, True]).head(10)["id"])
    assert overlap == len(a & b)
    # Tied maxima: exactly one row moves.
    tied = spark.createDataFrame(
        [(i, x, 0.0, 10.0, False, "s") for i, x in enumerate([1.0, 2.0, 5.0, 5.0])],
        "id int, x double, low double, high double, invert boolean, g string",
    )
    row = robustness.outlier_shifts(tied, "x", ["id"], ["low", "high", "invert"], ["g"]).first()
    assert row.anchored_outlier_median_abs_shift == 0.0
    assert row.legacy_outlier_median_abs_shift == pytest.approx(np.median([0, 25 - 100 / 14, 100 - 400 / 14]))


def test_graph_levels_cycles_and_closure(spark):
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("a", "c")], "p string, c string")
    assert {r.node: r.level for r in graph.topological_levels(dag, "p", "c").collect()} == {"a": 0, "b": 1, "c": 2}
    loop = dag.unionByName(spark.createDataFrame([("c", "b"), ("c", "d")], "p string, c string"))
    assert {r.node for r in graph.cyclic_nodes(loop, "p", "c").collect()} == {"b", "c", "d"}
    needs = spark.createDataFrame([("x", "y"), ("y", "z"), ("y", "gone")], "n string, d string")
    seed = spark.createDataFrame([("x",)], "node string")
    allowed = spark.createDataFrame([("x",), ("y",), ("z",)], "node string")
    closed = graph.upstream_closure(seed, needs, "n", "d", allowed)
    assert {r.node for r in closed.collect()} == {"x", "y", "z"}


def greedy(items, cap, cap2, max_n, gap):
    taken, used, used2 = [], 0.0, 0.0
    for it in items:
        fits = len(taken) < max_n and used + it["cost"] <= cap + 1e-6 and used2 + it["cost2"] <= cap2 + 1e-6
        need = it["needs"] is None or any(t["id"] == it["needs"] for t in taken)
        clash = any(
            t["g"] == it["g"] and (abs(t["cost"] - it["cost"]) <= gap or (t["q"] and it["q"])) for t in taken
        )
        if fits and need and not clash:
            taken.append(it)
            used, used2 = used + it["cost"], used2 + it["cost2"]
    return {t["id"] for t in taken}


@pytest.mark.parametrize("batch", [3, 50])
def test_take_if_fits_equals_the_sequential_rule(spark, batch):
    rng = random.Random(11)
    items = []
    for p in ("p", "q"):
        for i in range(60):
            items.append(
                {"p": p, "id": f"{p}{i}", "cost": round(rng.uniform(1, 30), 1), "cost2": round(rng.uniform(0, 5), 1),
                 "g": rng.choice("xyz"), "q": rng.randint(0, 1), "needs": f"{p}{rng.randint(0, 59)}" if rng.random() < 0.3 else None,
                 "place": rng.random()}
            )
    df = spark.createDataFrame([tuple(x.values()) for x in items], "p string, iniciativa_id string, cost double, cost2 double, g string, q int, needs string, place double")
    c = selection.Candidates(cost="cost", cost_2="cost2", needs="needs", group="g", quick="q")
    budgets = spark.createDataFrame([("p", 90.0, 20.0, 8), ("q", 40.0, 6.0, 30)], "p string, capex_budget double, opex_budget double, max_n int")
    state = selection.initial_state(budgets, ["p"], None, c)
    final = selection.take_if_fits(df, state, ["p"], ["place", "iniciativa_id"], 2.0, c, batch)
    got = {}
    for r in selection.selected_rows(final, ["p"], "id").collect():
        got.setdefault(r.p, set()).add(r.id)
    for p, cap, cap2, n in (("p", 90.0, 20.0, 8), ("q", 40.0, 6.0, 30)):
        order = sorted((x for x in items if x["p"] == p), key=lambda x: (x["place"], x["id"]))
        assert got.get(p, set()) == greedy(order, cap, cap2, n, 2.0)


def test_trim_and_prefix(spark):
    rows = [("p", "a", 1.0, 5.0, 1.0, 0), ("p", "b", 2.0, 5.0, 1.0, 0), ("p", "c", 3.0, 5.0, 1.0, 0), ("p", "d", 0.5, 5.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "p string, id string, value double, cost double, cost2 double, hard int")
    budgets = spark.createDataFrame([("p", 11.0, 100.0)], "p string, cap double, cap2 double")
    out = selection.trim_to_budget(df, budgets, ["p"], "value", F.col("hard") == 1, "id", {"cost": "cap", "cost2": "cap2"})
    assert {r.id: r.kept for r in out.collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    pre = selection.prefix_within_budget(df, budgets, ["p"], [F.desc("value"), F.asc("id")], {"cost": "cap"})
    assert {r.id: r.within_budget for r in pre.collect()} == {"c": 1, "b": 1, "a": 0, "d": 0}


def test_profiles_rules_and_contracts(spark):
    df = spark.createDataFrame(
        [(1, "a", 0, 2.0), (2, "b", 1, None), (2, "b", 1, 6.0), (None, None, 0, 4.0)], "x_id int, name string, on_flag int, v double"
    )
    prof = {r.columna: r for r in profile.column_profile(df, "t").collect()}
    assert prof["x_id"].clasificacion == "identificadores" and prof["on_flag"].clasificacion == "booleanas"
    assert prof["v"].clasificacion == "metricas" and prof["v"].p50 == 4.0 and prof["v"].null_rate == 0.25
    assert prof["name"].clasificacion == "dimensiones" and prof["name"].n_unique == 2
    assert profile.duplicate_rows(df, ["x_id"]).first()[0] == 1
    rows = profile.contract_checks(
        {"t": df},
        [{"name": "t", "grain": ["x_id"], "required_columns": ["v", "w"], "invariants": ["v > 3", "nope > 1"]}, {"name": "absent"}],
    ).collect()
    got = {(r.check_type, r.detail): (r.status, r.failed_count) for r in rows}
    assert got[("required_columns", "missing=w")] == ("ERROR", 1)
    assert got[("grain_uniqueness", "grain=x_id")] == ("ERROR", 1)
    assert got[("invariant", "v > 3")] == ("ERROR", 2)
    assert got[("invariant", "nope > 1")] == ("WARN", 0)
    assert got[("asset_exists", "not found")] == ("ERROR", 1)


def test_table_helpers(spark):
    df = spark.createDataFrame([(1, "Base", 1.25), (2, "x", 2.345)], "id int, s string, v double")
    assert tables.keep_matching_or_all(df, F.lower("s") == "base").count() == 1
    assert tables.keep_matching_or_all(df, F.lower("s") == "none").count() == 2
    assert [r.v for r in tables.rounded(df, 1).orderBy("id").collect()] == [1.2, 2.3]
    assert tables.stack_rows(df, df.drop("v")).where("v IS NULL").count() == 2
    a, b = tables.fingerprint(df).first(), tables.fingerprint(df.orderBy(F.desc("id"))).first()
    assert a == b and a != tables.fingerprint(df.withColumn("v", F.lit(0.0))).first()
    row = df.agg(F.sum("id").alias("a"), F.max("id").alias("b"))
    assert {r.n: r.x for r in tables.metrics_to_rows(row, ["a", "b"], "n", "x").collect()} == {"a": 3, "b": 2}
    ends = tables.edge_ends(spark.createDataFrame([("i", "j", 8.0)], "p string, q string, w double"), "p", "q", "id", ["w"])
    assert {r.id for r in ends.collect()} == {"i", "j"}
    assert durable(df.limit(0)).count() == 0


def test_join_in_cells_spreads_the_pairs_of_a_key(spark, monkeypatch):
    rows = spark.createDataFrame([("a" if k < 90 else "b" if k < 95 else None, k) for k in range(100)], "g string, i int")
    left, right = rows.withColumnRenamed("i", "x"), rows.withColumnRenamed("i", "y")
    monkeypatch.setattr(joins, "TASK_PAIRS", 100)
    dealt = joins.join_in_cells(left, right, ["g"], "x", "y", cell=7)
    assert sorted(dealt.collect()) == sorted(left.join(right, "g").collect())
    sizes = [n for n in dealt.select("x").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert sum(sizes) == 90 * 90 + 25 and max(sizes) < 1500
    assert joins.join_in_cells(left.limit(0), right, ["g"], "x", "y").count() == 0


def test_distinct_rows_are_found_in_bounded_shares(spark, monkeypatch):
    monkeypatch.setattr(tables, "SHARE_ROWS", 100)
    rows = spark.range(0, 3000, 1, 1).select((F.col("id") % 1000).alias("i"), F.when(F.col("id") % 2 == 0, "x").alias("t"))
    spread = tables.spread_distinct(rows)
    assert sorted(spread.collect(), key=repr) == sorted(rows.distinct().collect(), key=repr)
    shares = spread.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(shares) >= 30 and max(shares) < 200
    plan = tables.spread_distinct(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan  # nothing is collected before the rows are dealt


def test_lineage_edges_of_repeated_decisions(spark):
    from plantlume.plans import lineage

    once = spark.createDataFrame([("a",), ("b",)], "iniciativa_id string")
    edges = lineage.edges(once.unionByName(once))
    assert sorted(edges.collect()) == sorted(lineage.edges(once).collect()) == sorted(edges.distinct().collect())


def test_block_pairs_are_whole_and_few_are_formed_in_vain(spark, monkeypatch):
    monkeypatch.setattr(joins, "RUN_ROWS", 3)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 10)
    nan, inf = float("nan"), float("inf")
    odd = [nan, nan, inf, -inf, None, -0.0, 0.0, 0.1, 100.1, 100.1, 131072.3, 131172.3, 131172.4]
    rows = [("g", k % 3 == 0, v, f"o{k}") for k, v in enumerate(odd)] + [(None, True, 1.0, "n"), ("one", True, 5.0, "x")]
    rows += [("g", k % 4 == 0, 1000.0 + 10.0 * (k // 2), f"i{k % 97}") for k in range(300)] + [("g", True, 7.0, "d")] * 12
    df = spark.createDataFrame(rows, "g string, q boolean, v double, i string")
    blocks = joins.value_blocks(df, ["g", "q"], "i", "v")
    after = "a.g = b.g AND (b.v > a.v OR b.v = a.v AND b.i > a.i)"
    df.createOrReplaceTempView("block_rows")
    for where, gap, text in (
        (F.col("q_1") & F.col("q_2"), None, "a.q AND b.q"),
        (~(F.col("q_1") & F.col("q_2")), 100, "NOT (a.q AND b.q) AND b.v - a.v <= 100"),
    ):
        got = joins.block_pairs(blocks, ["g"], where, gap).select("g", "id_1", "id_2").collect()
        want = spark.sql(f"SELECT a.g, a.i, b.i FROM block_rows a JOIN block_rows b ON {after} AND {text}").collect()
        assert len(got) > 1000 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    wide = spark.range(2000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"), F.col("id").alias("i"))
    cells = joins.block_cells(joins.value_blocks(wide, ["g"], "i", "v"), ["g"], F.lit(True), 20)
    assert cells.agg(F.sum("pairs")).first()[0] < 2000 * 60
