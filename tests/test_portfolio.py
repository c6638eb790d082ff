"""Portfolio rules on hand-made initiatives."""

import pytest

from plantlume.operators.selection import Candidates, initial_state, selected_rows, take_if_fits
from plantlume.plans.portfolio import select_portfolio, what_if_budgets

ITEM = (
    "iniciativa_id string, planta_id string, linea_id string, categoria_iniciativa string, quick_win_flag int,"
    " initiative_class string, capex_estimado double, implementation_opex double, objective_value_eur double"
)


def run(spark, items, needs, portfolio=("planta_id",)):
    """items: id, plant, category, class, capex, value."""
    rows = [(i, p, "l", c, 0, k, float(x), 1.0, float(v)) for i, p, c, k, x, v in items]
    deps = spark.createDataFrame(needs or [("none", "nothing")], "iniciativa_id string, depends_on_iniciativa_id string")
    budgets = what_if_budgets(spark).where("budget_scenario = 'base'")
    out = select_portfolio(spark.createDataFrame(rows, ITEM), deps, budgets, list(portfolio)).collect()
    return {r["iniciativa_id"] for r in out if r["selected_portfolio_flag"] == 1}, {r["iniciativa_id"]: r["preblocked"] for r in out}


def test_enabler_of_value_is_kept(spark):
    items = [("enabler", "p", "a", "discretionary", 100, -1), ("dependent", "p", "b", "discretionary", 100, 500), ("loss", "p", "c", "discretionary", 100, -5)]
    chosen, _ = run(spark, items, [("dependent", "enabler")])
    assert chosen == {"enabler", "dependent"}


def test_closure_refuses_what_clashes_with_a_forced_item(spark):
    items = [("f1", "p", "a", "mandatory", 500_000, 10), ("f2", "p", "b", "mandatory", 900_000, 10), ("x", "p", "b", "discretionary", 950_000, 10)]
    chosen, why = run(spark, items, [("f1", "x")])
    assert chosen == {"f1", "f2"} and why["x"] == "conflict_with_forced"


def test_standing_items_close_no_cycle(spark):
    items = [("forced", "p", "a", "mandatory", 700_000, 10), ("open", "p", "b", "discretionary", 100, 10), ("self", "p", "c", "discretionary", 100, 9), ("waits", "p", "d", "discretionary", 100, 9)]
    chosen, why = run(spark, items, [("forced", "forced"), ("open", "forced"), ("self", "self"), ("waits", "self")])
    assert chosen == {"forced", "open"}
    assert why["open"] is None and why["self"] == why["waits"] == "dependency_cycle"


def test_one_budget_for_the_company(spark):
    items = [(f"i{k}", f"p{k % 3}", f"c{k}", "discretionary", 3_000_000, 100 - k) for k in range(6)]
    assert run(spark, items, [], ())[0] == {"i0", "i1"}
    assert len(run(spark, items, [])[0]) == 6


def test_rounds_follow_the_picks(spark, monkeypatch):
    """Thousands of candidates that clash with the first pick take no rounds of their own."""
    from plantlume.operators import selection

    stored = []
    monkeypatch.setattr(selection, "durable", lambda df, name="x", keep=selection.durable: stored.append(name) or keep(df, name))
    rows = [(f"i{k:05d}", "p", "g", 100.0 + k % 7, 1.0, None, 0, float(-k)) for k in range(5000)]
    rows.append(("other", "p", "h", 100.0, 1.0, None, 0, 1.0))
    pool = spark.createDataFrame(rows, "id string, planta_id string, grp string, cost double, cost_2 double, needs string, quick int, o1 double")
    c = Candidates(id="id", cost="cost", cost_2="cost_2", needs="needs", group="grp", quick="quick")
    limits = spark.createDataFrame([("p", 1e6, 1e6, 24)], "planta_id string, capex_budget double, opex_budget double, max_n int")
    end = take_if_fits(pool, initial_state(limits, ["planta_id"], None, c), ["planta_id"], ["o1", "id"], 50.0, c)
    assert {r["id"] for r in selected_rows(end, ["planta_id"], "id").collect()} == {"i04999", "other"}
    assert stored.count("selection") <= 4


def test_profile_keeps_large_whole_numbers_apart(spark):
    from plantlume.operators.profile import column_profile

    df = spark.createDataFrame([(2**53 + k, float(k)) for k in range(8)], "big_id long, x double")
    got = {r["columna"]: r["n_unique"] for r in column_profile(df, "t").collect()}
    assert got == {"big_id": 8, "x": 8}


def test_shared_folder_is_required_off_one_machine():
    from plantlume.session import durable_dir

    class Conf(dict):
        def set(self, *_):
            raise AssertionError

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        durable_dir(Session())


# --- values of closures, best selections ------------------------------------------------------
def test_walk_takes_chains_and_shared_enablers(spark):
    chain = [("e1", "p", "a", "discretionary", 100, -1), ("e2", "p", "b", "discretionary", 100, -1), ("d", "p", "c", "discretionary", 100, 500)]
    assert run(spark, chain, [("e2", "e1"), ("d", "e2")])[0] == {"e1", "e2", "d"}
    shared = [("s", "p", "a", "discretionary", 100, -10), ("x", "p", "b", "discretionary", 100, 6), ("y", "p", "c", "discretionary", 100, 7)]
    assert run(spark, shared, [("x", "s"), ("y", "s")])[0] == {"s", "x", "y"}


def brute_best(items, needs, limits, gap, share):
    """Exhaustive search over the open items of one portfolio: value and sets of the best feasible selections."""
    from itertools import combinations
    from math import ceil

    rel = {i["id"] for i in items if i["cls"] == "reliability-protection"}
    missing = ceil(share * len(rel))
    best, sets = None, []
    for n in range(limits["max_n"] + 1):
        for pick in combinations(items, n):
            ids = {i["id"] for i in pick}
            if sum(i["cost"] for i in pick) > limits["capex"] + 1e-6 or sum(i["cost_2"] for i in pick) > limits["opex"] + 1e-6:
                continue
            if len(ids & rel) < missing or any(d not in ids for i in ids for d in needs.get(i, ())):
                continue
            if any(a["grp"] == b["grp"] and (abs(a["cost"] - b["cost"]) <= gap or (a["quick"] and b["quick"])) for a, b in combinations(pick, 2)):
                continue
            value = sum(i["value"] for i in pick)
            if best is None or value > best + 1e-9:
                best, sets = value, [ids]
            elif abs(value - best) <= 1e-9:
                sets.append(ids)
    return best, sets


def random_problem(seed):
    import random

    rng = random.Random(seed)
    items = [
        {"id": f"i{k:02d}", "grp": f"g{rng.randrange(4)}", "cost": float(rng.randrange(50, 900)), "cost_2": float(rng.randrange(-20, 90)),
         "value": float(rng.randrange(-60, 100)), "quick": int(rng.random() < 0.3), "cls": rng.choice(["reliability-protection", "discretionary", "discretionary"])}
        for k in range(12)
    ]
    needs = {f"i{k:02d}": [f"i{rng.randrange(k):02d}"] for k in range(1, 12) if rng.random() < 0.45}
    return items, needs, {"capex": float(rng.randrange(900, 2600)), "opex": float(rng.randrange(60, 200)), "max_n": rng.randint(2, 6)}


@pytest.mark.parametrize("options", [{}, {"core": 4, "first_core": 3}, {"nodes": 3}])
def test_best_selection_equals_exhaustive_search(spark, options):
    from math import ceil

    from plantlume.operators.bounded_search import best_selection

    problems = {f"p{seed}": random_problem(seed) for seed in range(14)}
    rows, limits = [], []
    for name, (items, needs, limit) in problems.items():
        missing = ceil(0.4 * sum(i["cls"] == "reliability-protection" for i in items))
        limits.append((name, limit["capex"], limit["opex"], float(limit["max_n"]), float(missing)))
        for i in items:
            rows.append((name, i["id"], i["grp"], i["value"], i["cost"], i["cost_2"], int(i["cls"] == "reliability-protection"), i["quick"], needs.get(i["id"], [])))
    limits += [("empty", 10.0, 10.0, 3.0, 0.0), ("hopeless", 10.0, 10.0, 3.0, 1.0)]
    candidates = spark.createDataFrame(rows, "p string, id string, grp string, value double, cost double, cost_2 double, kind int, quick int, needs array<string>")
    room = spark.createDataFrame(limits, "p string, room double, room_2 double, places double, missing double")
    got = {r["p"]: r for r in best_selection(candidates, room, ["p"], 100.0, rounds=3, **options).collect()}
    assert got.keys() == {r[0] for r in limits}
    assert (got["empty"]["ids"], got["empty"]["value"]) == ([], 0.0) and got["hopeless"]["value"] is None
    exact = 0
    for name, (items, needs, limit) in problems.items():
        best, sets = brute_best(items, needs, limit, 100.0, 0.4)
        r = got[name]
        if not options:
            assert (r["value"], r["bound"]) == (best, best)
        if best is None:
            assert r["value"] is None
            continue
        if r["value"] is not None:
            assert r["value"] <= best + 1e-6 and r["bound"] >= best - 1e-6
            assert sum(i["value"] for i in items if i["id"] in r["ids"]) == pytest.approx(r["value"])
            if r["value"] >= r["bound"] - 1e-6:
                exact += 1
                assert set(r["ids"]) in sets
        else:
            assert r["bound"] is not None and r["bound"] >= best - 1e-6
    assert exact >= (8 if not options else 1)


def optimum(spark, items, needs, share=0.6, **limits):
    from plantlume.plans.portfolio import optimal_portfolio

    rows = [(i, p, "l", c, 0, k, float(x), 1.0, float(v)) for i, p, c, k, x, v in items]
    deps = spark.createDataFrame(needs or [("none", "nothing")], "iniciativa_id string, depends_on_iniciativa_id string")
    budgets = what_if_budgets(spark, **limits).where("budget_scenario = 'base'")
    return {r["planta_id"]: r for r in optimal_portfolio(spark.createDataFrame(rows, ITEM), deps, budgets, ["planta_id"], share).collect()}


def test_optimum_keeps_the_reliability_minimum(spark):
    """A minimum that costs value is met; one that can't be met leaves the forced set alone."""
    items = [(f"r{k}", "p", f"c{k}", "reliability-protection", 100, -5 - k) for k in range(5)] + [("good", "p", "x", "discretionary", 100, 50)]
    items += [("f", "q", "a", "mandatory", 100, 1), ("r", "q", "b", "reliability-protection", 9_000_000, 5), ("g", "q", "c", "discretionary", 100, 9)]
    items += [("m", "z", "a", "mandatory", 9_000_000, 1), ("g2", "z", "c", "discretionary", 100, 9)]
    got = optimum(spark, items, [])
    assert got["p"]["selected"] == ["good", "r0", "r1", "r2"] and got["p"]["status"] == "solved_exact"
    assert (got["p"]["reliability_min"], got["p"]["reliability_selected"], got["p"]["gap_pct"]) == (3, 3, 0.0)
    assert (got["q"]["selected"], got["q"]["status"]) == (["f"], "infeasible_no_feasible_solution")
    assert (got["z"]["selected"], got["z"]["status"]) == (["m"], "infeasible_forced_constraints")


def test_optimum_beats_the_walk(spark):
    """One item of high density leaves no room for two that are worth more together; enablers go with what they enable."""
    items = [("dense", "p", "a", "discretionary", 200, 95), ("x", "p", "b", "discretionary", 110, 50), ("y", "p", "c", "discretionary", 110, 50)]
    items += [("e1", "q", "a", "discretionary", 100, -1), ("e2", "q", "b", "discretionary", 100, -1), ("d", "q", "c", "discretionary", 100, 500)]
    items += [("s", "r", "a", "discretionary", 100, -10), ("u", "r", "b", "discretionary", 100, 6), ("v", "r", "c", "discretionary", 150, 7)]
    needs = [("e2", "e1"), ("d", "e2"), ("u", "s"), ("v", "s")]
    got = optimum(spark, items, needs, capex=300.0)
    assert got["p"]["selected"] == ["x", "y"] and got["q"]["selected"] == ["d", "e1", "e2"] and got["r"]["selected"] == []
    assert optimum(spark, items, needs, capex=400.0)["r"]["selected"] == ["s", "u", "v"]


def test_scores_that_differ_in_the_last_bits_rank_by_id(spark):
    from plantlume.plans.portfolio import PRIORITY_WEIGHTS, weight_sensitivity

    rows = [("a", *[50.0] * 8), ("b", 50.0 + 1e-12, *[50.0] * 7), ("c", 50.1, *[50.0] * 7)]
    scored = spark.createDataFrame(rows, ["iniciativa_id", *PRIORITY_WEIGHTS])
    found = weight_sensitivity(scored, {"base": tuple(PRIORITY_WEIGHTS.values())}).collect()
    assert {r["iniciativa_id"]: r["ranking"] for r in found} == {"c": 1, "a": 2, "b": 3}


def stored_shapes(monkeypatch):
    """Columns and, after the run, rows of every table that is stored, by name."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen, write = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        df = self._spark.read.parquet(path)
        seen.setdefault(path.rsplit("/", 1)[-1].rsplit("-", 1)[0], []).append((len(df.columns), df.count()))

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    return seen


def test_only_needed_items_are_looked_up(spark, monkeypatch):
    """The forced set looks only at what something needs; missing, unavailable and cyclic needs are still told apart."""
    items = [(f"i{k:02d}", "p", f"c{k}", "discretionary", 100, 5) for k in range(30)] + [("m", "p", "z", "mandatory", 100, 9)]
    needs = [("m", "i00"), ("i01", "nothing"), ("i02", "i03"), ("i03", "i02"), ("i04", "i00")]
    seen = stored_shapes(monkeypatch)
    chosen = run(spark, items, needs)[0]
    assert {"m", "i00", "i04"} <= chosen and not chosen & {"i01", "i02", "i03"}
    assert seen["allowed"][0][1] == 3  # i00, i02 and i03
    assert seen["known"][0][1] == 3


def test_prioritization_stores_no_wide_rows_on_the_way(spark, monkeypatch):
    from plantlume.workload.layers import Layers

    layers = Layers(spark, "/root/testdata/sf0.001")
    layers.stored("priorities"), layers.stored("selection")
    seen = stored_shapes(monkeypatch)
    final = layers.prioritization()
    assert {width for name in ("prioritized", "sliced") for width, _ in seen[name]} <= set(range(15))
    assert final.count() == layers.stored("priorities").count() and len(final.columns) > 60


def test_value_pool_is_dealt_out(spark):
    from plantlume.workload.layers import Layers

    plan = Layers(spark, "/root/testdata/sf0.001").value_pool()._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [iniciativa_id" in plan
