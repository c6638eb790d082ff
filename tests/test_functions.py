import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlume.functions import expr, finance
from plantlume.functions.scoring import Band, anchored, anchored_by_group


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_anchored_score_is_monotone_and_bounded(spark):
    rng = random.Random(7)
    values = sorted(rng.uniform(-50, 150) for _ in range(200))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    up = [r.s for r in df.select(anchored("v", Band(0.0, 100.0)).alias("s")).collect()]
    down = [r.s for r in df.select(anchored("v", Band(0.0, 100.0, True)).alias("s")).collect()]
    assert all(a <= b for a, b in zip(sorted(up), sorted(up)[1:])) and up == sorted(up)
    assert down == sorted(down, reverse=True)
    assert min(up) == 0.0 and max(up) == 100.0


def test_anchored_score_edges(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "v double")
    assert [r.s for r in df.select(anchored("v", Band(0.0, 10.0)).alias("s")).collect()] == [None, 50.0]
    assert [r.s for r in df.select(anchored("v", Band(3.0, 3.0)).alias("s")).collect()] == [50.0, 50.0]


def test_anchored_by_group_uses_default_for_unknown_and_missing(spark):
    df = spark.createDataFrame([("a", 5.0), ("z", 5.0), (None, 5.0)], "g string, v double")
    out = df.select(anchored_by_group("v", "g", {"a": Band(0.0, 10.0)}, Band(0.0, 20.0)).alias("s")).collect()
    assert [r.s for r in out] == [50.0, 25.0, 25.0]


def test_shift_bands(spark):
    hours = [5, 6, 13, 14, 21, 22, 23, 0]
    df = spark.createDataFrame([(i, f"2024-01-02 {h:02d}:30:00") for i, h in enumerate(hours)], "i int, t string")
    ts = F.col("t").cast("timestamp_ntz")
    rows = df.select("i", expr.shift_of(ts).alias("s"), expr.shift_day(ts, True).alias("d")).orderBy("i").collect()
    assert [r.s for r in rows] == list("CAABBCCC")
    assert [str(r.d) for r in rows] == ["2024-01-01"] + ["2024-01-02"] * 6 + ["2024-01-01"]


def test_guards_and_labels(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (float("nan"), 1.0), (4.0, 2.0)], "a double, b double")
    assert [r.v for r in df.select(expr.ratio("a", "b").alias("v")).collect()][0] is None
    assert [r.v for r in df.select(expr.finite_or_zero("a").alias("v")).collect()] == [1.0, 0.0, 0.0, 4.0]
    assert [r.v for r in df.select(expr.clip("a", 2.0, 3.0).alias("v")).collect()][1] is None
    assert one(spark, expr.half_even(F.lit(2.5))) == 2 and one(spark, expr.half_even(F.lit(3.5))) == 4
    assert one(spark, expr.sequence_label("OLA_", F.lit(7))) == "OLA_07"
    assert one(spark, expr.sequence_label("OLA_", F.lit(123))) == "OLA_123"
    assert one(spark, expr.first_largest({"x": F.lit(2.0), "y": F.lit(2.0), "z": F.lit(1.0)})) == "x"
    assert one(spark, expr.top_contributions({"a": F.lit(1.0), "b": F.lit(3.0), "c": F.lit(2.0)}, 2)) == "b:3.00;c:2.00"
    assert one(spark, expr.lookup(F.lit(None).cast("string"), {"a": 1}, 9)) == 9
    assert one(spark, expr.lenient_timestamp(F.lit("no date"))) is None
    assert one(spark, expr.pattern_hits(F.lit("Committee comité COMITE"), ["committee", "comit[eé]\\b"])) == 3
    assert one(spark, expr.months_spanned(F.to_date(F.lit("2023-11-30")), F.to_date(F.lit("2024-02-01")))) == 4


def loop_npv(capex, annual, delay, ramp, months=72):
    total, payback, running = -capex, 999.0, -capex
    flows = []
    for m in range(months):
        share = 0.0 if m < delay else min(1.0, (m - delay + 1) / ramp)
        flow = annual / 12 * share
        flows.append(flow)
        running += flow / 1.1 ** ((m + 1) / 12)
        if payback == 999.0 and running >= 0:
            payback = m + 1.0
    return running, payback, [-capex] + [sum(flows[y * 12 : y * 12 + 12]) for y in range(6)]


def test_closed_form_equals_the_monthly_loop(spark):
    rng = random.Random(3)
    cases = [(0.0, 5.0, 0, 1), (100.0, 0.0, 2, 3), (100.0, 1e5, 0, 14), (1e6, 1e4, 5, 9)]
    cases += [(rng.uniform(1e4, 2e6), rng.uniform(0, 9e5), rng.randint(0, 20), rng.randint(1, 20)) for _ in range(60)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c double, a double, d int, r int")
    flows = F.array(*finance.yearly_flows("c", "a", "d", "r"))
    rows = (
        df.withColumn("f", flows)
        .select(
            "i",
            finance.net_present_value("c", "a", "d", "r").alias("npv"),
            finance.repayment("c", "a", "d", "r").alias("p"),
            "f",
            finance.internal_rate_pct(F.col("f"), 6).alias("irr"),
        )
        .orderBy("i")
        .collect()
    )
    for row, case in zip(rows, cases):
        npv, payback, yearly = loop_npv(*case)
        assert row.npv == pytest.approx(npv, abs=1e-5)
        assert row.p.payback == payback
        assert list(row.f) == pytest.approx(yearly, abs=1e-6)
        assert (row.irr is None) == (row.p.rate_pct is None)
        if row.irr is not None:
            assert row.irr == pytest.approx(row.p.rate_pct, abs=1e-6)
            assert sum(cf / (1 + row.irr / 100) ** t for t, cf in enumerate(yearly)) == pytest.approx(0, abs=1e-2)


def test_rate_needs_a_sign_change(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -3.0],), ([1.0, 2.0, 3.0],), ([-100.0, 60.0, 60.0],)], "f array<double>")
    got = [r.v for r in df.select(finance.internal_rate_pct(F.col("f"), 2).alias("v")).collect()]
    assert got[:2] == [None, None]
    assert got[2] == pytest.approx(13.0662, abs=1e-3)


def test_simple_payback_bounds(spark):
    assert one(spark, finance.simple_payback_months(F.lit(1.0), F.lit(1e6), F.lit(-5.0))) == 2.5
    assert one(spark, finance.simple_payback_months(F.lit(1e9), F.lit(1.0), F.lit(0.0))) == 180.0
    assert [one(spark, finance.payback_horizon(F.lit(m))) for m in (12, 13, 48, 49)] == [
        "0-12 meses", "12-24 meses", "24-48 meses", "48+ meses",
    ]
    assert np.isclose(one(spark, finance.captured_months(F.lit(12), F.lit(2), F.lit(4))), (1 + 2 + 3 + 4) / 4 + 6)


def test_json_text_has_a_fixed_pattern(spark):
    import json

    from plantlume.plans.serving import document_text

    rows = [('quote " back \\ line\n tab\t', 1.005, 3, None, [1.0, None, -0.125], True), (None, None, None, None, None, None), ("é", 2.675, -1, "x", [], False)]
    df = spark.createDataFrame(rows, "s string, x double, i int, n string, l array<double>, b boolean")
    got = [r[0] for r in document_text(df).collect()]
    assert [json.loads(t)["s"] for t in got] == [r[0] for r in rows]
    assert '"x":1.01' in got[0] and '"l":[1.00,null,-0.13]' in got[0] and '"b":true' in got[0]
    assert got[1] == '{"s":null,"x":null,"i":null,"n":null,"l":null,"b":null}'
    assert '"x":2.68' in got[2] and '"l":[]' in got[2]
