"""Invariants of the composed plans on the smallest driver tables, sources and governance rules."""

import json

import pytest
from pyspark.sql import functions as F

from plantlume.operators.tables import literal_table
from plantlume.plans import lineage, portfolio, quality, readiness, scenario, sector
from plantlume.sources import readers, schemas, writers
from plantlume.workload.layers import Layers


@pytest.fixture(scope="module")
def layers(spark, sf_dir):
    return Layers(spark, sf_dir)


def test_value_chain_and_bounds(layers):
    s = layers.stored("scenario_table")
    bad = s.where(
        "gross_technical_value < net_operational_value - 1e-6 OR net_operational_value < net_captured_value - 1e-6"
        " OR net_captured_value < downside_adjusted_annual - 1e-6 OR downside_adjusted_annual < -1e-6"
        " OR value_at_risk_95 > risk_adjusted_annual_savings + 1e-6 OR avoided_loss > baseline_non_energy_exposure + 1e-6"
        " OR expected_capture_rate NOT BETWEEN 0.1 AND 0.92 OR payback_meses NOT BETWEEN 1 AND 999"
        " OR isnan(discounted_value) OR discounted_value IS NULL"
    )
    assert bad.count() == 0
    lines = layers.line_baseline().select("linea_id")
    covered = layers.role("iniciativas_mejora").join(lines, "linea_id", "left_semi")
    assert s.count() == covered.count() * 4
    ratio = s.groupBy("iniciativa_id").pivot("macro_scenario", ["Base", "ShockEnergia"]).agg(F.avg("gross_technical_value_energy"))
    assert ratio.select(F.median(F.col("ShockEnergia") / F.col("Base"))).first()[0] > 1.05


def test_feature_flags_and_scores(layers):
    eq = layers.stored("equipment_scores")
    assert eq.where("overload_events NOT IN (0, 1) OR repeated_stop_flag NOT IN (0, 1)").count() == 0
    assert eq.where("equipment_energy_anomaly_score NOT BETWEEN 0 AND 100 OR anomaly_count NOT BETWEEN 0 AND 4").count() == 0
    assert layers.stored("shift_features").where("shift_variance_score NOT BETWEEN 0 AND 100").count() == 0
    days = layers.stored("scored_line_days")
    assert days.groupBy("fecha", "planta_id", "linea_id").count().where("count > 1").count() == 0


def test_priority_index_is_the_weighted_sum(layers):
    p = layers.stored("priorities")
    gap = p.select(F.max(F.abs(portfolio.weighted_index(portfolio.PRIORITY_WEIGHTS) - F.col("improvement_priority_index")))).first()[0]
    assert gap <= 1e-8
    assert abs(sum(portfolio.PRIORITY_WEIGHTS.values()) - 1) < 1e-12
    assert all(abs(sum(w) - 1) < 1e-9 for w in portfolio.WEIGHT_SCENARIOS.values())


def test_portfolio_respects_limits_and_needs(layers):
    status, items = layers.stored("selection"), layers.stored("priorities")
    chosen = status.where("selected_portfolio_flag = 1").join(
        items.select("iniciativa_id", "capex_estimado", "implementation_opex", "initiative_class", "linea_id",
                     "categoria_iniciativa", "quick_win_flag"), "iniciativa_id"
    )
    free = chosen.where("initiative_class NOT IN ('mandatory', 'compliance-driven')")
    used = chosen.groupBy("planta_id", "budget_scenario").agg(F.sum("capex_estimado").alias("c"), F.count("*").alias("n"))
    over = used.join(free.select("planta_id", "budget_scenario").distinct(), ["planta_id", "budget_scenario"]).where(
        "c > 8800000 + 1e-6 OR n > 28"
    )
    assert over.count() == 0
    deps = layers.dependencies()
    have = chosen.select("budget_scenario", F.col("iniciativa_id").alias("depends_on_iniciativa_id"))
    unmet = free.join(deps.select("iniciativa_id", "depends_on_iniciativa_id"), "iniciativa_id").join(
        have, ["budget_scenario", "depends_on_iniciativa_id"], "left_anti"
    )
    assert unmet.count() == 0
    pairs = scenario.conflicts(layers.value_pool())
    a = chosen.select("budget_scenario", F.col("iniciativa_id").alias("iniciativa_id_1"))
    b = chosen.select("budget_scenario", F.col("iniciativa_id").alias("iniciativa_id_2"))
    assert pairs.join(a, "iniciativa_id_1").join(b, ["budget_scenario", "iniciativa_id_2"]).count() == 0


def test_tiers_fall_down_the_ranking(layers):
    final = layers.stored("prioritization")
    rows = final.orderBy(F.desc("improvement_priority_index")).select("initiative_tier").collect()
    tiers = [int(r.initiative_tier[-1]) for r in rows]
    assert tiers == sorted(tiers)
    assert final.where("selected_portfolio_flag = 1 AND portfolio_wave = 'BACKLOG'").count() == 0
    assert final.select("recommended_sequence").distinct().count() == final.count()


def test_conflict_penalties_equal_the_pairs(layers):
    pool = layers.value_pool()
    pairs = scenario.conflicts(pool)
    ends = pairs.select(F.explode(F.array("iniciativa_id_1", "iniciativa_id_2")).alias("iniciativa_id"), "conflict_penalty_pct")
    summed = ends.groupBy("iniciativa_id").agg(F.sum("conflict_penalty_pct").alias("s"))
    joined = scenario.conflict_penalties(pool).join(summed, "iniciativa_id", "left").fillna(0.0, ["s"])
    assert joined.where("abs(s - conflict_penalty_pct) > 1e-9").count() == 0


def test_conflict_numbers_equal_the_pairs_and_form_none(spark, monkeypatch):
    rows = [(f"i{k % 70:02d}", "p", f"l{k % 2}", "c", 40_000.0 * (k * 7 % 31), int(k % 3 == 0)) for k in range(80)]
    rows += [("one", "p", "l9", "c", 1.0, 1), ("none", "p", "l0", "c", None, 1), ("half", "p", None, "c", 1.0, 1)]
    pool = spark.createDataFrame(rows, "iniciativa_id string, planta_id string, linea_id string, categoria_iniciativa string, capex_estimado double, quick_win_flag int")
    pairs = scenario.conflicts(pool).select(F.explode(F.array("iniciativa_id_1", "iniciativa_id_2")).alias("iniciativa_id"))
    want = sorted(tuple(r) for r in pairs.groupBy("iniciativa_id").count().collect())
    assert sorted(tuple(r) for r in scenario.conflict_numbers(pool).collect()) == want
    from plantlume.workload import decision_queries

    monkeypatch.setattr(decision_queries.scenario, "conflicts", None)
    assert decision_queries.conflicts_per_initiative(spark, "/root/testdata/sf0.001").count() > 0


def test_conflicts_read_the_pool_once(spark, capsys):
    pool = spark.range(40).selectExpr(
        "concat('i', id) AS iniciativa_id", "'p' AS planta_id", "'l' AS linea_id", "'c' AS categoria_iniciativa",
        "id * 30000D AS capex_estimado", "CAST(id % 2 AS INT) AS quick_win_flag",
    )
    pairs = scenario.conflicts(pool)
    pairs.explain()
    assert "Range (0, 40" not in capsys.readouterr().out
    assert pairs.count() == sum(40 - d for d in (1, 2, 3)) + sum((40 - d) // 2 for d in range(4, 40, 2))


def test_snapshot_checks_and_documents(layers):
    final, days, lines = layers.stored("prioritization"), layers.stored("scored_line_days"), layers.stored("line_scores")
    snap = quality.kpi_snapshot(days, lines, final)
    contract = literal_table(layers.spark, [("OK",), ("ERROR",)], "status string")
    cross = literal_table(layers.spark, [("CRITICAL", "WARN"), ("BLOCKER", "OK")], "tier string, status string")
    rows = quality.semantic_checks(contract, cross, snap, days, portfolio.comparability_registry(layers.spark)).collect()
    got = {r.check: r.status for r in rows}
    assert got == {
        "metric_contract_errors": "ERROR", "cross_output_consistency": "WARN",
        "snapshot_metric_drift": "OK", "score_comparability_tags_valid": "OK",
    }
    assert lineage.nodes(final).count() > final.count()


def test_waiver_edges(spark):
    waivers = literal_table(
        spark,
        [
            ("w1", "ISS_a", "2030-01-01", "committee-grade", "activo"),
            ("w2", "ISS_a", "2020-01-01", "committee-grade", "activo"),
            ("w3", "ISS_b", "2020-01-01", "committee-grade", "active"),
            ("w4", "ISS_c", "2030-01-01", "screening-grade-only", "activo"),
            ("w5", "ISS_d", "never", "committee-grade", "activo"),
            ("w6", "ISS_e", "2030-01-01", "committee-grade", "cerrado"),
        ],
        "waiver_id string, issue_id string, fecha_caducidad string, nivel_maximo_permitido_uso string, estado string",
    )
    status = {r.waiver_id: r.waiver_status for r in readiness.evaluate_waivers(waivers, "2026-01-01", "committee-candidate").collect()}
    assert status == {"w1": "applied", "w2": "expired", "w3": "expired", "w4": "scope_exceeded", "w5": "invalid_expiry", "w6": "inactive"}
    checks = literal_table(
        spark,
        [("ISS_a", "structural validity", "BLOCKER", "a", "ERROR"), ("ISS_b", "financial validity", "HIGH", "b", "WARN"),
         ("ISS_z", "decision validity", "WARNING", "z", "WARN"), ("ISS_ok", "decision validity", "BLOCKER", "k", "OK")],
        "issue_id string, domain string, severity string, check string, status string",
    )
    issues = readiness.effective_issues(checks, waivers, "2026-01-01", "committee-candidate")
    assert {r.issue_id: r.effective_status for r in issues.collect()} == {"ISS_a": "WAIVED", "ISS_b": "WARN", "ISS_z": "WARN"}
    states = readiness.domain_states(issues)
    got = {r.domain: r.state for r in states.collect()}
    assert got["structural validity"] == "structurally-valid" and got["financial validity"] == "screening-grade-only"
    assert got["committee-readiness validity"] == "committee-grade"
    row = readiness.readiness_summary(states, issues).first()
    assert row.overall_readiness_level == "screening-grade-only" and row.publish_decision == "publish with caveat"
    assert row.evidence_grade == "B" and row.committee_presentation_allowed == 0


def test_csv_and_parquet_sources(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    head = [c.split()[0] for c in schemas.RAW_TABLES["iniciativas_mejora"][0].split(",")]
    (raw / "iniciativas_mejora.csv").write_text(
        ",".join(head) + "\nI1,P1,L1,,Cat,Tipo,text,1.5,2,3,4,1\nI2,P1,L1,E1,Cat,Tipo,text,1.5,2,3,4,0\n"
    )
    df = readers.read_raw(spark, str(raw), "iniciativas_mejora")
    rows = df.orderBy("iniciativa_id").collect()
    assert rows[0].equipo_id is None and rows[1].equipo_id == "E1"
    assert dict(df.dtypes)["impacto_esperado_energia_pct"] == "double"
    back = writers.materialize(df, str(tmp_path / "pq" / "iniciativas_mejora"), ["planta_id"])
    assert back.count() == 2
    writers.export({"a": df}, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "a")).count() == 2
    writers.export_ordered(df, str(tmp_path / "ordered"), [F.desc("iniciativa_id")])
    assert [r.iniciativa_id for r in spark.read.option("header", True).csv(str(tmp_path / "ordered")).collect()] == ["I2", "I1"]
    writers.publish_views({"initiatives": df})
    assert spark.sql("SELECT count(*) FROM initiatives").first()[0] == 2
    manifest = writers.sample_manifest({"s": writers.sample_head(df, [F.asc("iniciativa_id")], 1)}).first()
    assert (manifest.muestra, manifest.filas, manifest.columnas) == ("s", 1, 12)
    assert set(readers.read_all(spark, str(raw), ["iniciativas_mejora"])) == {"iniciativas_mejora"}


PROFILE = {
    "profile_id": "demo", "profile_name": "Demo", "profile_version": "1.0.0", "common_core_version_compat": "1.0.0",
    "taxonomy_mapping": {d: {"a": "A"} for d in sector.TAXONOMY_DOMAINS},
    "process_family_definitions": {"a": {"sector_process_group": "g", "benchmark_priority": "p", "kpi_focus": ["x", "y"], "operational_risk_focus": "r"}},
    "benchmark_set": {"sec_multiplier_by_family": {"a": 1.1}},
    "energy_logic": {"k": 1}, "emission_factors": {"multiplier_by_source": {"a": 1.2}, "carbon_cost_eur_ton_base": 105.0},
    "maintenance_logic": {"k": 1}, "initiative_library": {"preferred_sequence": ["a"], "mandatory_categories": ["a"]},
    "criticality_logic": {"weight": 0.5, "multiplier": {"m": 2.0}}, "constraints_by_sector": {"c": 1},
    "scenario_sensitivities": {"s": 2}, "kpi_priority": {"kpi_weights": {"k": 0.3}},
    "metric_caveats": [{"metric_name": "m", "caveat": "c", "misuse_prevention": "p"}], "misuse_risks": ["r1", "r2"],
}


def test_profile_documents(spark, tmp_path):
    (tmp_path / "demo_profile.json").write_text(json.dumps(PROFILE))
    broken = {**PROFILE, "profile_id": "broken", "common_core_version_compat": "9"}
    del broken["misuse_risks"]
    (tmp_path / "broken_profile.json").write_text(json.dumps(broken))
    profiles = readers.read_json(spark, str(tmp_path / "*_profile.json"), schemas.SECTOR_PROFILE)
    errors = {(r.sector_profile_id, r.error) for r in sector.validation_errors(profiles, "1.0.0").collect()}
    assert errors == {("broken", "missing_key=misuse_risks"), ("broken", "common_core_version_mismatch")}
    demo = profiles.where("profile_id = 'demo'")
    assert sector.taxonomy(demo).count() == 5
    assert sector.process_families(demo).first().kpi_focus == "x|y"
    assert {(r.logic_group, r.logic_key, r.logic_value) for r in sector.criticality_logic(demo).collect()} == {
        ("weights", "weight", 0.5), ("multiplier", "m", 2.0),
    }
    assert [r.risk_id for r in sector.misuse_risks(demo).orderBy("risk_id").collect()] == ["DEMO_R01", "DEMO_R02"]
    writers.export_by_profile({"risks": sector.misuse_risks(demo)}, str(tmp_path / "out"))
    assert (tmp_path / "out" / "risks" / "sector_profile_id=demo").is_dir()


def test_registry_contract_and_policy_documents(spark, tmp_path):
    registry = {"version": "1", "metric_version_set": "v", "metrics": [
        {"metric_id": "sec", "business_name": "b", "technical_name": "sec", "formula": "f", "grain": ["d"], "unit": "u", "direction": "x", "owner": "o"}]}
    (tmp_path / "r.json").write_text(json.dumps(registry))
    metrics = quality.metric_registry(readers.read_json(spark, str(tmp_path / "r.json"), schemas.METRIC_REGISTRY))
    assert lineage.metric_lineage(metrics).first().canonical_dataset == "line_day_features_scored"
    policy = {"version": "1", "profiles": {"open": {"description": "d", "governance": {}},
              "strict": {"description": "d", "governance": {"require_readiness_states": ["committee-grade"], "require_publish_decisions": ["publish"]}}}}
    (tmp_path / "p.json").write_text(json.dumps(policy))
    policies = readiness.release_policies(readers.read_json(spark, str(tmp_path / "p.json"), schemas.RELEASE_POLICY))
    now = literal_table(spark, [("not-committee-grade", "publish with caveat")], "overall_readiness_level string, publish_decision string")
    gate = {r.profile: (r.allowed, r.reason) for r in readiness.publication_gate(policies, now).collect()}
    assert gate["open"] == (1, "allowed") and gate["strict"][0] == 0 and gate["strict"][1].startswith("blocked_by_governance")


def test_constant_tables(spark):
    assert scenario.lever_library(spark).count() == 7 and scenario.macro_sensitivities(spark).count() == 4
    assert scenario.assumptions(spark).count() == 3 and scenario.logic_audit(spark).count() == 8
    assert portfolio.scaling_audit(spark).count() == 6
    assert quality.official_joins(spark).count() == 6 and quality.mart_candidates(spark).count() == 5
    assert lineage.score_lineage(spark).count() == 9 and lineage.score_to_decision(spark).count() == 3
