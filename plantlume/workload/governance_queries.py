"""Quality checks, snapshots, waivers and readiness, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.graph import topological_levels
from ..operators.ordering import steps_down
from ..operators.profile import column_profile, contract_checks, duplicate_rows, table_profile
from ..operators.tables import literal_table
from ..plans import lineage, portfolio, quality, readiness
from .catalog import define, final, query
from .layers import Layers, PlannedLayers
from .roles import SOURCES, table

RAW = (
    "plantas", "lineas_proceso", "equipos", "consumos_energia_horarios", "produccion_turno", "desvios_proceso",
    "paradas", "mantenimientos", "iniciativas_mejora", "capex_proyectos", "contexto_operativo",
    "benchmark_externo_proxy", "escenarios_mejora",
)


def _raw(layers: Layers) -> dict:
    tables = {name: layers.role(name) for name in RAW}
    tables["emisiones_estimadas"] = layers.emissions()
    return tables


# --- layer checks ---------------------------------------------------------------------------
def _count_check(name: str, source: str, condition: str, expected: str, detail: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, CASE WHEN n = 0 THEN 'OK' ELSE 'ERROR' END AS status,"
        f" n::VARCHAR AS observed, '{expected}' AS expected, '{detail}' AS detail"
        f" FROM (SELECT count(*) FILTER (WHERE {condition}) AS n FROM {source})"
    )


@query(
    "sql_layer_checks",
    "SELECT 'row_count_int_line_hour' AS check_name, CASE WHEN count(*) > 0 THEN 'OK' ELSE 'ERROR' END AS status,"
    " count(*)::VARCHAR AS observed, '>0 filas' AS expected, 'Filas de la tabla línea-hora' AS detail FROM int_line_hour"
    " UNION ALL "
    + " UNION ALL ".join(
        _count_check(*c)
        for c in (
            ("null_candidate_keys_int_line_hour", "int_line_hour", "fecha IS NULL OR linea_id IS NULL", "0 nulls", "Fecha y línea informadas en cada fila"),
            ("sec_rango_mart_line_day", "mart_line", "sec_kwh_ton < 0 OR sec_kwh_ton > 5000", "0 fuera de rango", "Consumo específico entre 0 y 5000 kWh/t"),
            ("oee_rango_mart_line_day", "mart_line", "oee_synthetic < 0 OR oee_synthetic > 1.1", "0 fuera de rango", "OEE calculado entre 0 y 1,1"),
            ("energy_cost_consistency", "mart_equipment", "consumo_kwh < 0 OR coste_energia_eur < 0", "0 negativos", "Ni energía ni coste bajo cero por equipo y día"),
            ("capex_payback_positive", "value_pool", "payback_estimado_meses <= 0", "0 no positivos", "Meses de retorno mayores que cero"),
            ("emissions_consistency", "mart_week", "emissions_kg < 0", "0 negativos", "Kilos de CO2 semanales no bajan de cero"),
        )
    ),
)
def sql_layer_checks(spark, sf):
    from ..plans import marts

    layers = Layers(spark, sf)
    return quality.sql_checks(
        layers.stored("line_hour"), layers.stored("mart_line_day"), layers.stored("mart_equipment_day"),
        layers.value_pool(), marts.mart_plant_week(layers.stored("mart_line_day")),
    )


_ISSUES = {
    ("P1", "paradas", "incoherencia_temporal_inicio_mayor_fin"): ("paradas", "fecha_fin < fecha_inicio"),
    ("P1", "mantenimientos", "incoherencia_temporal_inicio_mayor_fin"): ("mantenimientos", "fecha_fin < fecha_inicio"),
    ("P1", "consumos_energia_horarios", "consumo_kwh_no_positivo"): ("consumos_energia_horarios", "consumo_kwh <= 0"),
    ("P2", "consumos_energia_horarios", "factor_carga_fuera_rango"): (
        "consumos_energia_horarios", "factor_carga < 0 OR factor_carga > 1.2"),
    ("P2", "produccion_turno", "oee_sintetico_fuera_rango"): (
        "produccion_turno", "horas_operativas / horas_planificadas * (1 - scrap_pct / 100) * utilization_rate > 1.05"),
    ("P1", "emisiones_estimadas", "emisiones_no_coherentes_con_consumo"): (
        "emission_hours", "abs(emisiones_co2e_kg / nullif(consumo_kwh, 0) - factor_emision_proxy) > 1e-3"),
    ("P2", "desvios_proceso", "desvios_sin_impacto"): ("desvios_proceso", "impacto_en_calidad_proxy <= 0"),
    ("P1", "paradas", "paradas_sin_duracion"): ("paradas", "duracion_horas <= 0"),
    ("P2", "mantenimientos", "flags_programado_correctivo_incoherentes"): (
        "mantenimientos", "correctivo_flag = 1 AND programado_flag = 1"),
    ("P2", "capex_proyectos", "payback_no_razonable"): (
        "capex_proyectos", "payback_estimado_meses < 1 OR payback_estimado_meses > 240"),
    ("P2", "capex_proyectos", "ahorro_anual_no_positivo"): ("capex_proyectos", "ahorro_anual_estimado <= 0"),
    ("P2", "linea_turno_sec", "sec_fuera_rango"): (
        "(SELECT e.kwh / nullif(p.toneladas_producidas_proxy, 0) AS sec FROM (SELECT timestamp::DATE AS fecha,"
        " CASE WHEN hour(timestamp) BETWEEN 6 AND 13 THEN 'A' WHEN hour(timestamp) BETWEEN 14 AND 21 THEN 'B' ELSE 'C' END AS turno,"
        " linea_id, sum(consumo_kwh) AS kwh FROM consumos_energia_horarios GROUP BY ALL) e"
        " LEFT JOIN produccion_turno p USING (fecha, turno, linea_id))", "sec < 50 OR sec > 3000"),
}


@query(
    "issue_log",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{sev}' AS severity, '{tab}' AS \"table\", '{issue}' AS issue,"
        f" count(*) FILTER (WHERE {cond}) AS issue_count FROM {src}"
        for (sev, tab, issue), (src, cond) in _ISSUES.items()
    )
    + " UNION ALL SELECT 'P1', 'consumos_energia_horarios', 'duplicados_en_candidate_key', count(*)"
    " - count(DISTINCT (timestamp, equipo_id, fuente_energia)) FROM consumos_energia_horarios"
    ") WHERE issue_count > 0",
)
def issue_log(spark, sf):
    return quality.issue_log(_raw(Layers(spark, sf)))


def _plausible(name: str, source: str, value: str, ok: str, threshold: str) -> str:
    return (
        f"SELECT '{name}' AS check_name, CASE WHEN {ok} THEN 'OK' ELSE 'ERROR' END AS status,"
        f" v::DOUBLE AS observed_value, '{threshold}' AS threshold FROM (SELECT {value} AS v FROM {source})"
    )


@query(
    "plausibility_checks",
    " UNION ALL ".join(
        [
            _plausible(f"tabla_presente_{t}", "emission_hours" if t == "emisiones_estimadas" else t, "count(*)", "v > 0", ">0 filas")
            for t in (*RAW, "emisiones_estimadas")
        ]
        + [
            _plausible("historico_minimo", "contexto_operativo", "datediff('month', min(fecha), max(fecha)) + 1", "v >= 18", ">=18 meses"),
            _plausible("multiples_plantas", "plantas", "count(DISTINCT planta_id)", "v >= 3", ">=3"),
            _plausible("multiples_lineas", "lineas_proceso", "count(DISTINCT linea_id)", "v >= 8", ">=8"),
            _plausible("multiples_equipos", "equipos", "count(DISTINCT equipo_id)", "v >= 40", ">=40"),
            _plausible("scrap_rango", "produccion_turno", "bool_and(scrap_pct BETWEEN 0 AND 30)::INT", "v = 1", "[0,30]"),
            _plausible("utilization_rango", "produccion_turno", "bool_and(utilization_rate BETWEEN 0 AND 1.1)::INT", "v = 1", "[0,1.1]"),
            _plausible("horas_operativas_validas", "produccion_turno", "bool_and(horas_operativas BETWEEN 0 AND 8)::INT", "v = 1", "[0,8]"),
            _plausible("consumo_positivo", "consumos_energia_horarios", "bool_and(consumo_kwh > 0)::INT", "v = 1", ">0"),
            _plausible("factor_carga_rango", "consumos_energia_horarios", "bool_and(factor_carga BETWEEN 0 AND 1.2)::INT", "v = 1", "[0,1.2]"),
            _plausible("paradas_planificadas_presentes", "paradas", "bool_or(planificada_flag = 1)::INT", "v = 1", "al menos 1"),
            _plausible("paradas_no_planificadas_presentes", "paradas", "bool_or(planificada_flag = 0)::INT", "v = 1", "al menos 1"),
            _plausible("quickwins_presentes", "iniciativas_mejora", "bool_or(quick_win_flag = 1)::INT", "v = 1", "al menos 1"),
            _plausible("capex_presentes", "iniciativas_mejora", "bool_or(tipo_iniciativa = 'CAPEXTransformacional')::INT", "v = 1", "al menos 1"),
            _plausible("payback_corto_existente", "capex_proyectos", "bool_or(payback_estimado_meses <= 12)::INT", "v = 1", "al menos 1"),
            _plausible("payback_largo_existente", "capex_proyectos", "bool_or(payback_estimado_meses >= 36)::INT", "v = 1", "al menos 1"),
        ]
    ),
)
def plausibility_checks(spark, sf):
    return quality.plausibility(_raw(Layers(spark, sf)))


@query(
    "table_cardinality",
    "SELECT 'paradas' AS tabla, count(*) AS filas, 11 AS columnas, count(DISTINCT planta_id) AS n_plantas,"
    " count(DISTINCT linea_id) AS n_lineas, count(DISTINCT equipo_id) AS n_equipos, NULL AS periodo_inicio,"
    " NULL AS periodo_fin FROM paradas UNION ALL"
    " SELECT 'iniciativas_mejora', count(*), 12, count(DISTINCT planta_id), count(DISTINCT linea_id),"
    " count(DISTINCT equipo_id), NULL, NULL FROM iniciativas_mejora UNION ALL"
    " SELECT 'consumos_energia_horarios', count(*), 10, count(DISTINCT planta_id), count(DISTINCT linea_id),"
    " count(DISTINCT equipo_id), strftime(min(timestamp), '%Y-%m-%d %H:%M:%S'), strftime(max(timestamp), '%Y-%m-%d %H:%M:%S')"
    " FROM consumos_energia_horarios UNION ALL"
    " SELECT 'contexto_operativo', count(*), 6, count(DISTINCT planta_id), NULL, NULL, min(fecha)::VARCHAR, max(fecha)::VARCHAR"
    " FROM contexto_operativo",
)
def table_cardinality(spark, sf):
    layers = Layers(spark, sf)
    names = ("paradas", "iniciativas_mejora", "consumos_energia_horarios", "contexto_operativo")
    return quality.cardinality_summary({n: layers.role(n) for n in names})


# --- profiles on the fact tables ------------------------------------------------------------
def _profile_sql(source: str, numeric: dict[str, str], other: dict[str, str], roles: dict[str, str]) -> str:
    parts = []
    for c, t in numeric.items():
        parts.append(
            f"SELECT '{source}' AS tabla, '{c}' AS columna, '{roles[c]}' AS clasificacion, '{t}' AS dtype,"
            f" round(avg(({c} IS NULL)::INT), 6) AS null_rate, count(DISTINCT {c}) AS n_unique, min({c})::DOUBLE AS min,"
            f" quantile_cont({c}::DOUBLE, 0.5) AS p50, quantile_cont({c}::DOUBLE, 0.95) AS p95, max({c})::DOUBLE AS max FROM {source}"
        )
    for c, t in other.items():
        parts.append(
            f"SELECT '{source}', '{c}', '{roles[c]}', '{t}', round(avg(({c} IS NULL)::INT), 6), count(DISTINCT {c}),"
            f" NULL, NULL, NULL, NULL FROM {source}"
        )
    return final(
        "(" + " UNION ALL ".join(parts) + ")",
        "tabla columna clasificacion dtype null_rate~ n_unique min~ p50~ p95~ max~",
    )


@query(
    "column_profile_of_lineitem",
    _profile_sql(
        "lineitem",
        {
            "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
            "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        },
        {"l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
        {
            "l_orderkey": "metricas", "l_partkey": "metricas", "l_suppkey": "metricas", "l_linenumber": "metricas",
            "l_quantity": "metricas", "l_extendedprice": "metricas", "l_discount": "metricas", "l_tax": "metricas",
            "l_returnflag": "dimensiones", "l_linestatus": "dimensiones", "l_shipdate": "temporales",
        },
    ),
)
def column_profile_of_lineitem(spark, sf):
    return column_profile(table(spark, sf, "lineitem"), "lineitem", temporal=["l_shipdate"])


@query(
    "table_profile_of_orders",
    "SELECT 'orders' AS tabla, 'o_orderkey' AS candidate_key, count(*) AS filas, 6 AS columnas,"
    " 'o_orderdate' AS columna_temporal_referencia, min(o_orderdate)::VARCHAR AS cobertura_inicio,"
    " max(o_orderdate)::VARCHAR AS cobertura_fin, 0.0 + 0 AS null_rate_promedio,"
    " count(*) - count(DISTINCT o_orderkey) AS duplicados_candidate_key,"
    " round((count(DISTINCT o_orderkey) + count(DISTINCT o_custkey) + count(DISTINCT o_orderstatus)"
    " + count(DISTINCT o_totalprice) + count(DISTINCT o_orderdate) + count(DISTINCT o_orderpriority)) / 6, 2)::DOUBLE"
    " AS cardinalidad_promedio_columnas FROM orders",
)
def table_profile_of_orders(spark, sf):
    return table_profile(table(spark, sf, "orders"), "orders", ["o_orderkey"], ["o_orderdate"])


@query(
    "duplicate_order_lines",
    "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem",
)
def duplicate_order_lines(spark, sf):
    return duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- contracts and validity -----------------------------------------------------------------
ASSETS = (
    {
        "name": "mart_line_day",
        "grain": ["fecha", "planta_id", "linea_id"],
        "required_columns": ["fecha", "planta_id", "linea_id", "sec_kwh_ton", "oee_synthetic", "loss_value_proxy_eur"],
        "invariants": ["sec_kwh_ton >= 0", "oee_synthetic >= 0", "oee_synthetic <= 1.1", "loss_value_proxy_eur >= 0"],
    },
    {
        "name": "line_day_features_scored",
        "grain": ["fecha", "planta_id", "linea_id"],
        "required_columns": ["fecha", "planta_id", "linea_id", "sec", "oee_synthetic", "loss_value_proxy", "line_criticality_weight", "absent"],
        "invariants": ["sec >= 0", "oee_synthetic >= 0", "production_volume > 0", "absent > 0"],
    },
)
_SOURCES = {"mart_line_day": "mart_line", "line_day_features_scored": "line_scored"}


def _contract_sql() -> str:
    parts = []
    for a in ASSETS:
        name, source = a["name"], _SOURCES[a["name"]]
        missing = [c for c in a["required_columns"] if c == "absent"]
        detail = "missing=" + ",".join(missing) if missing else "all_present"
        parts.append(
            f"SELECT '{name}' AS asset, 'required_columns' AS check_type, '{'ERROR' if missing else 'OK'}' AS status,"
            f" '{detail}' AS detail, {len(missing)}::BIGINT AS failed_count"
        )
        grain = ", ".join(a["grain"])
        parts.append(
            f"SELECT '{name}', 'grain_uniqueness', CASE WHEN n = 0 THEN 'OK' ELSE 'ERROR' END, 'grain={','.join(a['grain'])}', n"
            f" FROM (SELECT count(*) - count(DISTINCT ({grain})) AS n FROM {source})"
        )
        for inv in a["invariants"]:
            if inv.startswith("absent"):
                parts.append(f"SELECT '{name}', 'invariant', 'WARN', '{inv}', 0")
                continue
            parts.append(
                f"SELECT '{name}', 'invariant', CASE WHEN n = 0 THEN 'OK' ELSE 'ERROR' END, '{inv}', n FROM"
                f" (SELECT count(*) FILTER (WHERE NOT coalesce({inv}, false)) AS n FROM {source})"
            )
    return " UNION ALL ".join(parts)


def _contract(layers: Layers):
    return contract_checks(
        {"mart_line_day": layers.stored("mart_line_day"), "line_day_features_scored": layers.stored("scored_line_days")},
        ASSETS,
    )


@query("contract_checks", _contract_sql())
def contract_checks_query(spark, sf):
    return _contract(Layers(spark, sf))


def _recorded(domain: str, check: str, severity: str, ok: str, observed: str, source: str, warn: str = "false") -> str:
    return (
        f"SELECT '{domain}' AS domain, '{check}' AS \"check\", '{severity}' AS severity, CASE WHEN {ok} THEN 'OK'"
        f" WHEN {warn} THEN 'WARN' ELSE 'ERROR' END AS status, ({observed})::VARCHAR AS observed FROM ({source})"
    )


_CHECK_OUT = ["domain", "check", "severity", "status", "observed"]


@query(
    "structural_checks",
    " UNION ALL ".join(
        [
            _recorded("structural validity", f"{n}_rows_min", "BLOCKER", f"v >= {m}", "v", f"SELECT count(*) AS v FROM {src}")
            for n, m, src in (
                ("energy", 100000, "consumos_energia_horarios"), ("production", 10000, "produccion_turno"),
                ("line_day", 1000, "line_scored"), ("equipment", 10000, "equipment_scored"), ("scenario", 100, "scenario_cube"),
            )
        ]
        + [
            _recorded("structural validity", "energy_grain_duplicates", "BLOCKER", "v = 0", "v",
                      "SELECT count(*) - count(DISTINCT (timestamp, planta_id, linea_id, equipo_id, fuente_energia)) AS v FROM consumos_energia_horarios"),
            _recorded("structural validity", "line_day_key_nulls", "BLOCKER", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE fecha IS NULL OR planta_id IS NULL OR linea_id IS NULL) AS v FROM line_scored"),
            _recorded("structural validity", "energy_temporal_parse", "BLOCKER", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE timestamp IS NULL) AS v FROM consumos_energia_horarios"),
        ]
    ),
)
def structural_checks(spark, sf):
    return _structural(PlannedLayers(spark, sf)).select(*_CHECK_OUT)


def _structural(layers: Layers):
    return quality.structural_checks(
        layers.role("consumos_energia_horarios"), layers.role("produccion_turno"), layers.stored("scored_line_days"),
        layers.stored("equipment_scores"), layers.stored("scenario_table"),
    )


def _financial(layers: Layers):
    return quality.financial_checks(layers.emissions(), layers.stored("scenario_table"), layers.stored("priorities"))


_ZERO = {
    "emissions_consistency": ("CRITICAL", "emission_hours", "abs(emisiones_co2e_kg / nullif(consumo_kwh, 0) - factor_emision_proxy) > 0.02"),
    "payback_range": ("HIGH", "priority", "payback_months < 1 OR payback_months > 180"),
    "double_counting_prevention": ("CRITICAL", "scenario_cube", "avoided_loss > baseline_non_energy_exposure + 1e-6"),
    "financial_sign_logic": (
        "CRITICAL", "scenario_cube",
        "gross_technical_value < net_operational_value - 1e-6 OR net_operational_value < net_captured_value - 1e-6"
        " OR net_captured_value < downside_adjusted_annual - 1e-6 OR downside_adjusted_annual < -1e-6"),
    "discounted_payback_consistency": ("HIGH", "priority", "npv_risk_adjusted > 0 AND payback_months > 120"),
    "financial_maturity_claim_consistency": ("CRITICAL", "priority", "false"),
}


@query(
    "financial_checks",
    " UNION ALL ".join(
        [
            _recorded("financial validity", name, sev, "v = 0", "v", f"SELECT count(*) FILTER (WHERE {cond}) AS v FROM {src}")
            for name, (sev, src, cond) in _ZERO.items()
        ]
        + [
            _recorded("financial validity", "scenario_invest_alignment", "BLOCKER", "v <= 1e-6", "round(v, 3)",
                      "SELECT coalesce(max(abs(b.s - p.annual_saving_proxy)), 0) AS v FROM (SELECT iniciativa_id,"
                      " avg(risk_adjusted_annual_savings) AS s FROM base_cube GROUP BY ALL) b JOIN priority p USING (iniciativa_id)", "v <= 1e3"),
            _recorded("financial validity", "var_downside_bounds", "CRITICAL", "a = 0 AND b = 0",
                      "'var_invalid=' || a || ';downside_invalid=' || b",
                      "SELECT count(*) FILTER (WHERE value_at_risk_95 > risk_adjusted_annual_savings + 1e-6) AS a,"
                      " count(*) FILTER (WHERE downside_annual_savings_p20 > risk_adjusted_annual_savings + 1e-6) AS b FROM scenario_cube"),
            _recorded("financial validity", "scenario_sensitivity_consistency", "HIGH", "coalesce(v >= 1.05, false)", "round(v, 4)",
                      "SELECT avg(gross_technical_value_energy) FILTER (WHERE macro_scenario = 'ShockEnergia')"
                      " / avg(gross_technical_value_energy) FILTER (WHERE macro_scenario = 'Base') AS v FROM scenario_cube", "true"),
            _recorded("financial validity", "financial_proxy_risk", "HIGH", "false", "v",
                      "SELECT 'TIR, riesgo y pérdidas son estimaciones declaradas' AS v", "true"),
        ]
    ),
)
def financial_checks(spark, sf):
    return _financial(Layers(spark, sf)).select(*_CHECK_OUT)


def _decision(layers: Layers):
    done = layers.stored("prioritization")
    return quality.decision_checks(done, portfolio.portfolio_summary(done, keys=["planta_id"]), layers.dependencies())


@query(
    "decision_checks",
    " UNION ALL ".join(
        [
            _recorded("decision validity", "portfolio_budget_constraints", "BLOCKER", "a AND b",
                      "'capex_ok=' || a || ';opex_ok=' || b",
                      "SELECT bool_and(c <= 8000000 + 1e-6) AS a, bool_and(o <= 1800000 + 1e-6) AS b FROM pressure_base"),
            _recorded("decision validity", "portfolio_dependency_consistency", "CRITICAL", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE a.selected_portfolio_flag = 1 AND coalesce(b.selected_portfolio_flag, 0) <> 1) AS v"
                      " FROM dependency d JOIN decided a USING (iniciativa_id) LEFT JOIN decided b ON b.iniciativa_id = d.depends_on_iniciativa_id"),
            _recorded("decision validity", "selected_vs_decision_rule_consistency", "CRITICAL", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE selected_portfolio_flag = 1 AND decision_rule = 'descartar') AS v FROM decided"),
        ]
    ),
)
def decision_checks(spark, sf):
    return _decision(Layers(spark, sf)).select(*_CHECK_OUT)


def _analytical(layers: Layers):
    scored = layers.stored("priorities")
    return quality.analytical_checks(
        layers.stored("scored_line_days"), scored, layers.stored("weight_sensitivity"),
        layers.stored("priority_stability"), layers.stored("ranking_robustness"),
    )


@query(
    "analytical_checks",
    " UNION ALL ".join(
        [
            _recorded("analytical validity", "sec_range", "CRITICAL", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE sec < 50 OR sec > 3000) AS v FROM line_scored"),
            _recorded("analytical validity", "oee_range", "CRITICAL", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE oee_synthetic < 0 OR oee_synthetic > 1.2) AS v FROM line_scored"),
            _recorded("analytical validity", "priority_formula_alignment", "CRITICAL", "v <= 1e-8", "round(v, 6)",
                      "SELECT max(abs(" + " + ".join(f"{w}::DOUBLE * {n}" for n, w in portfolio.PRIORITY_WEIGHTS.items())
                      + " - improvement_priority_index)) AS v FROM priority"),
            _recorded("analytical validity", "score_stability_sensitivity_overlap", "HIGH", "v >= 0.7", "v",
                      "SELECT count(*) / 10 AS v FROM sensitivity_row a JOIN sensitivity_row b USING (iniciativa_id)"
                      " WHERE a.scenario = 'base' AND b.scenario = 'energia_alta' AND a.ranking <= 10 AND b.ranking <= 10", "v >= 0.5"),
            _recorded("analytical validity", "anchored_outlier_stability_vs_legacy", "HIGH", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE anchored_outlier_median_abs_shift > legacy_outlier_median_abs_shift + 1e-9) AS v"
                      " FROM stability_row", "v > 0"),
            _recorded("analytical validity", "anchored_ranking_robustness_vs_legacy", "HIGH", "v = 0", "v",
                      "SELECT count(*) FILTER (WHERE anchored_top10_overlap_after_outlier < legacy_top10_overlap_after_outlier) AS v"
                      " FROM robustness_row", "v > 0"),
        ]
    ),
)
def analytical_checks(spark, sf):
    return _analytical(Layers(spark, sf)).select(*_CHECK_OUT)


# --- snapshots ------------------------------------------------------------------------------
def _snapshot(layers: Layers):
    return quality.kpi_snapshot(
        layers.stored("scored_line_days"), layers.stored("line_scores"), layers.stored("prioritization")
    )


define(
    "snapshot_row",
    "SELECT d.*, l.*, i.*, 'anchored_reference_linear' AS score_scaling_method, 'anchored_reference_v1' AS score_scale_version,"
    " 'screening/pre-feasibility' AS financial_readiness_label FROM (SELECT sum(production_volume) AS production_volume,"
    " avg(oee_synthetic) AS oee_synthetic, avg(sec) AS sec, sum(loss_value_proxy) AS loss_value_proxy FROM line_scored) d,"
    " (SELECT count(*) FILTER (WHERE line_criticality_score >= t) AS line_criticality_high, max(t) AS line_criticality_high_threshold"
    " FROM line_criticality, (SELECT quantile_cont(line_criticality_score, 0.75) AS t FROM line_criticality)) l,"
    " (SELECT sum(annual_saving_proxy) AS annual_saving_proxy, sum(portfolio_npv_contribution) AS portfolio_npv_risk_adjusted,"
    " sum(selected_portfolio_flag)::BIGINT AS portfolio_selected, sum(gross_technical_value_base) AS gross_technical_value_all,"
    " sum(annual_saving_proxy) AS net_captured_value_all, sum(downside_adjusted_value) AS downside_adjusted_value_all,"
    " sum(cost_of_delay_12m) AS cost_of_delay_12m_all, sum(screening_var_95_npv) AS screening_var_95_npv_all,"
    " count(*) AS contextual_score_count FROM decided) i",
)


@query(
    "kpi_snapshot",
    final(
        "snapshot_row",
        "production_volume~ oee_synthetic~ sec~ loss_value_proxy~ line_criticality_high line_criticality_high_threshold~"
        " annual_saving_proxy~ portfolio_npv_risk_adjusted~ portfolio_selected gross_technical_value_all~"
        " net_captured_value_all~ downside_adjusted_value_all~ cost_of_delay_12m_all~ screening_var_95_npv_all~"
        " contextual_score_count score_scaling_method score_scale_version financial_readiness_label",
        1,
    ),
    digits=1,
)
def kpi_snapshot(spark, sf):
    return _snapshot(Layers(spark, sf))


define(
    "decision_row",
    "SELECT * FROM (SELECT linea_id AS linea_prioritaria, line_criticality_score FROM line_criticality"
    " ORDER BY line_criticality_score DESC NULLS LAST, loss_value_proxy DESC, linea_id LIMIT 1), (SELECT equipo_id AS equipo_prioritario,"
    " avg(equipment_energy_anomaly_score) AS equipment_energy_anomaly_score FROM equipment_scored GROUP BY equipo_id, linea_id"
    " ORDER BY 2 DESC NULLS LAST, sum(downtime_hours) DESC, equipo_id LIMIT 1), (SELECT coalesce(sum(annual_saving_proxy), 0)"
    " AS ahorro_now_top5 FROM (SELECT * FROM decided WHERE decision_rule = 'ejecutar ahora'"
    " ORDER BY improvement_priority_index DESC, iniciativa_id LIMIT 5))",
)


def _decision_snapshot(layers: Layers):
    return quality.decision_snapshot(
        layers.stored("line_scores"), layers.stored("equipment_scores"), layers.stored("prioritization")
    )


@query(
    "decision_snapshot",
    final(
        "(SELECT *, 'executive_decision_v1' AS decision_logic_version FROM decision_row)",
        "linea_prioritaria line_criticality_score~ equipo_prioritario equipment_energy_anomaly_score~ ahorro_now_top5~"
        " decision_logic_version",
        3,
    ),
    digits=3,
)
def decision_snapshot(spark, sf):
    return _decision_snapshot(Layers(spark, sf))


def _cross(layers: Layers):
    return quality.cross_output_checks(
        layers.stored("scored_line_days"), layers.stored("mart_line_day"), layers.stored("scenario_table"),
        layers.stored("prioritization"), _snapshot(layers), _decision_snapshot(layers), layers.stored("line_scores"),
        layers.stored("equipment_scores"),
    )


def _agree(check: str, tier: str, gap: str, warn: float | None = None) -> str:
    band = f" WHEN gap <= {warn} THEN 'WARN'" if warn else ""
    return (
        f"SELECT '{check}' AS \"check\", CASE WHEN gap <= 1e-6 THEN 'OK'{band} ELSE 'ERROR' END AS status,"
        f" '{tier}' AS tier FROM (SELECT {gap} AS gap)"
    )


_SAVING_GAP = (
    "(SELECT coalesce(max(abs(b.s - d.annual_saving_proxy)), 0) FROM (SELECT iniciativa_id, avg({0}) AS s FROM base_cube"
    " GROUP BY ALL) b JOIN decided d USING (iniciativa_id))"
)


@query(
    "cross_output_checks",
    " UNION ALL ".join(
        [
            _agree("sec_sql_vs_python", "BLOCKER", "abs((SELECT avg(sec) FROM line_scored) - (SELECT avg(sec_kwh_ton) FROM mart_line))"),
            _agree("oee_sql_vs_python", "BLOCKER", "abs((SELECT avg(oee_synthetic) FROM line_scored) - (SELECT avg(oee_synthetic) FROM mart_line))"),
            _agree("saving_scenario_vs_invest", "CRITICAL", _SAVING_GAP.format("risk_adjusted_annual_savings"), 1e3),
            _agree("net_captured_scenario_vs_invest", "CRITICAL", _SAVING_GAP.format("net_captured_value"), 1e3),
            _agree("snapshot_production_vs_line_day", "BLOCKER", "abs((SELECT sum(production_volume) FROM line_scored) - (SELECT sum(production_volume_ton) FROM mart_line))"),
            _agree("snapshot_loss_vs_line_day", "BLOCKER", "abs((SELECT sum(loss_value_proxy) FROM line_scored) - (SELECT sum(loss_value_proxy_eur) FROM mart_line))"),
            _agree("snapshot_saving_vs_invest", "BLOCKER", "abs((SELECT sum(annual_saving_proxy) FROM decided) - (SELECT sum(annual_saving_proxy) FROM priority))"),
            _agree("decision_top_line_vs_scores", "CRITICAL", "(SELECT (linea_prioritaria <> (SELECT linea_id FROM line_criticality"
                   " ORDER BY line_criticality_score DESC NULLS LAST, loss_value_proxy DESC, linea_id LIMIT 1))::INT FROM decision_row)"),
            _agree("decision_top_equipment_vs_scores", "CRITICAL", "(SELECT (equipo_prioritario IS NULL)::INT FROM decision_row)"),
        ]
    ),
)
def cross_output_checks(spark, sf):
    return _cross(Layers(spark, sf)).select("check", "status", "tier")


# --- waivers and readiness ------------------------------------------------------------------
AS_OF = "1998-06-01"
USAGE = "committee-candidate"
_DOMAIN_CASE = "CASE c_nationkey % 7 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(readiness.DOMAINS)) + " END"
_ISSUE_SQL = (
    "SELECT 'ISS_' || c_custkey AS issue_id, " + _DOMAIN_CASE + " AS domain, c_name AS {check},"
    " CASE c_mktsegment WHEN 'BUILDING' THEN 'CRITICAL' WHEN 'MACHINERY' THEN 'HIGH' WHEN 'AUTOMOBILE' THEN 'WARNING'"
    " WHEN 'FURNITURE' THEN 'HIGH' ELSE CASE WHEN c_acctbal < -900 THEN 'BLOCKER' ELSE 'WARNING' END END AS severity,"
    " CASE WHEN c_acctbal < 0 THEN 'ERROR' WHEN c_acctbal < 3000 THEN 'WARN' ELSE 'OK' END AS status FROM {customer}"
)
_WAIVER_SQL = (
    "SELECT 'W' || o_orderkey AS waiver_id, 'ISS_' || o_custkey AS issue_id,"
    " CASE WHEN o_orderkey % 97 = 0 THEN 'sin fecha' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS fecha_caducidad,"
    " CASE o_orderpriority WHEN '1-URGENT' THEN 'committee-grade' WHEN '2-HIGH' THEN 'committee-candidate'"
    " WHEN '3-MEDIUM' THEN 'not-committee-grade' ELSE 'screening-grade-only' END AS nivel_maximo_permitido_uso,"
    " CASE o_orderstatus WHEN 'O' THEN 'activo' WHEN 'P' THEN ' Active' ELSE 'cerrado' END AS estado FROM {orders}"
)
define("issue_check", _ISSUE_SQL.format(check='"check"', customer="customer"))
define("waiver", _WAIVER_SQL.format(orders="orders"))
define(
    "waiver_rated",
    "SELECT *, CASE WHEN lower(trim(estado)) NOT IN ('activo', 'active') THEN 'inactive'"
    " WHEN try_cast(fecha_caducidad AS DATE) IS NULL THEN 'invalid_expiry'"
    f" WHEN try_cast(fecha_caducidad AS DATE) < DATE '{AS_OF}' THEN 'expired'"
    " WHEN nivel_maximo_permitido_uso NOT IN ('committee-candidate', 'committee-grade') THEN 'scope_exceeded'"
    " ELSE 'applied' END AS waiver_status FROM waiver",
)


def _issues(spark, sf):
    return spark.sql(_ISSUE_SQL.format(check="`check`", customer="{customer}"), customer=table(spark, sf, "customer"))


def _waivers(spark, sf):
    return spark.sql(_WAIVER_SQL.format(orders="{orders}"), orders=table(spark, sf, "orders"))


@query(
    "waiver_evaluation",
    "SELECT waiver_id, issue_id, waiver_status, (waiver_status = 'applied')::INT AS applied_flag,"
    f" '{USAGE}' AS evaluated_for_usage_level FROM waiver_rated",
)
def waiver_evaluation(spark, sf):
    return readiness.evaluate_waivers(_waivers(spark, sf), AS_OF, USAGE).select(
        "waiver_id", "issue_id", "waiver_status", "applied_flag", "evaluated_for_usage_level"
    )


define(
    "effective_issue",
    "SELECT i.issue_id, i.domain, i.severity, i.\"check\", i.status, coalesce(w.waiver_id, '') AS waiver_id,"
    " coalesce(w.waiver_status, 'no_waiver') AS waiver_status, coalesce((w.waiver_status = 'applied')::INT, 0) AS waived_flag,"
    " CASE WHEN w.waiver_status = 'applied' THEN 'WAIVED' ELSE i.status END AS effective_status FROM issue_check i"
    " LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY fecha_caducidad DESC, waiver_id) AS r"
    " FROM waiver_rated) w ON w.r = 1 AND w.issue_id = i.issue_id WHERE i.status <> 'OK'",
)


def _effective(spark, sf):
    return readiness.effective_issues(_issues(spark, sf), _waivers(spark, sf), AS_OF, USAGE)


@query(
    "effective_issues",
    "SELECT issue_id, domain, severity, \"check\", status, waiver_id, waiver_status, waived_flag, effective_status FROM effective_issue",
)
def effective_issues(spark, sf):
    return _effective(spark, sf).select(
        "issue_id", "domain", "severity", "check", "status", "waiver_id", "waiver_status", "waived_flag", "effective_status"
    )


@query("active_exceptions", "SELECT issue_id, waiver_id, severity FROM effective_issue WHERE effective_status = 'WAIVED'")
def active_exceptions(spark, sf):
    return readiness.active_exceptions(_effective(spark, sf)).select("issue_id", "waiver_id", "severity")


define(
    "domain_count",
    "SELECT d.domain, count(*) FILTER (WHERE severity = 'BLOCKER' AND effective_status = 'ERROR') AS open_blocker, "
    + ", ".join(
        f"count(*) FILTER (WHERE severity = '{s}' AND effective_status IN ('ERROR', 'WARN')) AS {n}"
        for s, n in (("CRITICAL", "open_critical"), ("HIGH", "open_high"), ("WARNING", "open_warning"))
    )
    + ", count(*) FILTER (WHERE waived_flag = 1) AS waived_issues FROM (VALUES "
    + ", ".join(f"('{d}')" for d in readiness.DOMAINS) + ") d(domain) LEFT JOIN effective_issue e USING (domain) GROUP BY ALL",
)
_GRADE = (
    "CASE WHEN open_blocker > 0 THEN 'D' WHEN open_critical > 0 THEN 'C' WHEN open_high > 0 THEN 'B' ELSE 'A' END"
)
define(
    "domain_state",
    "SELECT *, CASE WHEN open_blocker > 0 THEN 'publish-blocked'"
    " WHEN domain IN ('structural validity', 'semantic validity', 'release validity') THEN 'structurally-valid'"
    " WHEN domain = 'analytical validity' THEN 'analytically-acceptable'"
    " WHEN open_critical + open_high > 0 THEN CASE domain WHEN 'financial validity' THEN 'screening-grade-only'"
    " WHEN 'decision validity' THEN 'decision-support-only' ELSE 'not-committee-grade' END"
    " WHEN domain <> 'committee-readiness validity' OR open_warning > 0 THEN 'committee-candidate'"
    f" ELSE 'committee-grade' END AS state, {_GRADE} AS evidence_grade FROM domain_count",
)


@query(
    "domain_states",
    "SELECT domain, state, open_blocker, open_critical, open_high, open_warning, waived_issues, evidence_grade FROM domain_state",
)
def domain_states(spark, sf):
    return readiness.domain_states(_effective(spark, sf))


define(
    "readiness_base",
    "SELECT *, CASE WHEN blocked > 0 THEN 'publish-blocked' WHEN com = 'committee-grade' AND fin = 'committee-candidate'"
    " AND dec = 'committee-candidate' THEN 'committee-grade' WHEN com = 'committee-candidate'"
    " AND fin IN ('committee-candidate', 'screening-grade-only') AND dec IN ('committee-candidate', 'decision-support-only')"
    " THEN 'committee-candidate' WHEN com = 'not-committee-grade' THEN 'not-committee-grade'"
    " WHEN dec = 'decision-support-only' THEN dec WHEN fin = 'screening-grade-only' THEN fin"
    " WHEN ana = 'analytically-acceptable' THEN ana ELSE 'structurally-valid' END AS overall FROM (SELECT"
    " max(state) FILTER (WHERE domain = 'financial validity') AS fin, max(state) FILTER (WHERE domain = 'decision validity') AS dec,"
    " max(state) FILTER (WHERE domain = 'analytical validity') AS ana,"
    " max(state) FILTER (WHERE domain = 'committee-readiness validity') AS com, count(*) FILTER (WHERE domain IN"
    " ('structural validity', 'semantic validity', 'release validity') AND state = 'publish-blocked') AS blocked FROM domain_state), ("
    " SELECT count(*) FILTER (WHERE severity = 'BLOCKER' AND effective_status = 'ERROR') AS open_blocker,"
    " count(*) FILTER (WHERE severity = 'CRITICAL' AND effective_status IN ('ERROR', 'WARN')) AS open_critical,"
    " count(*) FILTER (WHERE severity = 'HIGH' AND effective_status IN ('ERROR', 'WARN')) AS open_high,"
    " count(*) FILTER (WHERE effective_status IN ('ERROR', 'WARN')) AS open_risks_count FROM effective_issue)",
)
define(
    "readiness_row",
    "SELECT CASE WHEN blocked > 0 THEN 'publish-blocked' ELSE 'structurally-valid' END AS technical_state, dec AS decision_state,"
    " CASE WHEN overall LIKE 'committee%' THEN overall ELSE 'not-committee-grade' END AS committee_readiness_state,"
    f" com AS committee_readiness_domain_state, overall AS overall_readiness_level, {_GRADE} AS evidence_grade,"
    " CASE WHEN open_blocker > 0 THEN 'no publish' WHEN overall LIKE 'committee%' AND open_critical = 0 THEN 'publish'"
    " ELSE 'publish with caveat' END AS publish_decision, open_blocker AS unwaived_blockers, open_critical AS unwaived_critical,"
    " open_high AS unwaived_high, open_risks_count,"
    " (overall LIKE 'committee%' AND open_blocker = 0 AND open_critical = 0)::INT AS committee_presentation_allowed FROM readiness_base",
)


def _readiness(spark, sf):
    issues = _effective(spark, sf)
    return readiness.readiness_summary(readiness.domain_states(issues), issues)


@query("readiness_summary", "SELECT * FROM readiness_row")
def readiness_summary(spark, sf):
    return _readiness(spark, sf)


@query(
    "top_open_risks",
    "SELECT issue_id, domain, severity, \"check\", effective_status, waived_flag, waiver_id FROM effective_issue"
    " ORDER BY CASE effective_status WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END DESC,"
    " CASE severity WHEN 'BLOCKER' THEN 4 WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 ELSE 1 END DESC, issue_id LIMIT 8",
)
def top_open_risks(spark, sf):
    return readiness.top_open_risks(_effective(spark, sf))


POLICIES = (
    ("minimal_public", [], []),
    ("reviewer", ["publish-blocked", "not-committee-grade"], ["publish", "publish with caveat", "no publish"]),
    ("committee", ["committee-candidate", "committee-grade"], ["publish"]),
)


@query(
    "publication_gate",
    "SELECT profile, ok::INT AS allowed, CASE WHEN ok THEN 'allowed' ELSE 'blocked_by_governance: readiness='"
    " || overall_readiness_level || '; publish_decision=' || publish_decision END AS reason FROM (SELECT profile,"
    " overall_readiness_level, publish_decision, (len(states) = 0 OR list_contains(states, overall_readiness_level))"
    " AND (len(decisions) = 0 OR list_contains(decisions, publish_decision)) AS ok FROM readiness_row, (VALUES"
    " ('minimal_public', []::VARCHAR[], []::VARCHAR[]), ('reviewer', ['publish-blocked', 'not-committee-grade'],"
    " ['publish', 'publish with caveat', 'no publish']), ('committee', ['committee-candidate', 'committee-grade'], ['publish']))"
    " p(profile, states, decisions))",
)
def publication_gate(spark, sf):
    policies = literal_table(spark, POLICIES, "profile string, states array<string>, decisions array<string>")
    return readiness.publication_gate(policies, _readiness(spark, sf))


# --- lineage --------------------------------------------------------------------------------
_SCORES = (*portfolio.PRIORITY_WEIGHTS, lineage.INDEX)


def _edge_values(pairs: list[tuple[str, str, str]]) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in pairs) + ") t(parent_node_id, child_node_id, edge_type)"


_FIXED_EDGES = (
    [(f"dataset::{u}", f"dataset::{n}", "dataset_flow") for n, _, ups, _ in lineage.DATASETS for u in ups.split(";")]
    + [(f"dataset::{u}", f"output::{o}", "dataset_flow") for o, _, ups in lineage.OUTPUTS for u in ups.split(";")]
    + [(f"metric::{m}", f"score::{s}", "metric_to_score") for m, s, _ in lineage.METRIC_TO_SCORE]
)
define(
    "lineage_edge",
    f"SELECT * FROM {_edge_values(_FIXED_EDGES)} UNION SELECT 'score::' || s.score, 'decision::DEC_' || p.iniciativa_id,"
    " 'score_to_decision' FROM iniciativas_mejora p CROSS JOIN (VALUES " + ", ".join(f"('{s}')" for s in _SCORES) + ") s(score)",
)


@query("lineage_edges", "SELECT * FROM lineage_edge")
def lineage_edges(spark, sf):
    return lineage.edges(Layers(spark, sf).role("iniciativas_mejora"))


@query(
    "lineage_nodes",
    "SELECT 'dataset::' || n AS node_id, n AS node_name, 'dataset' AS node_type, l AS layer FROM (VALUES "
    + ", ".join(f"('{n}', '{layer}')" for n, layer, _, _ in lineage.DATASETS) + ") t(n, l)"
    " UNION ALL SELECT 'metric::' || n, n, 'metric', 'semantic_layer' FROM (VALUES "
    + ", ".join(f"('{m}')" for m in dict.fromkeys(m for m, _, _ in lineage.METRIC_TO_SCORE)) + ") t(n)"
    " UNION ALL SELECT 'score::' || n, n, 'score', 'scores' FROM (VALUES " + ", ".join(f"('{s}')" for s in _SCORES) + ") t(n)"
    " UNION ALL SELECT 'output::' || n, n, 'output', 'executive_serving' FROM (VALUES "
    + ", ".join(f"('{o}')" for o, _, _ in lineage.OUTPUTS) + ") t(n)"
    " UNION ALL SELECT 'decision::DEC_' || iniciativa_id, 'DEC_' || iniciativa_id, 'decision', 'decision' FROM iniciativas_mejora",
)
def lineage_nodes(spark, sf):
    return lineage.nodes(Layers(spark, sf).role("iniciativas_mejora"))


define(
    "lineage_walk",
    "SELECT DISTINCT parent_node_id AS node, 0 AS d FROM lineage_edge WHERE parent_node_id NOT IN (SELECT child_node_id FROM lineage_edge)"
    " UNION SELECT e.child_node_id, w.d + 1 FROM lineage_walk w JOIN lineage_edge e ON e.parent_node_id = w.node",
)
@query(
    "lineage_levels",
    "SELECT level, count(*) AS n FROM (SELECT node, max(d)::INT AS level FROM lineage_walk GROUP BY node) GROUP BY level",
)
def lineage_levels(spark, sf):
    """Nodes per level of the lineage graph; an acyclic graph has no node without a level."""
    edges = lineage.edges(Layers(spark, sf).role("iniciativas_mejora"))
    return (
        topological_levels(edges, "parent_node_id", "child_node_id").groupBy("level").agg(F.count("*").alias("n"))
    )


@query(
    "recommendation_trace",
    final(
        "(SELECT d.iniciativa_id AS recommendation_id, d.selected_portfolio_flag AS selected_flag, d.decision_rule, d.portfolio_wave,"
        " d.portfolio_npv_contribution AS objective_contribution, 'Base' AS scenario_used, b.scenario_key AS scenario_key_used,"
        " CASE WHEN d.capex_estimado >= 700000 AND payback_months > 24 THEN 'alto_impacto_estructural_vs_time_to_value'"
        " WHEN payback_months <= 18 AND energy_saving_score >= 60 THEN 'captura_rapida_vs_impacto_estructural'"
        " WHEN operational_impact_score >= energy_saving_score AND operational_impact_score >= emissions_reduction_score"
        " THEN 'continuidad_operativa_vs_ahorro_energetico'"
        " WHEN emissions_reduction_score >= greatest(energy_saving_score, operational_impact_score) THEN 'descarbonizacion_vs_retorno_financiero'"
        " ELSE 'equilibrio_multicriterio' END AS trade_offs, conf AS confidence_score,"
        " CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.55 THEN 'medium' ELSE 'low' END AS confidence_band,"
        " coalesce(l.line_criticality_score, 0) AS line_criticality_score FROM (SELECT d.*, b.scenario_key AS sk,"
        " 0.5 * 0.8 + 0.3 * b.success_probability + 0.2 * (1 - uncertainty_index / 100) AS conf FROM decided d"
        " JOIN base_cube b USING (iniciativa_id)) d JOIN base_cube b USING (iniciativa_id)"
        " LEFT JOIN line_criticality l ON l.linea_id = d.linea_id)",
        "recommendation_id selected_flag decision_rule portfolio_wave objective_contribution~ scenario_used scenario_key_used"
        " trade_offs confidence_score~ confidence_band line_criticality_score~",
        3,
    ),
    digits=3,
)
def recommendation_trace(spark, sf):
    return _trace(Layers(spark, sf)).select(
        "recommendation_id", "selected_flag", "decision_rule", "portfolio_wave", "objective_contribution", "scenario_used",
        "scenario_key_used", "trade_offs", "confidence_score", "confidence_band", "line_criticality_score",
    )


def _trace(layers: Layers):
    return lineage.recommendation_trace(
        layers.stored("prioritization"), layers.stored("scenario_table"), layers.stored("scenario_ranking"),
        layers.stored("line_scores"), "committee-candidate",
    )


@query(
    "decision_lineage",
    final(
        "(SELECT 'DEC_' || d.iniciativa_id AS decision_id, d.iniciativa_id AS recommendation_id, d.selected_portfolio_flag AS selected_flag,"
        " d.decision_rule AS decision_output, '" + ";".join(_SCORES) + "' AS upstream_scores,"
        " 'dependency_penalty=' || printf('%.2f', b.dependency_penalty_pct) || ';conflict_penalty=' || printf('%.2f', b.conflict_penalty_pct)"
        " || ';constraint_reason=' || d.portfolio_constraint_reason AS constraints_applied, 'Base' AS scenario_reference,"
        " d.portfolio_npv_contribution AS objective_contribution, 'none' AS caveat_codes FROM decided d JOIN base_cube b USING (iniciativa_id))",
        "decision_id recommendation_id selected_flag decision_output upstream_scores constraints_applied scenario_reference"
        " objective_contribution~ caveat_codes",
        3,
    ),
    digits=3,
)
def decision_lineage(spark, sf):
    return lineage.decision_lineage(_trace(Layers(spark, sf)))


# Weights of the priority index, in their order.
_DRIVERS = (
    ("energy_saving_score", 0.20), ("operational_impact_score", 0.18), ("emissions_reduction_score", 0.10),
    ("implementation_feasibility_score", 0.14), ("payback_score", 0.12), ("strategic_priority_score", 0.10),
    ("financial_resilience_score", 0.10), ("uncertainty_index", 0.06),
)


@query(
    "dominant_drivers",
    "SELECT recommendation_id, string_agg(name || ':' || v::DECIMAL(32,6)::DECIMAL(28,2)::VARCHAR, ';' ORDER BY v DESC, place) AS dominant_drivers"
    " FROM (SELECT *, row_number() OVER (PARTITION BY recommendation_id ORDER BY v DESC, place) AS r FROM ("
    + " UNION ALL ".join(
        f"SELECT iniciativa_id AS recommendation_id, {i} AS place, '{n}' AS name, {w}::DOUBLE * {n} AS v FROM decided" for i, (n, w) in enumerate(_DRIVERS)
    )
    + ")) WHERE r <= 3 GROUP BY 1",
)
def dominant_drivers(spark, sf):
    return _trace(Layers(spark, sf)).select("recommendation_id", "dominant_drivers")


# --- checks along a ranking and along edges ------------------------------------------------------
@query(
    "tiers_down_the_ranking",
    "SELECT planta_id, count(*) AS initiatives, count(*) FILTER (WHERE tier_no < before) AS rises FROM (SELECT planta_id, tier_no,"
    " lag(tier_no) OVER (PARTITION BY planta_id ORDER BY improvement_priority_index DESC, iniciativa_id) AS before FROM (SELECT *,"
    " CASE WHEN improvement_priority_index >= 80 THEN 1 WHEN improvement_priority_index >= 66 THEN 2"
    " WHEN improvement_priority_index >= 52 THEN 3 ELSE 4 END AS tier_no FROM decided)) GROUP BY 1",
)
def tiers_down_the_ranking(spark, sf):
    """Initiatives of a plant whose tier is better than that of the one ranked before them: none, if tiers follow the index."""
    done = Layers(spark, sf).stored("prioritization")
    numbered = done.withColumn("tier_no", F.substring("initiative_tier", -1, 1).cast("int"))
    return steps_down(numbered, ["planta_id"], [F.desc("improvement_priority_index"), F.asc("iniciativa_id")], "tier_no")
