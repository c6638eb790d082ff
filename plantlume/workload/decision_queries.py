"""Scenario cube, finance figures, portfolio selection and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import finance
from ..functions.expr import lookup
from ..operators.graph import topological_levels
from ..plans import portfolio, scenario
from .catalog import define, final, query
from .layers import Layers
from .roles import table
from .score_queries import avg_rank_sql, anc, minmax

# --- scenario inputs ------------------------------------------------------------------------
define(
    "line_baseline",
    "SELECT m.planta_id, m.linea_id, avg(m.sec_kwh_ton) AS sec_base, avg(m.oee_synthetic) AS oee_base,"
    " sum(m.cost_energy_total) AS cost_energy_base, sum(m.emissions_kg) AS emissions_base_kg,"
    " sum(m.loss_value_proxy_eur) AS loss_base_eur, sum(m.n_paradas)::BIGINT AS stops_base,"
    " avg(l.criticidad_linea) AS criticidad_linea FROM mart_line m JOIN lineas_proceso l USING (linea_id)"
    " GROUP BY m.planta_id, m.linea_id",
)
define(
    "macro_shock",
    "SELECT escenario, avg(precio_energia_shock) AS precio_energia_shock,"
    " avg(presion_demanda_indice) AS presion_demanda_indice,"
    " avg(disponibilidad_personal_indice) AS disponibilidad_personal_indice,"
    " avg(restriccion_operativa_indice) AS restriccion_operativa_indice FROM escenarios_mejora GROUP BY ALL",
)


@query(
    "macro_shocks",
    final(
        "macro_shock",
        "escenario precio_energia_shock~ presion_demanda_indice~ disponibilidad_personal_indice~"
        " restriccion_operativa_indice~",
        6,
    ),
    digits=6,
)
def macro_shocks(spark, sf):
    return Layers(spark, sf).macro_shocks()


define(
    "dependency",
    "SELECT v.iniciativa_id, d.iniciativa_id AS depends_on_iniciativa_id, v.linea_id FROM value_pool v JOIN ("
    " SELECT *, row_number() OVER (PARTITION BY planta_id, linea_id ORDER BY capex_estimado DESC, iniciativa_id) AS r"
    " FROM value_pool WHERE regexp_matches(tipo_iniciativa, 'Mantenimiento|Optim', 'i')) d"
    " ON d.r = 1 AND d.planta_id = v.planta_id AND d.linea_id = v.linea_id WHERE v.capex_estimado >= 700000",
)


@query(
    "initiative_dependencies",
    "SELECT *, 'alta' AS dependency_strength, 12.0::DOUBLE AS dependency_penalty_pct FROM dependency",
)
def initiative_dependencies(spark, sf):
    return Layers(spark, sf).dependencies()


define(
    "conflict_pair",
    "SELECT a.iniciativa_id AS iniciativa_id_1, b.iniciativa_id AS iniciativa_id_2, a.linea_id,"
    " 'solape_recursos' AS conflict_type,"
    " CASE WHEN a.quick_win_flag = 1 AND b.quick_win_flag = 1 THEN 8.0::DOUBLE ELSE 12.0::DOUBLE END"
    " AS conflict_penalty_pct FROM value_pool a JOIN value_pool b USING (planta_id, linea_id, categoria_iniciativa)"
    " WHERE (b.capex_estimado, b.iniciativa_id) > (a.capex_estimado, a.iniciativa_id)"
    " AND (b.capex_estimado - a.capex_estimado <= 100000 OR (a.quick_win_flag = 1 AND b.quick_win_flag = 1))",
)


@query("initiative_conflicts", "SELECT * FROM conflict_pair")
def initiative_conflicts(spark, sf):
    return scenario.conflicts(Layers(spark, sf).value_pool())


@query(
    "conflicts_per_initiative",
    "SELECT iniciativa_id, count(*) AS conflicts FROM (SELECT iniciativa_id_1 AS iniciativa_id FROM conflict_pair UNION ALL"
    " SELECT iniciativa_id_2 FROM conflict_pair) GROUP BY 1",
)
def conflicts_per_initiative(spark, sf):
    """Conflicts of every initiative, from counts."""
    return scenario.conflict_numbers(Layers(spark, sf).value_pool())


define(
    "conflict_sum",
    "SELECT iniciativa_id, sum(conflict_penalty_pct) AS pct FROM ("
    " SELECT iniciativa_id_1 AS iniciativa_id, conflict_penalty_pct FROM conflict_pair"
    " UNION ALL SELECT iniciativa_id_2, conflict_penalty_pct FROM conflict_pair) GROUP BY ALL",
)


@query(
    "conflict_penalties",
    "SELECT v.iniciativa_id, coalesce(c.pct, 0)::DOUBLE AS conflict_penalty_pct FROM value_pool v"
    " LEFT JOIN conflict_sum c USING (iniciativa_id)",
)
def conflict_penalties(spark, sf):
    return scenario.conflict_penalties(Layers(spark, sf).value_pool())


# --- scenario table -------------------------------------------------------------------------
def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in r) + ")" for r in rows)


define(
    "lever",
    "SELECT * FROM (VALUES "
    + _values(
        [
            (k, v.label, v.reduction_consumption, v.sec_improvement, v.oee_improvement, v.stops_reduction,
             v.emission_reduction, v.execution_ease, v.ramp_months, v.start_delay_months)
            for k, v in scenario.LEVERS.items()
        ]
    )
    + ") t(scenario_key, escenario_label, l_cons, l_sec, l_oee, l_stop, l_em, l_ease, l_ramp, l_delay)",
)
define(
    "macro",
    "SELECT * FROM (VALUES "
    + _values(
        [
            (k, v.energy_price_mult, v.carbon_cost_mult, v.margin_operativo_mult, v.delay_mult, v.capex_overrun_pct,
             v.capture_shortfall_pct)
            for k, v in scenario.MACROS.items()
        ]
    )
    + ") t(escenario, m_price, m_carbon, m_margin, m_delay, m_over, m_short)",
)
define(
    "initiative_lever",
    "SELECT v.*, CASE WHEN quick_win_flag = 1 THEN 'quick_wins_operativos'"
    " WHEN contains(tipo_iniciativa, 'Mantenimiento') THEN 'mantenimiento_restauracion'"
    " WHEN contains(tipo_iniciativa, 'Optim') OR contains(categoria_iniciativa, 'Proceso') THEN 'optimizacion_parametros'"
    " WHEN contains(tipo_iniciativa, 'Scrap') THEN 'reduccion_scrap_reproceso'"
    " WHEN contains(tipo_iniciativa, 'Electr') THEN 'electrificacion_sustitucion'"
    " WHEN contains(tipo_iniciativa, 'Recuperacion') OR contains(categoria_iniciativa, 'Energet')"
    " THEN CASE WHEN capex_estimado <= 700000 THEN 'recuperacion_energetica' ELSE 'electrificacion_sustitucion' END"
    " WHEN capex_estimado >= 900000 THEN 'capex_mayor' ELSE 'reduccion_scrap_reproceso' END AS scenario_key"
    " FROM value_pool v",
)


@query(
    "initiative_levers",
    "SELECT iniciativa_id, scenario_key, escenario_label, l_ease::INT AS execution_ease FROM initiative_lever"
    " JOIN lever USING (scenario_key)",
)
def initiative_levers(spark, sf):
    levers = scenario.LEVERS
    return (
        Layers(spark, sf).value_pool()
        .withColumn("scenario_key", scenario.scenario_key())
        .select(
            "iniciativa_id",
            "scenario_key",
            lookup("scenario_key", {k: v.label for k, v in levers.items()}).alias("escenario_label"),
            lookup("scenario_key", {k: v.execution_ease for k, v in levers.items()}).alias("execution_ease"),
        )
    )


def _clip(x: str, lo: float, hi: float | str) -> str:
    hi = hi if isinstance(hi, str) else f"{hi}::DOUBLE"
    return f"greatest({lo}::DOUBLE, least({hi}, {x}))"


define(
    "cube_1",
    "SELECT i.*, i.capex_estimado AS capex_base, l.* EXCLUDE (scenario_key), b.* EXCLUDE (planta_id, linea_id),"
    " s.escenario AS macro_scenario, s.precio_energia_shock, s.presion_demanda_indice,"
    " s.disponibilidad_personal_indice, s.restriccion_operativa_indice, m.* EXCLUDE (escenario),"
    " CASE WHEN d.iniciativa_id IS NULL THEN 0::DOUBLE ELSE 12::DOUBLE END AS dependency_penalty_pct,"
    " coalesce(c.pct, 0)::DOUBLE AS conflict_penalty_pct,"
    " (1 + 0.08 * (b.criticidad_linea - 3)) * (0.5 * s.precio_energia_shock + 0.3 * s.presion_demanda_indice"
    " + 0.2 * s.restriccion_operativa_indice) AS strength,"
    " CASE i.riesgo_implantacion WHEN 'Bajo' THEN 0.92::DOUBLE WHEN 'Medio' THEN 0.78::DOUBLE"
    " WHEN 'Alto' THEN 0.6::DOUBLE ELSE 0.72::DOUBLE END AS risk"
    " FROM initiative_lever i JOIN lever l USING (scenario_key) JOIN line_baseline b USING (planta_id, linea_id)"
    " CROSS JOIN macro_shock s JOIN macro m ON m.escenario = s.escenario"
    " LEFT JOIN dependency d ON d.iniciativa_id = i.iniciativa_id"
    " LEFT JOIN conflict_sum c ON c.iniciativa_id = i.iniciativa_id",
)
define(
    "cube_2",
    "SELECT *, " + _clip("l_cons * strength", 0, 0.5) + " AS k_cons, " + _clip("l_sec * strength", 0, 0.4) + " AS k_sec, "
    + _clip("l_oee * (1 + impacto_esperado_oee_pct / 100)", 0, 0.35) + " AS k_oee, "
    + _clip("l_stop * strength", 0, 0.55) + " AS k_stop, " + _clip("l_em * strength", 0, 0.55) + " AS k_em,"
    " precio_energia_shock * m_price AS assumption_energy_price_mult, 90 * m_carbon AS assumption_carbon_cost_eur_ton,"
    " m_margin AS assumption_margin_operativo_mult,"
    " greatest(0::DOUBLE, opex_impacto_proxy * (0.9 + 0.1 * presion_demanda_indice)) AS implementation_opex,"
    " capex_base * (1 + m_over) AS capex,"
    " greatest(1, round_even(l_ramp * m_delay * (1 + greatest(0::DOUBLE, restriccion_operativa_indice - 1)), 0)) AS ramp,"
    " greatest(0, round_even(l_delay * m_delay * (1 + greatest(0::DOUBLE, 1 - disponibilidad_personal_indice)), 0)) AS delay, "
    + _clip(
        _clip("0.22 + 0.46 * l_ease / 100 + 0.2 * risk + 0.12 * disponibilidad_personal_indice", 0.2, 0.95)
        + " * (1 - m_short)", 0.15, 0.93,
    )
    + " AS success_probability FROM cube_1",
)
define(
    "cube_3",
    "SELECT *, greatest(0::DOUBLE, cost_energy_base * assumption_energy_price_mult) AS baseline_energy_exposure,"
    " greatest(0::DOUBLE, (loss_base_eur - cost_energy_base) * m_margin) AS baseline_non_energy_exposure,"
    " greatest(0::DOUBLE, emissions_base_kg / 1000 * assumption_carbon_cost_eur_ton) AS baseline_emission_cost, "
    + _clip(
        "success_probability * (1 - least(0.2::DOUBLE, dependency_penalty_pct / 100))"
        " * (1 - least(0.25::DOUBLE, conflict_penalty_pct / 100))", 0.1, 0.92,
    )
    + " AS expected_capture_rate FROM cube_2",
)
define(
    "cube_4",
    "SELECT *, baseline_energy_exposure * k_cons AS gross_technical_value_energy, baseline_non_energy_exposure * "
    + _clip("0.48 * k_stop + 0.32 * k_oee + 0.2 * k_sec", 0, 0.72) + " AS avoided_loss,"
    " baseline_emission_cost * k_em AS gross_technical_value_emissions,"
    " greatest(0.05::DOUBLE, least(expected_capture_rate, expected_capture_rate * 0.72)) AS downside_capture_rate"
    " FROM cube_3",
)
define(
    "cube_5",
    "SELECT *, gross_technical_value_energy + avoided_loss + gross_technical_value_emissions AS gross FROM cube_4",
)
define(
    "cube_6",
    "SELECT *, greatest(0::DOUBLE, gross - implementation_opex) AS net_op,"
    " greatest(0::DOUBLE, gross * expected_capture_rate - implementation_opex) AS net_cap,"
    " greatest(0::DOUBLE, gross * downside_capture_rate - implementation_opex) AS net_down FROM cube_5",
)
# Month by month, as an independent check of the closed form.
define(
    "cube_months",
    "SELECT c.iniciativa_id, c.macro_scenario, m.m, c.net_cap / 12 AS monthly,"
    " CASE WHEN m.m < c.delay THEN 0 ELSE least(1::DOUBLE, (m.m - c.delay + 1) / c.ramp) END AS captured,"
    " CASE WHEN m.m < c.delay + 12 THEN 0 ELSE least(1::DOUBLE, (m.m - c.delay - 11) / c.ramp) END AS captured_late,"
    " pow(1.1::DOUBLE, -(m.m + 1) / 12) AS v, c.capex FROM cube_6 c CROSS JOIN (SELECT range AS m FROM range(72)) m",
)
define(
    "cube_sums",
    "SELECT iniciativa_id, macro_scenario, sum(captured * v) AS worth, sum(captured_late * v) AS worth_late,"
    " coalesce(min(m + 1) FILTER (WHERE paid >= 0), 999)::DOUBLE AS payback_meses,"
    + ", ".join(f" sum(monthly * captured) FILTER (WHERE m >= {12 * y} AND m < {12 * y + 12}) AS f{y + 1}" for y in range(6))
    + " FROM (SELECT *, -capex + sum(monthly * captured * v) OVER (PARTITION BY iniciativa_id, macro_scenario ORDER BY m)"
    " AS paid FROM cube_months) GROUP BY ALL",
)


def _pv(rate: str) -> str:
    return "(-capex" + "".join(f" + f{y} / pow(1 + {rate}, {y})" for y in range(1, 7)) + ")"


define(
    "cube_flows",
    "SELECT c.iniciativa_id, c.macro_scenario, c.capex, f1, f2, f3, f4, f5, f6 FROM cube_6 c"
    " JOIN cube_sums s USING (iniciativa_id, macro_scenario)",
)
define(
    "bisection",
    f"SELECT *, -0.9::DOUBLE AS lo, 3.0::DOUBLE AS hi, {_pv('-0.9::DOUBLE')} AS lo_v, 0 AS step FROM cube_flows"
    f" WHERE capex > 0 AND f1 + f2 + f3 + f4 + f5 + f6 > 0 AND {_pv('-0.9::DOUBLE')} * {_pv('3.0::DOUBLE')} <= 0"
    " UNION ALL SELECT iniciativa_id, macro_scenario, capex, f1, f2, f3, f4, f5, f6,"
    " CASE WHEN lo_v * mid_v <= 0 THEN lo ELSE mid END, CASE WHEN lo_v * mid_v <= 0 THEN mid ELSE hi END,"
    " CASE WHEN lo_v * mid_v <= 0 THEN lo_v ELSE mid_v END, step + 1 FROM ("
    f" SELECT *, (lo + hi) / 2 AS mid, {_pv('((lo + hi) / 2)')} AS mid_v FROM bisection WHERE step < 64)",
)
define(
    "cube_7",
    "SELECT c.*, s.*  EXCLUDE (iniciativa_id, macro_scenario), 100 * (i.lo + i.hi) / 2 AS irr,"
    " -c.capex + net_op / 12 * worth AS npv_base, -c.capex + net_cap / 12 * worth AS discounted_value,"
    " -c.capex + net_down / 12 * worth AS downside_adjusted_value, -c.capex + net_cap / 12 * worth_late AS npv_late"
    " FROM cube_6 c JOIN cube_sums s USING (iniciativa_id, macro_scenario)"
    " LEFT JOIN bisection i ON i.step = 64 AND i.iniciativa_id = c.iniciativa_id AND i.macro_scenario = c.macro_scenario",
)
define(
    "cube_8",
    "SELECT *, greatest(0::DOUBLE, discounted_value - downside_adjusted_value) AS screening_var_95_npv,"
    " (irr IS NOT NULL AND capex >= 250000)::INT::DOUBLE AS formal_irr_candidate_flag,"
    " CASE WHEN capex > 0 THEN least(250::DOUBLE, 100 * net_cap / capex) ELSE 0 END AS screening_irr_pct,"
    " CASE WHEN capex > 0 THEN downside_adjusted_value / capex ELSE 0 END AS capital_efficiency,"
    " greatest(0::DOUBLE, net_cap - net_down) AS value_at_risk_95 FROM cube_7",
)
define(
    "scenario_cube",
    "SELECT iniciativa_id, planta_id, linea_id, macro_scenario, scenario_key, escenario_label,"
    " 100 * k_cons AS reduccion_consumo_pct, 100 * k_sec AS mejora_sec_pct, 100 * k_oee AS mejora_oee_pct,"
    " 100 * k_stop AS reduccion_paradas_pct, 100 * k_em AS reduccion_emisiones_pct, baseline_energy_exposure,"
    " baseline_non_energy_exposure, baseline_emission_cost,"
    " baseline_energy_exposure + baseline_non_energy_exposure + baseline_emission_cost AS baseline_economic_exposure,"
    " gross_technical_value_energy, avoided_loss, gross_technical_value_emissions, gross AS gross_technical_value,"
    " implementation_opex, net_op AS net_operational_value, net_cap AS net_captured_value,"
    " net_down AS downside_adjusted_annual, discounted_value, downside_adjusted_value,"
    " greatest(0::DOUBLE, discounted_value - npv_late) AS cost_of_delay_12m, capital_efficiency, screening_irr_pct,"
    " coalesce(irr, 0) AS formal_irr_candidate_pct, formal_irr_candidate_flag, screening_var_95_npv,"
    " 1.25 * screening_var_95_npv AS robust_risk_metric_candidate_npv, capex AS capex_estimado, capex_base,"
    " m_over AS capex_overrun_pct, success_probability, expected_capture_rate, downside_capture_rate,"
    " m_short AS capture_shortfall_pct, delay AS start_delay_months, ramp AS ramp_up_months,"
    " greatest(0::DOUBLE, net_cap - f1) AS ramp_up_penalty_value, dependency_penalty_pct, conflict_penalty_pct,"
    " npv_base, discounted_value AS npv_risk_adjusted, screening_irr_pct AS irr_proxy_pct, payback_meses,"
    " net_down AS downside_annual_savings_p20, value_at_risk_95, "
    + _clip(
        "100 * (0.35 * ln(1 + capex) / ln(2200001::DOUBLE) + 0.25::DOUBLE * dificultad_implementacion / 5"
        " + 0.2 * ramp / 18 + 0.2 * (1 - l_ease / 100))", 0, 100,
    )
    + " AS implementation_burden, "
    + _clip(
        "100 * (0.4::DOUBLE * criticidad_estrategica / 5 + 0.35 * impacto_esperado_emisiones_pct / 20"
        " + 0.25 * criticidad_linea / 5)", 0, 100,
    )
    + " AS strategic_relevance_score, l_ease::INT AS facilidad_ejecucion,"
    " CASE WHEN capex >= 900000 AND formal_irr_candidate_flag = 1 AND discounted_value > 0"
    " AND screening_var_95_npv <= greatest(discounted_value, 1) * 0.65 THEN 'business_case_candidate'"
    " WHEN capex >= 250000 THEN 'pre_feasibility' ELSE 'screening' END AS financial_maturity_stage,"
    " assumption_energy_price_mult, assumption_carbon_cost_eur_ton, assumption_margin_operativo_mult,"
    " gross AS gross_annual_savings, net_op AS net_annual_savings, net_cap AS risk_adjusted_annual_savings FROM cube_8",
)
_TEXT = {
    "iniciativa_id", "planta_id", "linea_id", "macro_scenario", "scenario_key", "escenario_label",
    "financial_maturity_stage", "financial_use_label", "committee_wording_status", "facilidad_ejecucion",
}
SCENARIO = " ".join(c if c in _TEXT else c + "~" for c in scenario.SCENARIO_COLUMNS)


@query(
    "scenario_table",
    final(
        "(SELECT *, CASE financial_maturity_stage WHEN 'business_case_candidate' THEN 'business_case_candidate_not_final'"
        " WHEN 'pre_feasibility' THEN 'pre_feasibility' ELSE 'screening_financiero' END AS financial_use_label,"
        " CASE financial_maturity_stage WHEN 'business_case_candidate' THEN 'candidate_with_caveat'"
        " ELSE 'not_committee_grade_proxy' END AS committee_wording_status FROM scenario_cube)",
        SCENARIO,
        2,
    ),
    digits=2,
)
def scenario_table(spark, sf):
    return Layers(spark, sf).scenario_table()


# --- scenario summaries ---------------------------------------------------------------------
define("base_cube", "SELECT * FROM scenario_cube WHERE lower(macro_scenario) = 'base'")


@query(
    "baseline_vs_improved",
    final(
        "(SELECT b.*, s.* EXCLUDE (planta_id, linea_id, r), sec_base * (1 - coalesce(mejora_sec_pct, 0) / 100) AS sec_mejorado,"
        " oee_base * (1 + coalesce(mejora_oee_pct, 0) / 100) AS oee_mejorado,"
        " cost_energy_base * (1 - coalesce(reduccion_consumo_pct, 0) / 100) AS coste_energia_mejorado,"
        " emissions_base_kg * (1 - coalesce(reduccion_emisiones_pct, 0) / 100) AS emisiones_mejoradas_kg"
        " FROM line_baseline b LEFT JOIN (SELECT planta_id, linea_id, " + ", ".join(scenario.BEST_FIELDS)
        + ", row_number() OVER (PARTITION BY planta_id, linea_id ORDER BY net_captured_value DESC, iniciativa_id) AS r"
        " FROM base_cube) s ON s.r = 1 AND s.planta_id = b.planta_id AND s.linea_id = b.linea_id)",
        "planta_id linea_id sec_base~ oee_base~ cost_energy_base~ emissions_base_kg~ loss_base_eur~ stops_base"
        " criticidad_linea~ " + " ".join(f + "~" for f in scenario.BEST_FIELDS)
        + " sec_mejorado~ oee_mejorado~ coste_energia_mejorado~ emisiones_mejoradas_kg~",
        3,
    ),
    digits=3,
)
def baseline_vs_improved(spark, sf):
    layers = Layers(spark, sf)
    return scenario.baseline_vs_improved(layers.stored("scenario_table"), layers.line_baseline())


define(
    "comparison_base",
    "SELECT iniciativa_id, planta_id, linea_id, scenario_key, escenario_label, capex_estimado, "
    + ", ".join(f"avg({c}) AS {n}" for n, c in scenario.COMPARISON_MEANS.items())
    + " FROM scenario_cube GROUP BY ALL",
)


def _top(c: str) -> str:
    return f"coalesce(nullif(max({c}) OVER (), 0), 1)"


define(
    "comparison",
    "SELECT *, 100 * (0.33 * downside_adjusted_value_mean / " + _top("downside_adjusted_value_mean")
    + " + 0.15 * (1 - discounted_payback_meses_mean / " + _top("discounted_payback_meses_mean") + ")"
    " + 0.15 * strategic_relevance_score / 100 + 0.12 * success_probability"
    " + 0.1 * reduccion_emisiones_pct / " + _top("reduccion_emisiones_pct")
    + " + 0.1 * capital_efficiency_mean / greatest(max(capital_efficiency_mean) OVER (), 1e-6)"
    " + 0.05 * (1 - implementation_burden / " + _top("implementation_burden") + ")"
    " - 0.12 * screening_var_95_npv_mean / " + _top("screening_var_95_npv_mean") + ") AS score_tradeoff FROM comparison_base",
)


@query(
    "scenario_ranking",
    final(
        "(SELECT *, row_number() OVER (ORDER BY round(score_tradeoff, 9) DESC NULLS LAST, iniciativa_id, capex_estimado) AS ranking"
        " FROM comparison)",
        "iniciativa_id planta_id linea_id scenario_key escenario_label capex_estimado~ "
        + " ".join(f"{n}~" for n in scenario.COMPARISON_MEANS) + " score_tradeoff~ ranking",
        3,
    ),
    digits=3,
)
def scenario_ranking(spark, sf):
    comparison = Layers(spark, sf).scenario_comparison()
    return scenario.scenario_ranking(comparison.withColumn("score_tradeoff", F.round("score_tradeoff", 9)))


@query(
    "value_waterfall",
    final(
        "(SELECT *, sum(ahorro_ajustado_riesgo) OVER (ORDER BY ahorro_ajustado_riesgo DESC, escenario_label"
        " ROWS UNBOUNDED PRECEDING) AS acumulado FROM (SELECT escenario_label, sum(gross_technical_value) AS ahorro_bruto,"
        " sum(net_captured_value) AS ahorro_neto, sum(downside_adjusted_annual) AS ahorro_ajustado_riesgo,"
        " sum(value_at_risk_95) AS var_95, sum(discounted_value) AS valor_descontado,"
        " sum(downside_adjusted_value) AS valor_downside, sum(cost_of_delay_12m) AS coste_retraso_12m"
        " FROM base_cube GROUP BY ALL))",
        "escenario_label ahorro_bruto~ ahorro_neto~ ahorro_ajustado_riesgo~ var_95~ valor_descontado~"
        " valor_downside~ coste_retraso_12m~ acumulado~",
        1,
    ),
    digits=1,
)
def value_waterfall(spark, sf):
    return scenario.value_waterfall(Layers(spark, sf).stored("scenario_table"))


# --- finance functions on orders ------------------------------------------------------------
define(
    "order_project",
    "SELECT o_orderkey, o_totalprice AS capex, o_totalprice * 0.4 AS annual, 3 + o_custkey % 5 AS ramp,"
    " o_orderkey % 4 AS delay FROM orders",
)


@query(
    "order_net_present_values",
    final(
        "(SELECT o_orderkey, -capex + sum(annual / 12 * captured * v) AS npv,"
        " sum(annual / 12 * captured) FILTER (WHERE m < 12) AS first_year,"
        " coalesce(min(m + 1) FILTER (WHERE paid >= 0), 999)::DOUBLE AS payback FROM (SELECT *,"
        " -capex + sum(annual / 12 * captured * v) OVER (PARTITION BY o_orderkey ORDER BY m) AS paid FROM ("
        " SELECT p.*, m, CASE WHEN m < delay THEN 0 ELSE least(1::DOUBLE, (m - delay + 1) / ramp) END AS captured,"
        " pow(1.1::DOUBLE, -(m + 1) / 12) AS v FROM order_project p CROSS JOIN (SELECT range AS m FROM range(72))))"
        " GROUP BY o_orderkey, capex)",
        "o_orderkey npv~ first_year~ payback~",
        3,
    ),
    digits=3,
)
def order_net_present_values(spark, sf):
    projects = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("capex"),
        (F.col("o_totalprice") * 0.4).alias("annual"),
        (3 + F.col("o_custkey") % 5).alias("ramp"),
        (F.col("o_orderkey") % 4).alias("delay"),
    )
    return projects.select(
        "o_orderkey",
        finance.net_present_value("capex", "annual", "delay", "ramp").alias("npv"),
        (F.col("annual") / 12.0 * finance.captured_months(F.lit(12), "delay", "ramp")).alias("first_year"),
        finance.repayment("capex", "annual", "delay", "ramp")["payback"].alias("payback"),
    )


@query(
    "part_payback_horizons",
    final(
        "(SELECT iniciativa_id, payback_estimado_meses AS payback, horizonte_implantacion FROM capex_proyectos)",
        "iniciativa_id payback~ horizonte_implantacion",
    ),
)
def part_payback_horizons(spark, sf):
    projects = Layers(spark, sf).role("capex_proyectos")
    months = finance.simple_payback_months("capex_estimado", "ahorro_anual_estimado", "opex_impacto_proxy")
    return projects.select(
        "iniciativa_id", months.alias("payback"), finance.payback_horizon(months).alias("horizonte_implantacion")
    )


# --- priorities -----------------------------------------------------------------------------
define(
    "macro_mean",
    "SELECT iniciativa_id, macro_scenario, " + ", ".join(f"avg({c}) AS {c}" for c in portfolio.MACRO_MEANS)
    + " FROM scenario_cube GROUP BY ALL",
)


@query(
    "macro_means",
    final("macro_mean", "iniciativa_id macro_scenario " + " ".join(f"{c}~" for c in portfolio.MACRO_MEANS), 3),
    digits=3,
)
def macro_means(spark, sf):
    return portfolio.macro_means(Layers(spark, sf).stored("scenario_table"))


define(
    "stage_mode",
    "SELECT iniciativa_id, financial_maturity_stage FROM (SELECT iniciativa_id, financial_maturity_stage,"
    " row_number() OVER (PARTITION BY iniciativa_id ORDER BY count(*) DESC, financial_maturity_stage) AS r"
    " FROM scenario_cube GROUP BY iniciativa_id, financial_maturity_stage) WHERE r = 1",
)
define(
    "robust",
    "SELECT iniciativa_id, " + ", ".join(f"avg({c}) AS {n}" for n, c in portfolio.ROBUST_MEANS.items())
    + ", min(discounted_value) AS discounted_value_min, min(downside_adjusted_value) AS downside_adjusted_value_min,"
    " max(formal_irr_candidate_flag) AS formal_irr_candidate_flag FROM scenario_cube GROUP BY ALL",
)


@query(
    "robust_rollup",
    final(
        "(SELECT *, CASE financial_maturity_stage WHEN 'business_case_candidate' THEN 'candidate_with_caveat'"
        " ELSE 'not_committee_grade_proxy' END AS committee_wording_status FROM robust JOIN stage_mode USING (iniciativa_id))",
        "iniciativa_id " + " ".join(f"{n}~" for n in portfolio.ROBUST_MEANS)
        + " discounted_value_min~ downside_adjusted_value_min~ formal_irr_candidate_flag~ financial_maturity_stage",
        3,
    ),
    digits=3,
)
def robust_rollup(spark, sf):
    return portfolio.robust_rollup(Layers(spark, sf).stored("scenario_table")).drop("committee_wording_status")


_COMPONENT_SQL = {
    "energy_saving_score": ("coalesce(net_captured_value_base, annual_saving_declared)", 150000, 1100000, False),
    "operational_impact_score": ("expected_oee_gain * 0.6 + operational_urgency_score * 0.4", 20, 85, False),
    "emissions_reduction_score": ("expected_emissions_reduction * 0.6 + reduccion_emisiones_pct * 0.4", 5, 130, False),
    "implementation_feasibility_score": (
        "implementation_complexity_score * 0.45 + execution_risk_score * 0.25 + implementation_burden * 0.3", 20, 92, True,
    ),
    "payback_score": ("payback_months", 6, 36, True),
    "strategic_priority_score": (
        "strategic_alignment_score * 0.65 + strategic_relevance_score * 0.35", 30, 95, False,
    ),
    "financial_resilience_score": (
        "downside_adjusted_value - 0.35 * screening_var_95_npv + 0.2 * capital_efficiency", -350000, 1600000, False,
    ),
    "uncertainty_index": ("screening_var_95_npv", 300000, 1300000, True),
}
define(
    "priority_base",
    "SELECT o.* EXCLUDE (annual_saving_proxy, payback_months), o.annual_saving_proxy AS annual_saving_declared,"
    " r.* EXCLUDE (iniciativa_id, npv_risk_adjusted, cost_of_delay_12m, payback_meses, screening_var_95_npv),"
    " r.screening_var_95_npv, g.financial_maturity_stage, b.net_captured_value AS annual_saving_proxy,"
    " b.payback_meses AS payback_months, b.discounted_value AS npv_risk_adjusted, b.downside_adjusted_value,"
    " b.cost_of_delay_12m, b.downside_adjusted_annual,"
    " CASE WHEN categoria_iniciativa ILIKE '%compliance%' OR categoria_iniciativa ILIKE '%regulator%' THEN 'compliance-driven'"
    " WHEN tipo_iniciativa ILIKE '%mantenimiento%' OR categoria_iniciativa ILIKE '%confiabilidad%' THEN 'reliability-protection'"
    " WHEN strategic_alignment_score >= 85 AND operational_urgency_score >= 75 THEN 'mandatory'"
    " ELSE 'discretionary' END AS initiative_class"
    " FROM opportunity_scored o JOIN robust r USING (iniciativa_id) JOIN stage_mode g USING (iniciativa_id)"
    " JOIN macro_mean b ON b.iniciativa_id = o.iniciativa_id AND lower(b.macro_scenario) = 'base'",
)
define(
    "priority_scored",
    "SELECT *, " + ", ".join(f"100 * ({anc(x, lo, hi, inv)}) AS {n}" for n, (x, lo, hi, inv) in _COMPONENT_SQL.items())
    + ", downside_adjusted_value + 0.3 * cost_of_delay_12m + 0.1 * greatest(npv_risk_adjusted, 0)"
    " - 0.15 * screening_var_95_npv AS objective_value_eur FROM priority_base",
)
define(
    "priority",
    "SELECT *, " + " + ".join(f"{w}::DOUBLE * {n}" for n, w in portfolio.PRIORITY_WEIGHTS.items())
    + " AS improvement_priority_index, 55 * (" + anc("downside_adjusted_value", 0, 1900000) + ") + 20 * ("
    + anc("capital_efficiency", 0, 110) + ") + 0.15 * financial_resilience_score + 0.1 * strategic_priority_score"
    " AS portfolio_objective_score FROM priority_scored",
)
_PRIORITY_OUT = (
    "iniciativa_id initiative_class financial_maturity_stage annual_saving_proxy~ payback_months~ npv_risk_adjusted~"
    " downside_adjusted_value~ cost_of_delay_12m~ objective_value_eur~ "
    + " ".join(f"{n}~" for n in _COMPONENT_SQL) + " improvement_priority_index~ portfolio_objective_score~"
)


@query("initiative_priorities", final("priority", _PRIORITY_OUT, 3), digits=3)
def initiative_priorities(spark, sf):
    return Layers(spark, sf).priorities().select(*[c.rstrip("~") for c in _PRIORITY_OUT.split()])


def _sensitivity_sql() -> str:
    parts = [
        f"SELECT iniciativa_id, '{name}' AS scenario, "
        + " + ".join(f"{w}::DOUBLE * {c}" for c, w in zip(portfolio.PRIORITY_WEIGHTS, weights))
        + " AS score FROM priority_scored"
        for name, weights in portfolio.WEIGHT_SCENARIOS.items()
    ]
    return final(
        "(SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY round(score, 6) DESC, iniciativa_id) AS ranking FROM ("
        + " UNION ALL ".join(parts) + "))",
        "iniciativa_id scenario score~ ranking",
    )


define("sensitivity_row", _sensitivity_sql())


@query("weight_sensitivity", "SELECT * FROM sensitivity_row")
def weight_sensitivity(spark, sf):
    return portfolio.weight_sensitivity(Layers(spark, sf).stored("priorities"))


def _legacy(expr_by_name: dict[str, tuple[str, bool]]) -> str:
    return " + ".join(
        f"{portfolio.PRIORITY_WEIGHTS[n]}::DOUBLE * ({'100 - ' if inv else ''}({minmax(x)}))"
        for n, (x, inv) in expr_by_name.items()
    )


_RAW = {n: (x, inv) for n, (x, _, _, inv) in _COMPONENT_SQL.items()}


def _priority_stability_sql() -> str:
    rows = []
    for name, (x, lo, hi, inv) in _COMPONENT_SQL.items():
        base = (
            f"(SELECT iniciativa_id AS id, {name} AS s, {'100 - ' if inv else ''}({minmax(x)}) AS g, {x} AS x,"
            f" row_number() OVER (ORDER BY {x} DESC NULLS LAST, iniciativa_id) = 1 AS top FROM priority)"
        )
        moved = "CASE WHEN top THEN x * 3 ELSE x END"
        shifts = (
            "SELECT median(abs(m2 - m1)) AS lm, median(abs(a2 - a1)) AS am FROM (SELECT top,"
            f" 100 * ({anc('x', lo, hi)}) AS a1, 100 * ({anc(moved, lo, hi)}) AS a2,"
            f" {minmax('x')} AS m1, {minmax(moved)} AS m2 FROM {base}) WHERE NOT top"
        )
        known = f"(SELECT * FROM {base} WHERE s IS NOT NULL AND g IS NOT NULL)"
        ranks = avg_rank_sql("round(g, 7)", "(" + avg_rank_sql("round(s, 7)", known, "ra") + ")", "rb")
        overlap = (
            f"SELECT count(*) FROM (SELECT id FROM {base} ORDER BY s DESC NULLS LAST, id LIMIT 10) a"
            f" JOIN (SELECT id FROM {base} ORDER BY g DESC NULLS LAST, id LIMIT 10) b USING (id)"
        )
        rows.append(
            f"SELECT '{name}' AS score_name, lm AS legacy_outlier_median_abs_shift,"
            " am AS anchored_outlier_median_abs_shift,"
            f" (SELECT CASE WHEN isnan(corr(ra, rb)) THEN 0 ELSE coalesce(corr(ra, rb), 0) END FROM ({ranks})) AS spearman_anchored_vs_legacy,"
            f" ({overlap}) AS top10_overlap_anchored_vs_legacy,"
            f" 'absolute_comparable_inter_release' AS comparability_tag FROM ({shifts})"
        )
    return final(
        "(" + " UNION ALL ".join(rows) + ")",
        "score_name legacy_outlier_median_abs_shift~ anchored_outlier_median_abs_shift~"
        " spearman_anchored_vs_legacy~ top10_overlap_anchored_vs_legacy comparability_tag",
        3,
    )


define("stability_row", _priority_stability_sql())


@query("priority_stability", "SELECT * FROM stability_row", digits=3)
def priority_stability(spark, sf):
    return portfolio.priority_stability(Layers(spark, sf).stored("priorities"))


_PEAK = "coalesce(net_captured_value_base, annual_saving_declared)"
define(
    "shocked",
    f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {_PEAK} DESC NULLS LAST, iniciativa_id) = 1 THEN 3 ELSE 1 END"
    f" * {_PEAK} AS moved FROM priority",
)
define(
    "shocked_index",
    "SELECT iniciativa_id, improvement_priority_index AS a, improvement_priority_index - 0.2 * energy_saving_score + 20 * ("
    + anc("moved", 150000, 1100000) + ") AS a2, least(100, greatest(0, " + _legacy(_RAW) + ")) AS g, least(100, greatest(0, "
    + _legacy({**_RAW, "energy_saving_score": ("moved", False)}) + ")) AS g2 FROM shocked",
)


def _common(x: str, y: str) -> str:
    return (
        f"(SELECT count(*) FROM (SELECT iniciativa_id FROM shocked_index ORDER BY {x} DESC, iniciativa_id LIMIT 10) m"
        f" JOIN (SELECT iniciativa_id FROM shocked_index ORDER BY {y} DESC, iniciativa_id LIMIT 10) n USING (iniciativa_id))"
    )


define(
    "robustness_row",
    f"SELECT 'improvement_priority_index' AS score_name, {_common('g', 'g2')} AS legacy_top10_overlap_after_outlier,"
    f" {_common('a', 'a2')} AS anchored_top10_overlap_after_outlier, (SELECT corr(ra, rb) FROM ("
    + avg_rank_sql("round(a, 7)", "(" + avg_rank_sql("round(g, 7)", "shocked_index", "ra") + ")", "rb")
    + ")) AS legacy_vs_anchored_spearman",
)


@query(
    "ranking_robustness",
    final(
        "robustness_row",
        "score_name legacy_top10_overlap_after_outlier anchored_top10_overlap_after_outlier legacy_vs_anchored_spearman~",
    ),
)
def ranking_robustness(spark, sf):
    return portfolio.ranking_robustness(Layers(spark, sf).stored("priorities"))


# --- selection ------------------------------------------------------------------------------
define(
    "budget",
    "SELECT * FROM (VALUES ('base', 8000000::DOUBLE, 1800000::DOUBLE, 24), ('capex_plus_10pct', 8000000 * 1.1::DOUBLE,"
    " 1800000::DOUBLE, 24), ('opex_plus_10pct', 8000000::DOUBLE, 1800000 * 1.1::DOUBLE, 24),"
    " ('capacity_plus_4', 8000000::DOUBLE, 1800000::DOUBLE, 28), ('all_plus', 8000000 * 1.1::DOUBLE,"
    " 1800000 * 1.1::DOUBLE, 28)) t(budget_scenario, capex_budget, opex_budget, max_n)",
)
define(
    "forced_all",
    "SELECT * FROM priority WHERE initiative_class IN ('mandatory', 'compliance-driven')",
)
define(
    "forced_out",
    "SELECT DISTINCT a.iniciativa_id FROM forced_all a JOIN forced_all b"
    " USING (planta_id, linea_id, categoria_iniciativa) WHERE (b.objective_value_eur, b.iniciativa_id)"
    " > (a.objective_value_eur, a.iniciativa_id) AND (abs(a.capex_estimado - b.capex_estimado) <= 100000"
    " OR (a.quick_win_flag = 1 AND b.quick_win_flag = 1))",
)
define(
    "forced_in",
    "SELECT iniciativa_id FROM forced_all WHERE iniciativa_id NOT IN (SELECT iniciativa_id FROM forced_out)"
    " UNION SELECT d.depends_on_iniciativa_id FROM forced_in f JOIN dependency d USING (iniciativa_id)"
    " JOIN priority p ON p.iniciativa_id = d.depends_on_iniciativa_id"
    " WHERE d.depends_on_iniciativa_id NOT IN (SELECT iniciativa_id FROM forced_out)"
    " AND NOT EXISTS (SELECT 1 FROM forced_all o WHERE o.iniciativa_id NOT IN (SELECT iniciativa_id FROM forced_out)"
    " AND o.iniciativa_id <> p.iniciativa_id AND o.planta_id = p.planta_id AND o.linea_id = p.linea_id"
    " AND o.categoria_iniciativa = p.categoria_iniciativa AND (abs(o.capex_estimado - p.capex_estimado) <= 100000"
    " OR (o.quick_win_flag = 1 AND p.quick_win_flag = 1)))",
)
define(
    "forced_member",
    "SELECT p.planta_id, b.budget_scenario, p.iniciativa_id, p.linea_id, p.categoria_iniciativa, p.quick_win_flag,"
    " p.capex_estimado, p.implementation_opex, p.initiative_class, p.objective_value_eur, b.capex_budget, b.opex_budget,"
    " sum(p.capex_estimado) OVER g AS all_c, sum(p.implementation_opex) OVER g AS all_o,"
    " p.initiative_class IN ('mandatory', 'compliance-driven') AS hard"
    " FROM priority p JOIN forced_in USING (iniciativa_id) CROSS JOIN budget b"
    " WINDOW g AS (PARTITION BY p.planta_id, b.budget_scenario)",
)
define(
    "forced_trim",
    "SELECT planta_id, budget_scenario, iniciativa_id FROM (SELECT *,"
    " sum(capex_estimado) OVER w - capex_estimado AS left_c, sum(implementation_opex) OVER w - implementation_opex AS left_o"
    " FROM forced_member WHERE NOT hard WINDOW w AS (PARTITION BY planta_id, budget_scenario"
    " ORDER BY objective_value_eur, iniciativa_id))"
    " WHERE all_c - left_c > capex_budget OR all_o - left_o > opex_budget",
)
define(
    "standing",
    "SELECT * FROM forced_member m WHERE NOT EXISTS (SELECT 1 FROM forced_trim t WHERE t.planta_id = m.planta_id"
    " AND t.budget_scenario = m.budget_scenario AND t.iniciativa_id = m.iniciativa_id)",
)
define(
    "cyclic",
    "SELECT iniciativa_id FROM dependency d WHERE iniciativa_id = depends_on_iniciativa_id"
    " OR depends_on_iniciativa_id IN (SELECT iniciativa_id FROM dependency WHERE iniciativa_id = depends_on_iniciativa_id)",
)
define(
    "open_item",
    "SELECT p.planta_id, b.budget_scenario, p.iniciativa_id, d.depends_on_iniciativa_id AS needs,"
    " p.planta_id || '|' || p.linea_id || '|' || p.categoria_iniciativa AS grp, p.capex_estimado, p.implementation_opex,"
    " p.quick_win_flag, p.objective_value_eur, b.capex_budget, b.opex_budget, b.max_n,"
    " p.objective_value_eur / (1e-6 + 0.65 * p.capex_estimado / greatest(b.capex_budget, 1)"
    " + 0.35 * p.implementation_opex / greatest(b.opex_budget, 1)) AS density,"
    " CASE WHEN d.depends_on_iniciativa_id IN (SELECT iniciativa_id FROM forced_out) OR EXISTS (SELECT 1 FROM forced_trim t"
    " WHERE t.planta_id = p.planta_id AND t.budget_scenario = b.budget_scenario"
    " AND t.iniciativa_id = d.depends_on_iniciativa_id) THEN 'dependency_unavailable'"
    " WHEN EXISTS (SELECT 1 FROM standing s WHERE s.planta_id = p.planta_id AND s.budget_scenario = b.budget_scenario"
    " AND s.linea_id = p.linea_id AND s.categoria_iniciativa = p.categoria_iniciativa"
    " AND (abs(s.capex_estimado - p.capex_estimado) <= 100000 OR (s.quick_win_flag = 1 AND p.quick_win_flag = 1)))"
    " THEN 'conflict_with_forced'"
    " WHEN d.depends_on_iniciativa_id = p.iniciativa_id OR d.depends_on_iniciativa_id IN (SELECT iniciativa_id FROM dependency"
    " WHERE iniciativa_id = depends_on_iniciativa_id) AND NOT EXISTS (SELECT 1 FROM forced_member f"
    " WHERE f.iniciativa_id = d.depends_on_iniciativa_id AND f.budget_scenario = b.budget_scenario"
    " AND f.planta_id = p.planta_id) THEN 'dependency_cycle' END AS preblocked"
    " FROM priority p CROSS JOIN budget b LEFT JOIN dependency d ON d.iniciativa_id = p.iniciativa_id"
    " WHERE p.iniciativa_id NOT IN (SELECT iniciativa_id FROM forced_out)"
    " AND NOT EXISTS (SELECT 1 FROM forced_member f WHERE f.iniciativa_id = p.iniciativa_id"
    " AND f.budget_scenario = b.budget_scenario)",
)
# An open item with all that builds on it, where that adds value: three steps up, more than these tables have.
define("closure_0", "SELECT *, objective_value_eur AS closure_value FROM open_item WHERE preblocked IS NULL")
for _step in range(3):
    define(
        f"closure_{_step + 1}",
        "SELECT o.* EXCLUDE (closure_value), o.objective_value_eur + coalesce(g.gain, 0) AS closure_value"
        f" FROM closure_{_step} o LEFT JOIN (SELECT planta_id, budget_scenario, needs, sum(closure_value) AS gain"
        f" FROM closure_{_step} WHERE closure_value > 0 GROUP BY ALL) g"
        " ON g.planta_id = o.planta_id AND g.budget_scenario = o.budget_scenario AND g.needs = o.iniciativa_id",
    )
define("worthy", "SELECT * FROM closure_3 WHERE closure_value > 0")
define(
    "walk_item",
    "SELECT c.*, row_number() OVER (PARTITION BY c.planta_id, c.budget_scenario ORDER BY"
    " CASE WHEN e.density < c.density THEN e.density ELSE c.density END DESC,"
    " CASE WHEN e.density < c.density THEN c.needs ELSE c.iniciativa_id END,"
    " CASE WHEN e.density < c.density THEN c.density END DESC NULLS FIRST, c.iniciativa_id) AS rn"
    " FROM worthy c LEFT JOIN worthy e ON e.planta_id = c.planta_id AND e.budget_scenario = c.budget_scenario"
    " AND e.iniciativa_id = c.needs",
)
define(
    "walk",
    "SELECT planta_id, budget_scenario, 0::BIGINT AS rn, n, used, used_2,"
    " []::STRUCT(id VARCHAR, grp VARCHAR, cost DOUBLE, quick INT)[] AS taken FROM ("
    " SELECT p.planta_id, b.budget_scenario, count(s.iniciativa_id) AS n, coalesce(sum(s.capex_estimado), 0) AS used,"
    " coalesce(sum(s.implementation_opex), 0) AS used_2 FROM (SELECT DISTINCT planta_id FROM priority) p CROSS JOIN budget b"
    " LEFT JOIN standing s ON s.planta_id = p.planta_id AND s.budget_scenario = b.budget_scenario GROUP BY ALL)"
    " UNION ALL SELECT planta_id, budget_scenario, rn, n + ok::INT, used + ok::INT * cost, used_2 + ok::INT * cost_2,"
    " CASE WHEN ok THEN list_append(taken, {'id': id, 'grp': grp, 'cost': cost, 'quick': quick}) ELSE taken END FROM ("
    " SELECT w.planta_id, w.budget_scenario, i.rn, w.n, w.used, w.used_2, w.taken, i.iniciativa_id AS id, i.grp,"
    " i.capex_estimado AS cost, i.implementation_opex AS cost_2, i.quick_win_flag::INT AS quick,"
    " w.n < i.max_n AND w.used + i.capex_estimado <= i.capex_budget + 1e-6"
    " AND w.used_2 + i.implementation_opex <= i.opex_budget + 1e-6"
    " AND (i.needs IS NULL OR EXISTS (SELECT 1 FROM standing s WHERE s.planta_id = i.planta_id"
    " AND s.budget_scenario = i.budget_scenario AND s.iniciativa_id = i.needs)"
    " OR len(list_filter(w.taken, lambda t: t.id = i.needs)) > 0)"
    " AND len(list_filter(w.taken, lambda t: t.grp = i.grp AND (abs(t.cost - i.capex_estimado) <= 100000"
    " OR (t.quick = 1 AND i.quick_win_flag = 1)))) = 0 AS ok"
    " FROM walk w JOIN walk_item i ON i.planta_id = w.planta_id AND i.budget_scenario = w.budget_scenario"
    " AND i.rn = w.rn + 1)",
)
define(
    "walk_end",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY planta_id, budget_scenario ORDER BY rn DESC) AS r FROM walk)"
    " WHERE r = 1",
)
define(
    "chosen",
    "SELECT planta_id, budget_scenario, unnest(list_transform(taken, lambda t: t.id)) AS iniciativa_id FROM walk_end"
    " UNION SELECT planta_id, budget_scenario, iniciativa_id FROM standing",
)
define(
    "selection",
    "SELECT p.planta_id, b.budget_scenario, p.iniciativa_id, (c.iniciativa_id IS NOT NULL)::INT AS selected_portfolio_flag,"
    " o.preblocked FROM priority p CROSS JOIN budget b LEFT JOIN chosen c ON c.iniciativa_id = p.iniciativa_id"
    " AND c.budget_scenario = b.budget_scenario LEFT JOIN open_item o ON o.iniciativa_id = p.iniciativa_id"
    " AND o.budget_scenario = b.budget_scenario",
)


@query("portfolio_selection", "SELECT planta_id, budget_scenario, iniciativa_id, selected_portfolio_flag, preblocked FROM selection")
def portfolio_selection(spark, sf):
    return Layers(spark, sf).selection()


# --- best selections per line, against every subset --------------------------------------------
LINE_LIMITS = {"capex": 3_000_000.0, "opex": 300_000.0, "max_n": 4}
define(
    "line_forced",
    "SELECT p.*, sum(capex_estimado) OVER g AS all_c, sum(implementation_opex) OVER g AS all_o,"
    " initiative_class IN ('mandatory', 'compliance-driven') AS hard FROM priority p JOIN forced_in USING (iniciativa_id)"
    " WINDOW g AS (PARTITION BY linea_id)",
)
define(
    "line_trim",
    "SELECT iniciativa_id FROM (SELECT *, sum(capex_estimado) OVER w - capex_estimado AS left_c,"
    " sum(implementation_opex) OVER w - implementation_opex AS left_o FROM line_forced WHERE NOT hard"
    " WINDOW w AS (PARTITION BY linea_id ORDER BY objective_value_eur, iniciativa_id))"
    " WHERE all_c - left_c > 3000000 OR all_o - left_o > 300000",
)
define("line_standing", "SELECT * FROM line_forced WHERE iniciativa_id NOT IN (SELECT iniciativa_id FROM line_trim)")
define(
    "line_room",
    "SELECT l.linea_id, 3000000 - coalesce(s.capex, 0) AS room, 300000 - coalesce(s.opex, 0) AS room_2,"
    " 4 - coalesce(s.n, 0) AS places, l.minimum, l.minimum - coalesce(s.rel, 0) AS missing, coalesce(s.worth, 0) AS worth,"
    " coalesce(s.ids, []) AS forced, coalesce(s.rel, 0) AS forced_rel FROM (SELECT linea_id,"
    " ceil(0.1::DOUBLE * count(*) FILTER (WHERE initiative_class = 'reliability-protection'))::INT AS minimum"
    " FROM priority GROUP BY 1) l LEFT JOIN (SELECT linea_id, sum(capex_estimado) AS capex, sum(implementation_opex) AS opex,"
    " count(*) AS n, count(*) FILTER (WHERE initiative_class = 'reliability-protection') AS rel, sum(objective_value_eur) AS worth,"
    " list(iniciativa_id) AS ids FROM line_standing GROUP BY 1) s USING (linea_id)",
)
_NEAR_STANDING = (
    "EXISTS (SELECT 1 FROM line_standing s WHERE s.linea_id = p.linea_id AND s.categoria_iniciativa = p.categoria_iniciativa"
    " AND (abs(s.capex_estimado - p.capex_estimado) <= 100000 OR (s.quick_win_flag = 1 AND p.quick_win_flag = 1)))"
)
define(
    "line_open",
    "SELECT p.linea_id, p.iniciativa_id AS id, p.categoria_iniciativa AS grp, p.capex_estimado AS cost, p.implementation_opex AS cost_2,"
    " p.objective_value_eur AS value, p.quick_win_flag AS quick, (p.initiative_class = 'reliability-protection')::INT AS kind,"
    " CASE WHEN d.depends_on_iniciativa_id NOT IN (SELECT iniciativa_id FROM line_standing) THEN d.depends_on_iniciativa_id END AS needs"
    " FROM priority p LEFT JOIN dependency d USING (iniciativa_id) WHERE p.iniciativa_id NOT IN (SELECT iniciativa_id FROM forced_out)"
    " AND p.iniciativa_id NOT IN (SELECT iniciativa_id FROM line_forced) AND (d.depends_on_iniciativa_id IS NULL"
    " OR d.depends_on_iniciativa_id NOT IN (SELECT iniciativa_id FROM forced_out UNION ALL SELECT iniciativa_id FROM line_trim))"
    f" AND NOT {_NEAR_STANDING}",
)
# What costs value, protects nothing and enables nothing is in no best set.
define(
    "line_item",
    "SELECT *, row_number() OVER (PARTITION BY linea_id ORDER BY id) AS rn FROM line_open o WHERE (needs IS NULL OR needs <> id)"
    " AND (value > 0 OR kind = 1 OR id IN (SELECT needs FROM line_open WHERE needs IS NOT NULL))",
)
define(
    "line_subset",
    "SELECT linea_id, 0::BIGINT AS rn, 0 AS n, 0::DOUBLE AS cost, 0::DOUBLE AS cost_2, 0::DOUBLE AS value, 0 AS kinds,"
    " []::STRUCT(id VARCHAR, grp VARCHAR, cost DOUBLE, quick INT)[] AS taken, []::VARCHAR[] AS needs FROM line_room"
    " WHERE room >= 0 AND room_2 >= 0 AND places >= 0"
    " UNION ALL SELECT s.linea_id, i.rn, s.n + 1, s.cost + i.cost, s.cost_2 + i.cost_2, s.value + i.value, s.kinds + i.kind,"
    " list_append(s.taken, {'id': i.id, 'grp': i.grp, 'cost': i.cost, 'quick': i.quick::INT}),"
    " CASE WHEN i.needs IS NULL THEN s.needs ELSE list_append(s.needs, i.needs) END"
    " FROM line_subset s JOIN line_room l ON l.linea_id = s.linea_id JOIN line_item i ON i.linea_id = s.linea_id AND i.rn > s.rn"
    " WHERE s.n < l.places AND len(list_filter(s.taken, lambda t: t.grp = i.grp AND (abs(t.cost - i.cost) <= 100000"
    " OR (t.quick = 1 AND i.quick = 1)))) = 0",
)
define(
    "line_best",
    "SELECT s.linea_id, max(s.value) AS value, arg_max(list_transform(s.taken, lambda t: t.id), s.value) AS ids, arg_max(s.kinds, s.value) AS kinds"
    " FROM line_subset s JOIN line_room l USING (linea_id) WHERE s.cost <= l.room + 1e-6 AND s.cost_2 <= l.room_2 + 1e-6"
    " AND s.kinds >= l.missing AND list_has_all(list_transform(s.taken, lambda t: t.id), s.needs) GROUP BY 1",
)
_LINE_OPTIMUM = (
    "SELECT l.linea_id, array_to_string(list_sort(list_concat(l.forced, coalesce(b.ids, []))), ',') AS selected,"
    " CASE WHEN room < 0 OR room_2 < 0 OR places < 0 THEN 'infeasible_forced_constraints' WHEN b.ids IS NULL"
    " THEN 'infeasible_no_feasible_solution' ELSE 'solved_exact' END AS status, l.worth + coalesce(b.value, 0) AS objective_value_eur,"
    " l.minimum AS reliability_min, (l.forced_rel + coalesce(b.kinds, 0))::INT AS reliability_selected,"
    " (len(l.forced) + coalesce(len(b.ids), 0))::INT AS initiatives FROM line_room l LEFT JOIN line_best b USING (linea_id)"
)


@query(
    "line_portfolio_optimum",
    final(f"({_LINE_OPTIMUM})", "linea_id selected status objective_value_eur~ reliability_min reliability_selected initiatives", 2),
    digits=2,
)
def line_portfolio_optimum(spark, sf):
    layers = Layers(spark, sf)
    budgets = portfolio.what_if_budgets(spark, **LINE_LIMITS).where("budget_scenario = 'base'")
    best = portfolio.optimal_portfolio(layers.stored("priorities"), layers.dependencies(), budgets, ["linea_id"], 0.1)
    return best.select(
        "linea_id", F.array_join("selected", ",").alias("selected"), "status", "objective_value_eur", "reliability_min",
        "reliability_selected", "initiatives",
    )


@query("plant_portfolio_optimum", digits=2)
def plant_portfolio_optimum(spark, sf):
    """Every plant and budget scenario, at a minimum that leaves room for other items; no SQL: subsets of hundreds of items."""
    layers = Layers(spark, sf)
    best = portfolio.optimal_portfolio(layers.stored("priorities"), layers.dependencies(), layers.budgets(), ["planta_id"], 0.05)
    return best.drop("nodes", "core_items")


define(
    "unlocked",
    "SELECT s.planta_id, s.budget_scenario, sum(p.objective_value_eur) AS v FROM selection s JOIN priority p USING (iniciativa_id)"
    " WHERE s.selected_portfolio_flag = 1 GROUP BY ALL",
)


@query(
    "unlocked_value",
    final(
        "(SELECT a.planta_id, a.budget_scenario AS constraint_relaxation, b.v AS baseline_objective_eur,"
        " a.v AS relaxed_objective_eur, CASE WHEN a.v - b.v >= 1e-3 THEN a.v - b.v ELSE 0 END AS unlocked_value_eur"
        " FROM unlocked a JOIN unlocked b ON b.planta_id = a.planta_id AND b.budget_scenario = 'base'"
        " WHERE a.budget_scenario <> 'base')",
        "planta_id constraint_relaxation baseline_objective_eur~ relaxed_objective_eur~ unlocked_value_eur~",
        2,
    ),
    digits=2,
)
def unlocked_value(spark, sf):
    layers = Layers(spark, sf)
    return portfolio.unlocked_value(layers.stored("selection"), layers.stored("priorities"), ["planta_id"])


define(
    "base_pick",
    "SELECT p.*, s.selected_portfolio_flag, s.preblocked,"
    " 8000000 - coalesce(sum(p.capex_estimado) FILTER (WHERE s.selected_portfolio_flag = 1) OVER g, 0) AS spare_c,"
    " 1800000 - coalesce(sum(p.implementation_opex) FILTER (WHERE s.selected_portfolio_flag = 1) OVER g, 0) AS spare_o"
    " FROM priority p JOIN selection s ON s.iniciativa_id = p.iniciativa_id AND s.budget_scenario = 'base'"
    " WINDOW g AS (PARTITION BY p.planta_id)",
)
define(
    "reasoned",
    "SELECT b.*, CASE WHEN b.selected_portfolio_flag = 1 THEN 'seleccionada_modelo_optimizacion'"
    " WHEN b.preblocked IS NOT NULL THEN b.preblocked"
    " WHEN d.iniciativa_id IS NOT NULL AND d.depends_on_iniciativa_id NOT IN (SELECT iniciativa_id FROM base_pick"
    " WHERE selected_portfolio_flag = 1) THEN 'dependencia_no_satisfecha'"
    " WHEN EXISTS (SELECT 1 FROM base_pick o WHERE o.selected_portfolio_flag = 1 AND o.planta_id = b.planta_id"
    " AND o.linea_id = b.linea_id AND o.categoria_iniciativa = b.categoria_iniciativa"
    " AND (abs(o.capex_estimado - b.capex_estimado) <= 100000 OR (o.quick_win_flag = 1 AND b.quick_win_flag = 1)))"
    " THEN 'conflicto_con_cartera'"
    " WHEN b.capex_estimado > spare_c + 1e-6 AND b.implementation_opex > spare_o + 1e-6 THEN 'presion_capex_y_opex'"
    " WHEN b.capex_estimado > spare_c + 1e-6 THEN 'presion_capex'"
    " WHEN b.implementation_opex > spare_o + 1e-6 THEN 'presion_opex'"
    " ELSE 'dominada_por_funcion_objetivo' END AS portfolio_constraint_reason"
    " FROM base_pick b LEFT JOIN dependency d ON d.iniciativa_id = b.iniciativa_id",
)
define(
    "waved_1",
    "SELECT *, (payback_months <= 24 AND implementation_burden <= 75 AND npv_risk_adjusted > 0) AS ready,"
    " row_number() OVER (PARTITION BY planta_id, (payback_months <= 24 AND implementation_burden <= 75"
    " AND npv_risk_adjusted > 0) ORDER BY portfolio_objective_score DESC, improvement_priority_index DESC, iniciativa_id) AS r1"
    " FROM reasoned WHERE selected_portfolio_flag = 1",
)
define(
    "waved_2",
    "SELECT planta_id, iniciativa_id, CASE WHEN first THEN 'OLA_1' WHEN r2 <= 10 THEN 'OLA_2' ELSE 'OLA_3' END AS portfolio_wave"
    " FROM (SELECT *, ready AND r1 <= 10 AS first, row_number() OVER (PARTITION BY planta_id, (ready AND r1 <= 10)"
    " ORDER BY portfolio_objective_score DESC, improvement_priority_index DESC, iniciativa_id) AS r2 FROM waved_1)",
)
define(
    "decided",
    "SELECT r.*, coalesce(w.portfolio_wave, 'BACKLOG') AS portfolio_wave,"
    " CASE WHEN improvement_priority_index >= 80 THEN 'Tier 1' WHEN improvement_priority_index >= 66 THEN 'Tier 2'"
    " WHEN improvement_priority_index >= 52 THEN 'Tier 3' ELSE 'Tier 4' END AS initiative_tier,"
    " CASE WHEN selected_portfolio_flag = 1 AND w.portfolio_wave = 'OLA_1' AND improvement_priority_index >= 50"
    " AND npv_risk_adjusted > 0 AND payback_months <= 24 THEN 'ejecutar ahora'"
    " WHEN selected_portfolio_flag = 1 THEN 'ejecutar en siguiente ola'"
    " WHEN improvement_priority_index >= 58 AND uncertainty_index >= 45 THEN 'piloto'"
    " WHEN improvement_priority_index >= 50 THEN 'analizar técnicamente'"
    " WHEN improvement_priority_index >= 40 THEN 'mantener en pipeline' ELSE 'descartar' END AS decision_rule,"
    " CASE initiative_class WHEN 'mandatory' THEN 'Protección de continuidad operativa crítica'"
    " WHEN 'compliance-driven' THEN 'Cumplimiento regulatorio y mitigación de exposición'"
    " WHEN 'reliability-protection' THEN 'Confiabilidad y disponibilidad estructural' ELSE"
    " CASE WHEN financial_maturity_stage = 'business_case_candidate'"
    " THEN 'Candidato business case (requiere cierre financiero corporativo)'"
    " WHEN payback_months <= 18 AND energy_saving_score >= 65 THEN 'Ahorro energético de captura rápida'"
    " WHEN capex_estimado >= 700000 AND downside_adjusted_value > 0"
    " THEN 'Transformación CAPEX con valor downside-adjusted positivo'"
    " ELSE 'Optimización incremental orientada a valor' END END AS main_business_case,"
    " CASE WHEN selected_portfolio_flag = 1 THEN npv_risk_adjusted ELSE 0 END AS portfolio_npv_contribution,"
    " row_number() OVER (ORDER BY round(portfolio_objective_score, 9) DESC, round(improvement_priority_index, 9) DESC,"
    " r.iniciativa_id) AS place FROM reasoned r LEFT JOIN waved_2 w ON w.iniciativa_id = r.iniciativa_id",
)
_FINAL_OUT = (
    "iniciativa_id planta_id initiative_class selected_portfolio_flag portfolio_constraint_reason portfolio_wave"
    " initiative_tier decision_rule main_business_case portfolio_npv_contribution~"
)


@query("investment_prioritization", final("decided", _FINAL_OUT, 3), digits=3)
def investment_prioritization(spark, sf):
    return Layers(spark, sf).prioritization().select(*[c.rstrip("~") for c in _FINAL_OUT.split()])


@query(
    "recommended_sequence",
    "SELECT iniciativa_id, 'OLA_' || CASE WHEN place < 10 THEN '0' ELSE '' END || place AS recommended_sequence FROM decided",
)
def recommended_sequence(spark, sf):
    return Layers(spark, sf).stored("prioritization").select("iniciativa_id", "recommended_sequence")


def _sel(x: str) -> str:
    return f"coalesce(sum({x}) FILTER (WHERE selected_portfolio_flag = 1), 0)"


@query(
    "portfolio_summary",
    final(
        "(SELECT planta_id, 8000000::DOUBLE AS capex_budget, 1800000::DOUBLE AS opex_budget, "
        + _sel("capex_estimado") + " AS capex_selected, " + _sel("implementation_opex") + " AS opex_selected,"
        " count(*) FILTER (WHERE selected_portfolio_flag = 1) AS initiatives_selected, "
        + _sel("npv_risk_adjusted") + " AS npv_risk_adjusted_portfolio, "
        + _sel("payback_months * improvement_priority_index") + " / nullif(" + _sel("improvement_priority_index")
        + ", 0) AS weighted_payback_portfolio, " + _sel("downside_adjusted_value") + " AS downside_adjusted_value_portfolio, "
        + _sel("capital_efficiency * capex_estimado") + " / nullif(" + _sel("capex_estimado")
        + ", 0) AS capital_efficiency_weighted,"
        " count(*) FILTER (WHERE selected_portfolio_flag = 1 AND financial_maturity_stage = 'pre_feasibility')"
        " AS pre_feasibility_count_selected, " + _sel("objective_value_eur")
        + " AS objective_value_eur_portfolio FROM decided GROUP BY ALL)",
        "planta_id capex_budget~ opex_budget~ capex_selected~ opex_selected~ initiatives_selected"
        " npv_risk_adjusted_portfolio~ weighted_payback_portfolio~ downside_adjusted_value_portfolio~"
        " capital_efficiency_weighted~ pre_feasibility_count_selected objective_value_eur_portfolio~",
        2,
    ),
    digits=2,
)
def portfolio_summary(spark, sf):
    summary = portfolio.portfolio_summary(Layers(spark, sf).stored("prioritization"), keys=["planta_id"])
    return summary.select(
        "planta_id", "capex_budget", "opex_budget", "capex_selected", "opex_selected", "initiatives_selected",
        "npv_risk_adjusted_portfolio", "weighted_payback_portfolio", "downside_adjusted_value_portfolio",
        "capital_efficiency_weighted", "pre_feasibility_count_selected", "objective_value_eur_portfolio",
    )


define(
    "pressure_base",
    "SELECT planta_id, " + _sel("capex_estimado") + " AS c, " + _sel("implementation_opex") + " AS o,"
    " count(*) FILTER (WHERE selected_portfolio_flag = 1) AS n,"
    " count(*) FILTER (WHERE selected_portfolio_flag = 1 AND initiative_class = 'reliability-protection') AS rel,"
    " ceil(0.6 * count(*) FILTER (WHERE initiative_class = 'reliability-protection')) AS rel_min FROM decided GROUP BY ALL",
)


@query(
    "constraint_pressure",
    final(
        "(SELECT planta_id, 'capex_budget' AS constraint_name, c AS used, 8000000 AS limit_, c / 80000 AS utilization_pct,"
        " (c >= 0.98 * 8000000)::INT AS active_flag FROM pressure_base UNION ALL"
        " SELECT planta_id, 'opex_budget', o, 1800000, o / 18000, (o >= 0.98 * 1800000)::INT FROM pressure_base UNION ALL"
        " SELECT planta_id, 'selection_capacity', n, 24, 100 * n / 24, (n >= 24)::INT FROM pressure_base UNION ALL"
        " SELECT planta_id, 'reliability_min_coverage', rel, rel_min, 100 * rel / greatest(rel_min, 1),"
        " (rel <= rel_min AND rel_min > 0)::INT FROM pressure_base)",
        "planta_id constraint_name used~ limit_~ utilization_pct~ active_flag",
        2,
    ),
    digits=2,
)
def constraint_pressure(spark, sf):
    limits = {"capex": portfolio.CAPEX_BUDGET, "opex": portfolio.OPEX_BUDGET, "max_n": portfolio.MAX_INITIATIVES}
    return portfolio.constraint_pressure(
        Layers(spark, sf).stored("prioritization"), limits, ["planta_id"]
    ).withColumnRenamed("limit", "limit_")


@query(
    "selected_vs_excluded",
    final(
        "(SELECT *, selected_portfolio_flag AS selection_variable_x FROM decided)",
        "iniciativa_id initiative_class selected_portfolio_flag selection_variable_x portfolio_constraint_reason"
        " objective_value_eur~ downside_adjusted_value~ capex_estimado~ implementation_opex~ payback_months~ portfolio_wave",
        3,
    ),
    digits=3,
)
def selected_vs_excluded(spark, sf):
    return portfolio.selected_vs_excluded(Layers(spark, sf).stored("prioritization"))


@query(
    "top_quick_wins_and_large_investments",
    final(
        "(SELECT * FROM (SELECT 'quick_win' AS lista, iniciativa_id, improvement_priority_index FROM decided"
        " WHERE quick_win_flag = 1 ORDER BY improvement_priority_index DESC, iniciativa_id LIMIT 8)"
        " UNION ALL SELECT * FROM (SELECT 'capex', iniciativa_id, improvement_priority_index FROM decided"
        " WHERE capex_estimado >= 700000 ORDER BY improvement_priority_index DESC, iniciativa_id LIMIT 8))",
        "lista iniciativa_id improvement_priority_index~",
    ),
)
def top_quick_wins_and_large_investments(spark, sf):
    done = Layers(spark, sf).stored("prioritization")
    columns_ = ["iniciativa_id", "improvement_priority_index"]
    quick = portfolio.leading(done, F.col("quick_win_flag") == 1).select(F.lit("quick_win").alias("lista"), *columns_)
    large = portfolio.leading(done, F.col("capex_estimado") >= 700_000).select(F.lit("capex").alias("lista"), *columns_)
    return quick.unionByName(large)


@query(
    "density_prefix_portfolio",
    "SELECT planta_id, iniciativa_id, (sum(capex_estimado) OVER w <= 8000000 + 1e-6"
    " AND sum(implementation_opex) OVER w <= 1800000 + 1e-6)::INT AS within_budget FROM priority"
    " WINDOW w AS (PARTITION BY planta_id ORDER BY objective_value_eur / nullif(capex_estimado, 0) DESC NULLS LAST,"
    " iniciativa_id ROWS UNBOUNDED PRECEDING)",
)
def density_prefix_portfolio(spark, sf):
    layers = Layers(spark, sf)
    items = layers.stored("priorities").select(
        "planta_id", "iniciativa_id", "objective_value_eur", "capex_estimado", "implementation_opex"
    )
    limits = portfolio.budgets_per_portfolio(items, layers.budgets().where("budget_scenario = 'base'"), ["planta_id"])
    return portfolio.density_prefix(items, limits).select("planta_id", "iniciativa_id", "within_budget")


# --- graph levels ---------------------------------------------------------------------------
@query(
    "conversation_turn_levels",
    "SELECT conv_id || '/' || turn AS node,"
    " (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS level FROM (SELECT DISTINCT conv_id, turn"
    " FROM conversations) QUALIFY count(*) OVER (PARTITION BY conv_id) > 1",
)
def conversation_turn_levels(spark, sf):
    """Topological levels of the reply graph: every turn answers the turn before it."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn").distinct()
    node = F.concat_ws("/", "conv_id", "turn")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), node.alias("reply"))
    edges = turns.withColumn("said", node).join(later, ["conv_id", "turn"])
    return topological_levels(edges.select("said", "reply"), "said", "reply")


@query(
    "dependency_cycles",
    "SELECT iniciativa_id AS node FROM cyclic",
)
def dependency_cycles(spark, sf):
    from ..operators.graph import cyclic_nodes

    return cyclic_nodes(Layers(spark, sf).dependencies(), "depends_on_iniciativa_id", "iniciativa_id")
