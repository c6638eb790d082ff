"""Scenario cube: every initiative under every macro scenario, with its financial figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finance
from ..functions.expr import clip, finite_or_zero, flag, half_even, lookup, or_zero, ratio
from ..operators.joins import band_stats, block_pairs, left_on, value_blocks, with_table_stats
from ..operators.ordering import top_per_group, with_position
from ..operators.tables import keep_matching_or_all, literal_table, stack_rows


@dataclass(frozen=True)
class Lever:
    label: str
    reduction_consumption: float
    sec_improvement: float
    oee_improvement: float
    stops_reduction: float
    emission_reduction: float
    execution_ease: int
    ramp_months: int
    start_delay_months: int


@dataclass(frozen=True)
class Macro:
    energy_price_mult: float
    carbon_cost_mult: float
    margin_operativo_mult: float
    delay_mult: float
    capex_overrun_pct: float
    capture_shortfall_pct: float


# Improvement levers, macro sensitivities and risk factors.
LEVERS = {
    "quick_wins_operativos": Lever("Quick Wins Operativos", 0.045, 0.050, 0.015, 0.060, 0.040, 88, 3, 1),
    "mantenimiento_restauracion": Lever("Mantenimiento y Restauración de Performance", 0.025, 0.030, 0.028, 0.180, 0.022, 67, 5, 2),
    "optimizacion_parametros": Lever("Optimización de Parámetros de Proceso", 0.065, 0.070, 0.035, 0.110, 0.060, 58, 6, 2),
    "reduccion_scrap_reproceso": Lever("Reducción de Scrap/Reproceso", 0.020, 0.025, 0.030, 0.040, 0.018, 72, 4, 1),
    "electrificacion_sustitucion": Lever("Electrificación o Sustitución de Equipos", 0.090, 0.085, 0.025, 0.080, 0.120, 42, 9, 4),
    "recuperacion_energetica": Lever("Recuperación Energética", 0.110, 0.100, 0.018, 0.030, 0.095, 54, 8, 3),
    "capex_mayor": Lever("CAPEX Mayor", 0.160, 0.145, 0.060, 0.210, 0.170, 30, 14, 6),
}
MACROS = {
    "Base": Macro(1.00, 1.00, 1.00, 1.00, 0.00, 0.00),
    "ShockEnergia": Macro(1.24, 1.05, 0.98, 1.08, 0.03, 0.04),
    "AltaDemanda": Macro(1.10, 1.00, 1.12, 1.15, 0.05, 0.06),
    "RestriccionOperativa": Macro(1.06, 1.00, 0.95, 1.32, 0.08, 0.12),
}
EXECUTION_RISK_FACTOR = {"Bajo": 0.92, "Medio": 0.78, "Alto": 0.60}
UNKNOWN_RISK_FACTOR = 0.72
CARBON_COST_EUR_TON = 90.0
LARGE_CAPEX = 700_000.0
CONFLICT_GAP = 100_000


def scenario_key() -> Column:
    """Lever of an initiative by ordered rules on its flags and texts."""
    kind, category, capex = F.col("tipo_iniciativa"), F.col("categoria_iniciativa"), F.col("capex_estimado")
    recovery = kind.contains("Recuperacion") | category.contains("Energet")
    return (
        F.when(F.col("quick_win_flag") == 1, "quick_wins_operativos")
        .when(kind.contains("Mantenimiento"), "mantenimiento_restauracion")
        .when(kind.contains("Optim") | category.contains("Proceso"), "optimizacion_parametros")
        .when(kind.contains("Scrap"), "reduccion_scrap_reproceso")
        .when(kind.contains("Electr"), "electrificacion_sustitucion")
        .when(recovery & (capex <= LARGE_CAPEX), "recuperacion_energetica")
        .when(recovery, "electrificacion_sustitucion")
        .when(capex >= 900_000, "capex_mayor")
        .otherwise("reduccion_scrap_reproceso")
    )


def line_baseline(line_days: DataFrame, lines: DataFrame) -> DataFrame:
    return (
        line_days.join(lines.select("linea_id", "criticidad_linea"), "linea_id")
        .groupBy("planta_id", "linea_id")
        .agg(
            F.avg("sec_kwh_ton").alias("sec_base"),
            F.avg("oee_synthetic").alias("oee_base"),
            F.sum("cost_energy_total").alias("cost_energy_base"),
            F.sum("emissions_kg").alias("emissions_base_kg"),
            F.sum("loss_value_proxy_eur").alias("loss_base_eur"),
            F.sum("n_paradas").alias("stops_base"),
            F.avg("criticidad_linea").alias("criticidad_linea"),
        )
    )


def macro_shocks(scenarios: DataFrame) -> DataFrame:
    return scenarios.groupBy("escenario").agg(
        *[
            F.avg(c).alias(c)
            for c in (
                "precio_energia_shock",
                "presion_demanda_indice",
                "disponibilidad_personal_indice",
                "restriccion_operativa_indice",
            )
        ]
    )


def dependencies(value_pool: DataFrame) -> DataFrame:
    """Every large investment depends on its line's largest maintenance or optimisation item."""
    enabling = F.col("tipo_iniciativa").rlike("(?i)Mantenimiento|Optim")
    first = top_per_group(
        value_pool.where(enabling),
        ["planta_id", "linea_id"],
        [F.desc_nulls_last("capex_estimado"), F.asc("iniciativa_id")],
        1,
    ).select("planta_id", "linea_id", F.col("iniciativa_id").alias("depends_on_iniciativa_id"))
    return (
        value_pool.where(F.col("capex_estimado") >= LARGE_CAPEX)
        .select("iniciativa_id", "planta_id", "linea_id")
        .join(first, ["planta_id", "linea_id"])
        .select(
            "iniciativa_id",
            "depends_on_iniciativa_id",
            F.lit("alta").alias("dependency_strength"),
            F.lit(12.0).alias("dependency_penalty_pct"),
            "linea_id",
        )
    )


CONFLICT_GROUP = ["planta_id", "linea_id", "categoria_iniciativa"]


def conflicts(value_pool: DataFrame) -> DataFrame:
    """Pairs of one line and category with close investments, or both quick wins.

    Quick wins of a group conflict pairwise by definition, other pairs within ``CONFLICT_GAP``. The pool is read
    once and stored in blocks along the investment; see ``block_pairs``. Use ``conflict_penalties`` when only
    the effect per initiative is needed: it never forms a pair.
    """
    pool = value_pool.withColumn("quick", F.coalesce(F.col("quick_win_flag") == 1, F.lit(False)))
    blocks = value_blocks(pool, [*CONFLICT_GROUP, "quick"], "iniciativa_id", "capex_estimado")
    both_quick = F.col("quick_1") & F.col("quick_2")

    def listed(pairs: DataFrame, penalty: float) -> DataFrame:
        return pairs.select(
            F.col("id_1").alias("iniciativa_id_1"),
            F.col("id_2").alias("iniciativa_id_2"),
            "linea_id",
            F.lit("solape_recursos").alias("conflict_type"),
            F.lit(penalty).alias("conflict_penalty_pct"),
        )

    return stack_rows(
        listed(block_pairs(blocks, CONFLICT_GROUP, both_quick), 8.0),
        listed(block_pairs(blocks, CONFLICT_GROUP, ~both_quick, CONFLICT_GAP), 12.0),
    )


def conflict_numbers(value_pool: DataFrame) -> DataFrame:
    """Number of conflicts (``conflicts``) of every initiative that has one, from counts instead of pairs.

    Partners are the close ones and, for a quick win, the far quick wins of its group. Repeated rows
    of an initiative with one investment are no partners of each other, but each counts for the others.
    """
    whole = value_pool.dropna(subset=[*CONFLICT_GROUP, "iniciativa_id", "capex_estimado"])
    rows = whole.groupBy(*CONFLICT_GROUP, "iniciativa_id", "capex_estimado").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("quick_win_flag") == 1).alias("__nq")
    )
    near = band_stats(
        rows, CONFLICT_GROUP, "capex_estimado", CONFLICT_GAP, {"__near": F.col("__n"), "__near_quick": F.col("__nq")}, {}
    )
    quick = rows.groupBy(*CONFLICT_GROUP).agg(F.sum("__nq").alias("__quick"))
    partners = F.col("__n") * (F.col("__near") - F.col("__n")) + F.col("__nq") * (F.col("__quick") - F.col("__near_quick"))
    counted = rows.join(near, [*CONFLICT_GROUP, "capex_estimado"]).join(quick, CONFLICT_GROUP)
    return counted.groupBy("iniciativa_id").agg(F.sum(partners).alias("conflicts")).where("conflicts > 0")


def conflict_penalties(value_pool: DataFrame) -> DataFrame:
    """Summed conflict penalty per initiative, from counts instead of pairs.

    A quick win conflicts with every other quick win of its group (8 points each) and with the
    close other items (12 points each); any other item with all close items (12 points each).
    """
    is_quick = F.col("quick_win_flag") == 1
    near = band_stats(
        value_pool,
        CONFLICT_GROUP,
        "capex_estimado",
        CONFLICT_GAP,
        {"__near": F.lit(1), "__near_quick": is_quick.cast("int")},
        {},
    )
    quick = value_pool.where(F.col("capex_estimado").isNotNull()).groupBy(*CONFLICT_GROUP).agg(
        F.count_if(is_quick).alias("__quick")
    )
    counted = left_on(left_on(value_pool, near, [*CONFLICT_GROUP, "capex_estimado"]), quick, CONFLICT_GROUP)
    points = F.when(
        is_quick, 8.0 * (F.col("__quick") - 1) + 12.0 * (F.col("__near") - F.col("__near_quick"))
    ).otherwise(12.0 * (F.col("__near") - 1))
    return counted.select("iniciativa_id", or_zero(points).alias("conflict_penalty_pct"))


def dependency_penalties(deps: DataFrame) -> DataFrame:
    return deps.groupBy("iniciativa_id").agg(F.max("dependency_penalty_pct").alias("dependency_penalty_pct"))


def _lever_field(name: str) -> Column:
    return lookup("scenario_key", {k: getattr(v, name) for k, v in LEVERS.items()})


def _macro_field(name: str) -> Column:
    values = {k: getattr(v, name) for k, v in MACROS.items()}
    return lookup("macro_scenario", values, values["Base"])


def with_macro_scenarios(initiatives: DataFrame, shocks: DataFrame) -> DataFrame:
    """One row per initiative and macro scenario.

    The scenario averages (one row per label of the scenario table) travel as an array inside a
    scalar subquery and are exploded next to each initiative.
    """
    fields = [c for c in shocks.columns if c != "escenario"]
    entry = F.struct(F.col("escenario").alias("macro_scenario"), *fields)
    every = shocks.agg(F.sort_array(F.collect_list(entry)).alias("every")).scalar()
    return initiatives.withColumn("__macro", F.explode(every)).select(
        *initiatives.columns, "__macro.macro_scenario", *[f"__macro.{f}" for f in fields]
    )


def scenario_table(value_pool: DataFrame, baseline: DataFrame, shocks: DataFrame) -> DataFrame:
    """Exposures, captured value, discounted value and risk of each initiative and scenario."""
    deps = dependency_penalties(dependencies(value_pool))
    penalised = (
        value_pool.withColumn("scenario_key", scenario_key())
        .join(baseline, ["planta_id", "linea_id"])
        .join(deps, "iniciativa_id", "left")
        .join(conflict_penalties(value_pool), "iniciativa_id", "left")
        .fillna(0.0, ["dependency_penalty_pct", "conflict_penalty_pct"])
    )
    cube = with_macro_scenarios(penalised, shocks)
    shortfall, ease = F.col("capture_shortfall_pct"), F.col("facilidad_ejecucion") / 100.0
    strength = F.col("__strength")

    cube = cube.withColumns(
        {
            "escenario_label": _lever_field("label"),
            "facilidad_ejecucion": _lever_field("execution_ease"),
            "capture_shortfall_pct": _macro_field("capture_shortfall_pct"),
            "capex_overrun_pct": _macro_field("capex_overrun_pct"),
            "capex_base": or_zero("capex_estimado"),
            "__strength": (1.0 + 0.08 * (F.col("criticidad_linea") - 3.0))
            * (
                0.50 * F.col("precio_energia_shock")
                + 0.30 * F.col("presion_demanda_indice")
                + 0.20 * F.col("restriccion_operativa_indice")
            ),
            "assumption_energy_price_mult": F.col("precio_energia_shock") * _macro_field("energy_price_mult"),
            "assumption_carbon_cost_eur_ton": CARBON_COST_EUR_TON * _macro_field("carbon_cost_mult"),
            "assumption_margin_operativo_mult": _macro_field("margin_operativo_mult"),
            "implementation_opex": F.greatest(
                F.lit(0.0),
                or_zero("opex_impacto_proxy") * (0.90 + 0.10 * F.col("presion_demanda_indice")),
            ),
        }
    )
    cube = cube.withColumns(
        {
            "__consumption": clip(_lever_field("reduction_consumption") * strength, 0.0, 0.50),
            "__sec": clip(_lever_field("sec_improvement") * strength, 0.0, 0.40),
            "__oee": clip(
                _lever_field("oee_improvement") * (1.0 + F.col("impacto_esperado_oee_pct") / 100.0), 0.0, 0.35
            ),
            "__stops": clip(_lever_field("stops_reduction") * strength, 0.0, 0.55),
            "__emission": clip(_lever_field("emission_reduction") * strength, 0.0, 0.55),
            "baseline_energy_exposure": F.greatest(
                F.lit(0.0), F.col("cost_energy_base") * F.col("assumption_energy_price_mult")
            ),
            "baseline_non_energy_exposure": F.greatest(
                F.lit(0.0),
                (F.col("loss_base_eur") - F.col("cost_energy_base")) * F.col("assumption_margin_operativo_mult"),
            ),
            "baseline_emission_cost": F.greatest(
                F.lit(0.0), F.col("emissions_base_kg") / 1000.0 * F.col("assumption_carbon_cost_eur_ton")
            ),
            "success_probability": clip(
                clip(
                    0.22
                    + 0.46 * ease
                    + 0.20 * lookup("riesgo_implantacion", EXECUTION_RISK_FACTOR, UNKNOWN_RISK_FACTOR)
                    + 0.12 * F.col("disponibilidad_personal_indice"),
                    0.20,
                    0.95,
                )
                * (1.0 - shortfall),
                0.15,
                0.93,
            ),
            "ramp_up_months": F.greatest(
                half_even(
                    _lever_field("ramp_months")
                    * _macro_field("delay_mult")
                    * (1.0 + F.greatest(F.lit(0.0), F.col("restriccion_operativa_indice") - 1.0))
                ),
                F.lit(1.0),
            ),
            "start_delay_months": F.greatest(
                half_even(
                    _lever_field("start_delay_months")
                    * _macro_field("delay_mult")
                    * (1.0 + F.greatest(F.lit(0.0), 1.0 - F.col("disponibilidad_personal_indice")))
                ),
                F.lit(0.0),
            ),
            "capex_estimado": F.greatest(F.lit(0.0), F.col("capex_base") * (1.0 + F.col("capex_overrun_pct"))),
        }
    )
    avoided = clip(0.48 * F.col("__stops") + 0.32 * F.col("__oee") + 0.20 * F.col("__sec"), 0.0, 0.72)
    cube = cube.withColumns(
        {
            "baseline_economic_exposure": F.col("baseline_energy_exposure")
            + F.col("baseline_non_energy_exposure")
            + F.col("baseline_emission_cost"),
            "gross_technical_value_energy": F.col("baseline_energy_exposure") * F.col("__consumption"),
            "avoided_loss": F.col("baseline_non_energy_exposure") * avoided,
            "gross_technical_value_emissions": F.col("baseline_emission_cost") * F.col("__emission"),
            "expected_capture_rate": clip(
                F.col("success_probability")
                * (1.0 - F.least(F.lit(0.20), F.col("dependency_penalty_pct") / 100.0))
                * (1.0 - F.least(F.lit(0.25), F.col("conflict_penalty_pct") / 100.0)),
                0.10,
                0.92,
            ),
        }
    )
    cube = cube.withColumns(
        {
            "downside_capture_rate": clip(
                F.col("expected_capture_rate") * 0.72, 0.05, F.col("expected_capture_rate")
            ),
            "gross_technical_value": F.greatest(
                F.lit(0.0),
                F.col("gross_technical_value_energy")
                + F.col("avoided_loss")
                + F.col("gross_technical_value_emissions"),
            ),
        }
    )
    return _with_finance(cube)


SCENARIO_COLUMNS = (
    "iniciativa_id planta_id linea_id macro_scenario scenario_key escenario_label"
    " reduccion_consumo_pct mejora_sec_pct mejora_oee_pct reduccion_paradas_pct"
    " reduccion_emisiones_pct baseline_energy_exposure baseline_non_energy_exposure"
    " baseline_emission_cost baseline_economic_exposure gross_technical_value_energy avoided_loss"
    " gross_technical_value_emissions gross_technical_value implementation_opex"
    " net_operational_value net_captured_value downside_adjusted_annual discounted_value"
    " downside_adjusted_value cost_of_delay_12m capital_efficiency screening_irr_pct"
    " formal_irr_candidate_pct formal_irr_candidate_flag screening_var_95_npv"
    " robust_risk_metric_candidate_npv capex_estimado capex_base capex_overrun_pct"
    " success_probability expected_capture_rate downside_capture_rate capture_shortfall_pct"
    " start_delay_months ramp_up_months ramp_up_penalty_value dependency_penalty_pct"
    " conflict_penalty_pct npv_base npv_risk_adjusted irr_proxy_pct payback_meses"
    " downside_annual_savings_p20 value_at_risk_95 implementation_burden"
    " strategic_relevance_score facilidad_ejecucion financial_maturity_stage"
    " financial_use_label committee_wording_status assumption_energy_price_mult"
    " assumption_carbon_cost_eur_ton assumption_margin_operativo_mult gross_annual_savings"
    " net_annual_savings risk_adjusted_annual_savings"
).split()


def _with_finance(cube: DataFrame) -> DataFrame:
    gross, opex, capex = F.col("gross_technical_value"), F.col("implementation_opex"), F.col("capex_estimado")
    delay, ramp = F.col("start_delay_months"), F.col("ramp_up_months")

    def net(rate: Column | float) -> Column:
        return F.greatest(F.lit(0.0), gross * rate - opex)

    valued = cube.withColumns(
        {
            "net_operational_value": net(1.0),
            "net_captured_value": net(F.col("expected_capture_rate")),
            "downside_adjusted_annual": net(F.col("downside_capture_rate")),
            "__worth": finance.discounted_months(F.lit(finance.HORIZON_MONTHS), delay, ramp),
            "__later": finance.discounted_months(F.lit(finance.HORIZON_MONTHS), delay + 12.0, ramp),
        }
    )

    def npv(annual: str, months: str = "__worth") -> Column:
        return -capex + F.col(annual) / 12.0 * F.col(months)

    captured = F.col("net_captured_value")
    valued = valued.withColumns(
        {
            "npv_base": npv("net_operational_value"),
            "discounted_value": npv("net_captured_value"),
            "downside_adjusted_value": npv("downside_adjusted_annual"),
            "__delayed": npv("net_captured_value", "__later"),
            "__repaid": finance.repayment(capex, captured, delay, ramp),
            "__first_year": captured / 12.0 * finance.captured_months(F.lit(12), delay, ramp),
            "screening_irr_pct": F.when(capex <= 0, 0.0).otherwise(
                F.least(F.lit(250.0), 100.0 * ratio(captured, capex))
            ),
        }
    )
    valued = valued.withColumns(
        {"payback_meses": F.col("__repaid.payback"), "formal_irr_candidate_pct": F.col("__repaid.rate_pct")}
    )
    value, downside = F.col("discounted_value"), F.col("downside_adjusted_value")
    valued = valued.withColumns(
        {
            "cost_of_delay_12m": F.greatest(F.lit(0.0), value - F.col("__delayed")),
            "ramp_up_penalty_value": F.greatest(F.lit(0.0), captured - F.col("__first_year")),
            "formal_irr_candidate_flag": flag(
                F.col("formal_irr_candidate_pct").isNotNull() & (capex >= 250_000)
            ).cast("double"),
            "value_at_risk_95": F.greatest(F.lit(0.0), captured - F.col("downside_adjusted_annual")),
            "screening_var_95_npv": F.greatest(F.lit(0.0), value - downside),
            "capital_efficiency": F.when(capex > 0, ratio(downside, capex)).otherwise(0.0),
            "implementation_burden": clip(
                100.0
                * (
                    0.35 * F.log1p(capex) / F.log1p(F.lit(2_200_000.0))
                    + 0.25 * (F.col("dificultad_implementacion") / 5.0)
                    + 0.20 * (ramp / 18.0)
                    + 0.20 * (1.0 - F.col("facilidad_ejecucion") / 100.0)
                ),
                0.0,
                100.0,
            ),
            "strategic_relevance_score": clip(
                100.0
                * (
                    0.40 * (F.col("criticidad_estrategica") / 5.0)
                    + 0.35 * (F.col("impacto_esperado_emisiones_pct") / 20.0)
                    + 0.25 * (F.col("criticidad_linea") / 5.0)
                ),
                0.0,
                100.0,
            ),
        }
    )
    candidate = (
        (capex >= 900_000)
        & (F.col("formal_irr_candidate_flag") == 1)
        & (value > 0)
        & (F.col("screening_var_95_npv") <= F.greatest(value, F.lit(1.0)) * 0.65)
    )
    stage = F.col("financial_maturity_stage")
    out = valued.withColumn(
        "financial_maturity_stage",
        F.when(candidate, "business_case_candidate").when(capex >= 250_000, "pre_feasibility").otherwise("screening"),
    ).withColumns(
        {
            "financial_use_label": F.when(
                stage == "business_case_candidate", "business_case_candidate_not_final"
            )
            .when(stage == "pre_feasibility", "pre_feasibility")
            .otherwise("screening_financiero"),
            "committee_wording_status": F.when(
                stage == "business_case_candidate", "candidate_with_caveat"
            ).otherwise("not_committee_grade_proxy"),
            "robust_risk_metric_candidate_npv": 1.25 * F.col("screening_var_95_npv"),
            "reduccion_consumo_pct": 100.0 * F.col("__consumption"),
            "mejora_sec_pct": 100.0 * F.col("__sec"),
            "mejora_oee_pct": 100.0 * F.col("__oee"),
            "reduccion_paradas_pct": 100.0 * F.col("__stops"),
            "reduccion_emisiones_pct": 100.0 * F.col("__emission"),
            "npv_risk_adjusted": value,
            "irr_proxy_pct": F.col("screening_irr_pct"),
            "downside_annual_savings_p20": F.col("downside_adjusted_annual"),
            "gross_annual_savings": gross,
            "net_annual_savings": F.col("net_operational_value"),
            "risk_adjusted_annual_savings": captured,
            "formal_irr_candidate_pct": finite_or_zero("formal_irr_candidate_pct"),
        }
    )
    return out.select(*SCENARIO_COLUMNS)


def base_scenario(table: DataFrame) -> DataFrame:
    """Rows of the base scenario, or all rows when there is none."""
    return keep_matching_or_all(table, F.lower("macro_scenario") == "base")


BEST_FIELDS = (
    "reduccion_consumo_pct",
    "mejora_sec_pct",
    "mejora_oee_pct",
    "reduccion_paradas_pct",
    "reduccion_emisiones_pct",
    "net_captured_value",
    "downside_adjusted_annual",
    "cost_of_delay_12m",
)


def baseline_vs_improved(table: DataFrame, baseline: DataFrame) -> DataFrame:
    """Line baseline next to its best base-scenario initiative."""
    best = top_per_group(
        base_scenario(table),
        ["planta_id", "linea_id"],
        [F.desc_nulls_last("net_captured_value"), F.asc("iniciativa_id")],
        1,
    ).select("planta_id", "linea_id", *BEST_FIELDS)

    def keep(c: str) -> Column:
        return 1.0 - or_zero(c) / 100.0

    return left_on(baseline, best, ["planta_id", "linea_id"]).withColumns(
        {
            "sec_mejorado": F.col("sec_base") * keep("mejora_sec_pct"),
            "oee_mejorado": F.col("oee_base") * (1.0 + or_zero("mejora_oee_pct") / 100.0),
            "coste_energia_mejorado": F.col("cost_energy_base") * keep("reduccion_consumo_pct"),
            "emisiones_mejoradas_kg": F.col("emissions_base_kg") * keep("reduccion_emisiones_pct"),
        }
    )


COMPARISON_KEYS = ("iniciativa_id", "planta_id", "linea_id", "scenario_key", "escenario_label", "capex_estimado")
COMPARISON_MEANS = {
    "gross_technical_value_mean": "gross_technical_value",
    "net_captured_value_mean": "net_captured_value",
    "downside_adjusted_annual_mean": "downside_adjusted_annual",
    "discounted_value_mean": "discounted_value",
    "downside_adjusted_value_mean": "downside_adjusted_value",
    "cost_of_delay_12m_mean": "cost_of_delay_12m",
    "capital_efficiency_mean": "capital_efficiency",
    "screening_var_95_npv_mean": "screening_var_95_npv",
    "discounted_payback_meses_mean": "payback_meses",
    "implementation_burden": "implementation_burden",
    "strategic_relevance_score": "strategic_relevance_score",
    "success_probability": "success_probability",
    "reduccion_emisiones_pct": "reduccion_emisiones_pct",
    "risk_adjusted_annual_savings_mean": "risk_adjusted_annual_savings",
    "npv_risk_adjusted_mean": "npv_risk_adjusted",
    "payback_meses": "payback_meses",
    "value_at_risk_95": "value_at_risk_95",
}


def initiative_comparison(table: DataFrame, keys: tuple[str, ...] = COMPARISON_KEYS) -> DataFrame:
    """Means over the scenarios with the trade-off score.

    The effective investment is a key, so scenarios with an overrun form their own rows.
    """
    grouped = table.groupBy(*keys).agg(*[F.avg(c).alias(n) for n, c in COMPARISON_MEANS.items()])
    tops = {
        "__npv": "downside_adjusted_value_mean",
        "__pay": "discounted_payback_meses_mean",
        "__em": "reduccion_emisiones_pct",
        "__eff": "capital_efficiency_mean",
        "__burden": "implementation_burden",
        "__var": "screening_var_95_npv_mean",
    }
    peaked = with_table_stats(grouped, {n: F.max(c) for n, c in tops.items()})

    def share(c: str, top: str) -> Column:
        return F.col(c) / F.coalesce(F.nullif(F.col(top), F.lit(0.0)), F.lit(1.0))

    score = 100.0 * (
        0.33 * share("downside_adjusted_value_mean", "__npv")
        + 0.15 * (1.0 - share("discounted_payback_meses_mean", "__pay"))
        + 0.15 * (F.col("strategic_relevance_score") / 100.0)
        + 0.12 * F.col("success_probability")
        + 0.10 * share("reduccion_emisiones_pct", "__em")
        + 0.10 * (F.col("capital_efficiency_mean") / F.greatest(F.col("__eff"), F.lit(1e-6)))
        + 0.05 * (1.0 - share("implementation_burden", "__burden"))
        - 0.12 * share("screening_var_95_npv_mean", "__var")
    )
    return peaked.withColumn("score_tradeoff", score).drop(*tops)


def scenario_ranking(comparison: DataFrame) -> DataFrame:
    return with_position(
        comparison,
        "ranking",
        [F.desc_nulls_last("score_tradeoff"), F.asc("iniciativa_id"), F.asc("capex_estimado")],
    )


def value_waterfall(table: DataFrame) -> DataFrame:
    """Value chain summed per lever in the base scenario, with the running contribution."""
    from pyspark.sql import Window

    sums = {
        "ahorro_bruto": "gross_technical_value",
        "ahorro_neto": "net_captured_value",
        "ahorro_ajustado_riesgo": "downside_adjusted_annual",
        "var_95": "value_at_risk_95",
        "valor_descontado": "discounted_value",
        "valor_downside": "downside_adjusted_value",
        "coste_retraso_12m": "cost_of_delay_12m",
    }
    grouped = base_scenario(table).groupBy("escenario_label").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # One row per lever (seven at most), so the single-partition window is bounded.
    running = Window.orderBy(F.desc_nulls_last("ahorro_ajustado_riesgo"), "escenario_label").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return grouped.withColumn("acumulado", F.sum("ahorro_ajustado_riesgo").over(running))


def macro_sensitivities(spark: SparkSession) -> DataFrame:
    fields = list(Macro.__dataclass_fields__)
    rows = [(k, *[getattr(v, f) for f in fields]) for k, v in MACROS.items()]
    return literal_table(spark, rows, "macro_scenario string, " + ", ".join(f"{f} double" for f in fields))


def lever_library(spark: SparkSession) -> DataFrame:
    fields = list(Lever.__dataclass_fields__)
    rows = [(k, *[getattr(v, f) for f in fields]) for k, v in LEVERS.items()]
    kinds = ["string"] + ["double"] * 5 + ["int"] * 3
    return literal_table(
        spark, rows, "scenario_key string, " + ", ".join(f"{f} {t}" for f, t in zip(fields, kinds))
    )


# Documented assumptions of the financial figures.
ASSUMPTIONS = (
    ("base_carbon_cost", "Coste de carbono de screening/pre-feasibility", CARBON_COST_EUR_TON, "EUR/tCO2e", "proxy"),
    ("discount_rate", "Tasa de descuento para discounted value de screening", finance.DISCOUNT_RATE, "ratio", "proxy"),
    ("analysis_horizon_years", "Horizonte de evaluación financiera", finance.HORIZON_MONTHS / 12.0, "years", "defendible"),
)
LOGIC_AUDIT = (
    ("Ahorro energético anual", "defendible", "screening/pre-feasibility", "usable_with_caveat"),
    ("Gross technical value", "defendible", "screening/pre-feasibility", "usable_with_caveat"),
    ("Discounted value / downside-adjusted value", "proxy útil", "pre-feasibility", "not_final_business_case"),
    ("Screening IRR", "proxy útil", "screening", "not_formal_irr"),
    ("Formal IRR candidate", "débil", "pre-feasibility", "candidate_only"),
    ("Screening VaR / robust risk candidate", "débil", "screening", "not_committee_grade"),
    ("Cost of delay", "proxy útil", "pre-feasibility", "usable_with_caveat"),
    ("Business case final", "no apta para comité", "out_of_scope", "no"),
)


def assumptions(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, ASSUMPTIONS, "assumption_id string, description string, value double, unit string, maturity string"
    )


def logic_audit(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark, LOGIC_AUDIT, "component string, classification string, maturity string, committee_suitability string"
    )
