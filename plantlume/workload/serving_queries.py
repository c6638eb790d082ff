"""Sector views, serving extracts, and single operators on the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import (
    finite_or_zero,
    fixed,
    grouped_number,
    lenient_timestamp,
    lookup,
    pattern_hits,
    period,
    sequence_label,
)
from ..operators.joins import left_on, near_value_pairs, reconcile, with_group_stats
from ..operators.ordering import exact_quantiles, most_common, top_per_group, with_position, with_running_sum
from ..operators.rolling import Trailing, with_trailing
from ..operators.tables import keep_matching_or_all, latest_period, missing_from, pivot_mean, stack_rows
from ..plans import portfolio, quality, sector, serving
from ..sources.writers import sample_head
from .catalog import define, final, query
from .layers import Layers
from .roles import table

# --- sector profiles: one per region --------------------------------------------------------
_FAMILY = "CASE n_nationkey % 4 WHEN 0 THEN 'Laminacion' WHEN 1 THEN 'TratamientoTermico' WHEN 2 THEN 'Acabado' ELSE 'InspeccionFinal' END"
_FIXED = {
    "categoria_iniciativa": ("EficienciaEnergetica", "Confiabilidad", "OptimizacionProceso"),
    "tipo_iniciativa": ("QuickWinOperativo", "MantenimientoPredictivo", "ControlAvanzado", "CAPEXTransformacional"),
    "fuente_energia": ("Electricidad",),
}


def _profiles(spark, sf):
    """Profile documents built from regions, nations and customers."""
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    family = nation.groupBy("n_regionkey", F.expr(_FAMILY).alias("f")).agg(
        F.avg(1.0 + F.col("n_nationkey") / 100.0).alias("m")
    )
    target = F.concat_ws("-", "f", "n_regionkey")

    def as_map(key, value):
        return F.map_from_entries(F.collect_list(F.struct(key, value)))

    families = family.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(
        as_map(F.col("f"), target).alias("fam"),
        as_map(F.col("f"), F.col("m")).alias("sec"),
        as_map(F.col("f"), F.col("m") - 1.2).alias("oee"),
        as_map(
            F.col("f"),
            F.struct(
                target.alias("sector_process_group"),
                F.lit("energia").alias("benchmark_priority"),
                F.array(F.lit("sec"), F.lit("oee_synthetic")).alias("kpi_focus"),
                F.lit("riesgo").alias("operational_risk_focus"),
            ),
        ).alias("defs"),
    )
    segments = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_regionkey").alias("r_regionkey"), "c_mktsegment")
        .distinct()
        .groupBy("r_regionkey")
        .agg(as_map(F.col("c_mktsegment"), F.concat_ws("-", F.lower("c_mktsegment"), "r_regionkey")).alias("seg"))
    )
    key = F.col("r_regionkey")

    def fixed_map(values):
        return F.create_map(*[x for v in values for x in (F.lit(v), F.concat_ws("-", F.lit(v), key.cast("string")))])

    number = key.cast("double")
    return region.join(families, "r_regionkey").join(segments, "r_regionkey").select(
        F.col("r_name").alias("profile_id"),
        F.concat(F.col("r_name"), F.lit(" profile")).alias("profile_name"),
        F.concat(F.lit("1.0."), key.cast("string")).alias("profile_version"),
        F.when(key == 3, "0.9.0").otherwise("1.0.0").alias("common_core_version_compat"),
        F.create_map(
            F.lit("familia_proceso"), F.col("fam"), F.lit("tipo_equipo"), F.col("seg"),
            *[x for d, vs in _FIXED.items() for x in (F.lit(d), fixed_map(vs))],
        ).alias("taxonomy_mapping"),
        F.col("defs").alias("process_family_definitions"),
        F.create_map(
            F.lit("sec_multiplier_by_family"), F.col("sec"), F.lit("emissions_multiplier_by_family"), F.col("sec"),
            F.lit("oee_shift_by_family"), F.col("oee"),
        ).alias("benchmark_set"),
        F.when(key != 4, F.lit("{}")).alias("energy_logic"),
        F.struct(
            F.create_map(F.lit("Electricidad"), 1.0 + number / 10.0).alias("multiplier_by_source"),
            F.when(key > 1, 85.0 + number).alias("carbon_cost_eur_ton_base"),
        ).alias("emission_factors"),
        F.lit("{}").alias("maintenance_logic"),
        F.struct(
            F.array(F.lit("ControlAvanzado"), F.lit("QuickWinOperativo")).alias("preferred_sequence"),
            F.array(F.lit("Confiabilidad")).alias("mandatory_categories"),
        ).alias("initiative_library"),
        F.concat(F.lit('{"weight_sec_gap": 0.26, "equipment_type_multiplier": {"BUILDING": '), (1.0 + number / 4.0).cast("string"), F.lit("}}")).alias("criticality_logic"),
        F.create_map(F.lit("capex_budget_default_eur"), 1e7 + number).alias("constraints_by_sector"),
        F.create_map(F.lit("energy_price_beta"), 1.0 + number / 20.0).alias("scenario_sensitivities"),
        F.struct(F.create_map(F.lit("sec"), number / 10.0, F.lit("oee"), 1.0 - number / 10.0).alias("kpi_weights")).alias("kpi_priority"),
        F.array(
            F.struct(F.lit("sec").alias("metric_name"), F.col("r_name").alias("caveat"), F.lit("segmentar").alias("misuse_prevention"))
        ).alias("metric_caveats"),
        F.array(F.lit("ahorro como margen"), F.concat(F.lit("comparar "), F.col("r_name"))).alias("misuse_risks"),
    )


define("profile", "SELECT r_name AS sector_profile_id, r_regionkey AS rk FROM region")
define(
    "profile_family",
    f"SELECT p.sector_profile_id, p.rk, {_FAMILY} AS familia_proceso, avg(1 + n_nationkey / 100) AS m"
    " FROM nation JOIN profile p ON p.rk = n_regionkey GROUP BY ALL",
)
define(
    "profile_taxonomy",
    "SELECT sector_profile_id, 'familia_proceso' AS domain, familia_proceso AS source_value, familia_proceso || '-' || rk AS target_value"
    " FROM profile_family UNION ALL SELECT DISTINCT p.sector_profile_id, 'tipo_equipo', c_mktsegment, lower(c_mktsegment) || '-' || p.rk"
    " FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN profile p ON p.rk = n_regionkey"
    " UNION ALL SELECT p.sector_profile_id, t.d, t.v, t.v || '-' || p.rk FROM profile p CROSS JOIN (VALUES "
    + ", ".join(f"('{d}', '{v}')" for d, vs in _FIXED.items() for v in vs) + ") t(d, v)",
)


@query("sector_taxonomy", "SELECT sector_profile_id, domain, source_value, target_value FROM profile_taxonomy")
def sector_taxonomy(spark, sf):
    return sector.taxonomy(_profiles(spark, sf))


@query(
    "sector_profile_errors",
    "SELECT sector_profile_id, 'common_core_version_mismatch' AS error FROM profile WHERE rk = 3"
    " UNION ALL SELECT sector_profile_id, 'missing_key=energy_logic' FROM profile WHERE rk = 4",
)
def sector_profile_errors(spark, sf):
    return sector.validation_errors(_profiles(spark, sf), "1.0.0")


def _word(value: str, domain: str, alias: str) -> str:
    return (
        f" LEFT JOIN profile_taxonomy {alias} ON {alias}.sector_profile_id = p.sector_profile_id AND {alias}.domain = '{domain}'"
        f" AND {alias}.source_value = {value}"
    )


@query(
    "sector_asset_hierarchy",
    "SELECT p.sector_profile_id, pl.planta_id, pl.nombre_planta, pl.tipo_planta, pl.region, q.linea_id, l.nombre_linea,"
    " l.familia_proceso, coalesce(a.target_value, l.familia_proceso) AS sector_process_family, q.equipo_id, q.tipo_equipo,"
    " coalesce(b.target_value, q.tipo_equipo) AS sector_equipment_type, q.subsistema FROM equipos q LEFT JOIN lineas_proceso l"
    " USING (linea_id) LEFT JOIN plantas pl ON pl.planta_id = l.planta_id CROSS JOIN profile p"
    + _word("l.familia_proceso", "familia_proceso", "a") + _word("q.tipo_equipo", "tipo_equipo", "b"),
)
def sector_asset_hierarchy(spark, sf):
    layers = Layers(spark, sf)
    return sector.asset_hierarchy(
        _profiles(spark, sf), layers.role("plantas"), layers.role("lineas_proceso"), layers.role("equipos")
    )


@query(
    "sector_process_families",
    "SELECT sector_profile_id, familia_proceso, familia_proceso || '-' || rk AS sector_process_group, 'energia' AS benchmark_priority,"
    " 'sec|oee_synthetic' AS kpi_focus, 'riesgo' AS operational_risk_focus FROM profile_family",
)
def sector_process_families(spark, sf):
    return sector.process_families(_profiles(spark, sf))


@query(
    "sector_benchmark",
    final(
        "(SELECT f.sector_profile_id, b.periodo, b.familia_proceso, b.sec_referencia, f.m AS sec_multiplier, b.sec_referencia * f.m"
        " AS sec_referencia_sector, b.oee_referencia / 100 AS oee_referencia, f.m - 1.2 AS oee_shift,"
        " greatest(0, least(1::DOUBLE, b.oee_referencia / 100 + f.m - 1.2)) AS oee_referencia_sector, b.disponibilidad_referencia,"
        " 0.0 AS availability_shift, greatest(0, least(1::DOUBLE, b.disponibilidad_referencia)) AS disponibilidad_referencia_sector,"
        " b.emisiones_referencia, f.m AS emissions_multiplier, b.emisiones_referencia * f.m AS emisiones_referencia_sector"
        " FROM benchmark_externo_proxy b JOIN profile_family f USING (familia_proceso)"
        " WHERE b.periodo = (SELECT max(periodo) FROM benchmark_externo_proxy))",
        "sector_profile_id periodo familia_proceso sec_referencia~ sec_multiplier~ sec_referencia_sector~ oee_referencia~ oee_shift~"
        " oee_referencia_sector~ disponibilidad_referencia~ availability_shift~ disponibilidad_referencia_sector~"
        " emisiones_referencia~ emissions_multiplier~ emisiones_referencia_sector~",
    ),
)
def sector_benchmark(spark, sf):
    return sector.sector_benchmark(_profiles(spark, sf), Layers(spark, sf).role("benchmark_externo_proxy"))


@query(
    "sector_emission_factors",
    final(
        "(SELECT p.sector_profile_id, fuente_energia, median(factor_emision_proxy) AS factor_emision_base,"
        " CASE WHEN fuente_energia = 'Electricidad' THEN 1 + rk / 10 ELSE 1 END AS factor_multiplier,"
        " median(factor_emision_proxy) * CASE WHEN fuente_energia = 'Electricidad' THEN 1 + rk / 10 ELSE 1 END AS factor_emision_sector,"
        " CASE WHEN rk > 1 THEN 85 + rk ELSE 85 END AS carbon_cost_eur_ton FROM emission_hours CROSS JOIN profile p GROUP BY p.sector_profile_id, rk, fuente_energia)",
        "sector_profile_id fuente_energia factor_emision_base~ factor_multiplier~ factor_emision_sector~ carbon_cost_eur_ton~",
    ),
)
def sector_emission_factors(spark, sf):
    return sector.sector_emission_factors(_profiles(spark, sf), Layers(spark, sf).emissions())


@query(
    "sector_initiatives",
    "SELECT p.sector_profile_id, i.iniciativa_id, i.categoria_iniciativa, coalesce(a.target_value, i.categoria_iniciativa) AS categoria_sectorial,"
    " i.tipo_iniciativa, coalesce(b.target_value, i.tipo_iniciativa) AS tipo_sectorial, i.quick_win_flag,"
    " (i.categoria_iniciativa = 'Confiabilidad')::INT AS mandatory_by_profile,"
    " CASE i.tipo_iniciativa WHEN 'ControlAvanzado' THEN 1 WHEN 'QuickWinOperativo' THEN 2 ELSE 99 END AS recommended_wave_index"
    " FROM iniciativas_mejora i CROSS JOIN profile p" + _word("i.categoria_iniciativa", "categoria_iniciativa", "a")
    + _word("i.tipo_iniciativa", "tipo_iniciativa", "b"),
)
def sector_initiatives(spark, sf):
    return sector.sector_initiatives(_profiles(spark, sf), Layers(spark, sf).role("iniciativas_mejora"))


@query(
    "sector_parameters",
    final(
        "(SELECT sector_profile_id, 'constraint' AS kind, 'capex_budget_default_eur' AS name, 1e7 + rk AS value FROM profile UNION ALL"
        " SELECT sector_profile_id, 'sensitivity', 'energy_price_beta', 1 + rk / 20 FROM profile UNION ALL"
        " SELECT sector_profile_id, 'kpi_weight', 'sec', rk / 10 FROM profile UNION ALL"
        " SELECT sector_profile_id, 'kpi_weight', 'oee', 1 - rk / 10 FROM profile UNION ALL"
        " SELECT sector_profile_id, 'criticality:weights', 'weight_sec_gap', 0.26 FROM profile UNION ALL"
        " SELECT sector_profile_id, 'criticality:equipment_type_multiplier', 'BUILDING', 1 + rk / 4 FROM profile)",
        "sector_profile_id kind name value~",
    ),
)
def sector_parameters(spark, sf):
    profiles = _profiles(spark, sf)
    logic = sector.criticality_logic(profiles).select(
        "sector_profile_id", F.concat(F.lit("criticality:"), "logic_group").alias("kind"),
        F.col("logic_key").alias("name"), F.col("logic_value").alias("value"),
    )
    return sector.profile_parameters(profiles).unionByName(logic)


@query(
    "sector_caveats_and_risks",
    "SELECT sector_profile_id, 'caveat' AS kind, 'sec' AS name, sector_profile_id AS text FROM profile UNION ALL"
    " SELECT sector_profile_id, 'risk', upper(sector_profile_id) || '_R01', 'ahorro como margen' FROM profile UNION ALL"
    " SELECT sector_profile_id, 'risk', upper(sector_profile_id) || '_R02', 'comparar ' || sector_profile_id FROM profile",
)
def sector_caveats_and_risks(spark, sf):
    profiles = _profiles(spark, sf)
    caveats = sector.metric_caveats(profiles).select(
        "sector_profile_id", F.lit("caveat").alias("kind"), F.col("metric_name").alias("name"), F.col("caveat").alias("text")
    )
    risks = sector.misuse_risks(profiles).select(
        "sector_profile_id", F.lit("risk").alias("kind"), F.col("risk_id").alias("name"), F.col("risk").alias("text")
    )
    return caveats.unionByName(risks)


@query(
    "sector_line_days",
    final(
        "(SELECT f.sector_profile_id, s.fecha, s.planta_id, s.linea_id, s.familia_proceso, s.familia_proceso || '-' || f.rk AS sector_process_family,"
        " s.sec, s.sec * f.m AS sec_sector_adjusted, s.sec_vs_benchmark, s.sec * f.m - s.sec_vs_benchmark AS sector_benchmark_gap,"
        " s.oee_synthetic, s.availability_rate, s.loss_value_proxy, s.emissions_per_unit, s.emissions_per_unit * f.m"
        " AS emissions_per_unit_sector_adjusted FROM line_scored s JOIN profile_family f USING (familia_proceso))",
        "sector_profile_id fecha planta_id linea_id familia_proceso sector_process_family sec~ sec_sector_adjusted~ sec_vs_benchmark~"
        " sector_benchmark_gap~ oee_synthetic~ availability_rate~ loss_value_proxy~ emissions_per_unit~ emissions_per_unit_sector_adjusted~",
        3,
    ),
    digits=3,
)
def sector_line_days(spark, sf):
    return sector.sector_line_days(_profiles(spark, sf), Layers(spark, sf).stored("scored_line_days"))


@query(
    "sector_investments",
    final(
        "(SELECT p.sector_profile_id, i.iniciativa_id, i.planta_id, i.linea_id, i.categoria_iniciativa,"
        " coalesce(a.target_value, i.categoria_iniciativa) AS sector_category, i.tipo_iniciativa,"
        " coalesce(b.target_value, i.tipo_iniciativa) AS sector_type, i.quick_win_flag, i.improvement_priority_index, i.decision_rule,"
        " i.portfolio_wave, i.selected_portfolio_flag, i.annual_saving_proxy, i.downside_adjusted_value,"
        " i.downside_adjusted_value * (1 + p.rk / 20) AS downside_adjusted_value_sector, i.capex_estimado, 1e7 + p.rk AS sector_capex_budget,"
        " 0.0 AS sector_opex_budget FROM decided i CROSS JOIN profile p" + _word("i.categoria_iniciativa", "categoria_iniciativa", "a")
        + _word("i.tipo_iniciativa", "tipo_iniciativa", "b") + ")",
        "sector_profile_id iniciativa_id planta_id linea_id categoria_iniciativa sector_category tipo_iniciativa sector_type quick_win_flag"
        " improvement_priority_index~ decision_rule portfolio_wave selected_portfolio_flag annual_saving_proxy~ downside_adjusted_value~"
        " downside_adjusted_value_sector~ capex_estimado~ sector_capex_budget~ sector_opex_budget~",
        3,
    ),
    digits=3,
)
def sector_investments(spark, sf):
    return sector.sector_investments(_profiles(spark, sf), Layers(spark, sf).stored("prioritization"))


_OBSERVED = {
    "familia_proceso": ("lineas_proceso", "familia_proceso"),
    "tipo_equipo": ("equipos", "tipo_equipo"),
    "categoria_iniciativa": ("iniciativas_mejora", "categoria_iniciativa"),
    "tipo_iniciativa": ("iniciativas_mejora", "tipo_iniciativa"),
    "fuente_energia": ("consumos_energia_horarios", "fuente_energia"),
}


@query(
    "sector_mapping_coverage",
    final(
        "(SELECT p.sector_profile_id, o.domain, count(*) AS observed_values, count(t.source_value) AS mapped_values,"
        " 100 * count(t.source_value) / count(*) AS mapping_coverage_pct FROM ("
        + " UNION ALL ".join(f"SELECT DISTINCT '{d}' AS domain, {c} AS v FROM {t}" for d, (t, c) in _OBSERVED.items())
        + ") o CROSS JOIN profile p LEFT JOIN profile_taxonomy t ON t.sector_profile_id = p.sector_profile_id"
        " AND t.domain = o.domain AND t.source_value = o.v GROUP BY ALL)",
        "sector_profile_id domain observed_values mapped_values mapping_coverage_pct~",
    ),
)
def sector_mapping_coverage(spark, sf):
    layers = Layers(spark, sf)
    return sector.mapping_coverage(_profiles(spark, sf), {d: (layers.role(t), c) for d, (t, c) in _OBSERVED.items()})


@query(
    "sector_registry_and_evidence",
    "SELECT p.sector_profile_id, sector_profile_id || ' profile' AS profile_name, '1.0.' || rk AS profile_version, 2 AS kpi_priority_count,"
    " 1 AS metric_caveats_count, 2 AS misuse_risks_count, (SELECT count(*) FROM profile_taxonomy t WHERE t.sector_profile_id = p.sector_profile_id)"
    " AS taxonomy, (SELECT count(*) FROM iniciativas_mejora) AS initiatives FROM profile p",
)
def sector_registry_and_evidence(spark, sf):
    profiles = _profiles(spark, sf)
    rows = sector.evidence(
        {
            "taxonomy": sector.taxonomy(profiles),
            "initiatives": sector.sector_initiatives(profiles, Layers(spark, sf).role("iniciativas_mejora")),
        }
    )
    return sector.profile_metadata(profiles, "1.0.0").join(rows, "sector_profile_id").drop(
        "common_core_version_compat", "common_core_version_active"
    )


# --- serving extracts -----------------------------------------------------------------------
@query(
    "monthly_line_trends",
    final(
        "(SELECT strftime(fecha, '%Y-%m') AS periodo, linea_id, avg(sec) AS sec, avg(oee_synthetic) AS oee FROM line_scored"
        " WHERE linea_id IN (SELECT linea_id FROM line_criticality ORDER BY line_criticality_score DESC NULLS LAST, linea_id LIMIT 5)"
        " GROUP BY ALL)",
        "periodo linea_id sec~ oee~",
    ),
)
def monthly_line_trends(spark, sf):
    layers = Layers(spark, sf)
    return serving.monthly_line_trends(layers.stored("scored_line_days"), serving.top_line_ids(layers.stored("line_scores")))


@query(
    "energy_cost_by_line",
    final(
        "(SELECT linea_id, sum(cost_energy_per_unit * production_volume) AS coste_energia_total, avg(sec) AS sec_medio FROM line_scored"
        " GROUP BY ALL ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10)",
        "linea_id coste_energia_total~ sec_medio~",
        2,
    ),
    digits=2,
)
def energy_cost_by_line(spark, sf):
    return serving.energy_cost_by_line(Layers(spark, sf).stored("scored_line_days"))


@query(
    "top_causes",
    final(
        "(SELECT causa_parada, sum(loss_root_cause_score) AS loss_root_cause_score FROM cause_month GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 8)",
        "causa_parada loss_root_cause_score~", 3,
    ),
    digits=3,
)
def top_causes(spark, sf):
    return serving.top_causes(Layers(spark, sf).cause_months())


define(
    "shift_mean",
    "SELECT planta_id, linea_id, turno, avg(sec_shift) AS sec_shift, avg(shift_variance_score) AS shift_variance_score,"
    " avg(scrap_pct) AS scrap_pct, avg(stop_minutes) AS stop_minutes FROM shift_feature GROUP BY ALL",
)


@query(
    "worst_shifts",
    final(
        "(SELECT *, linea_id || ' - ' || turno AS label FROM shift_mean ORDER BY shift_variance_score DESC NULLS LAST, linea_id || ' - ' || turno LIMIT 10)",
        "planta_id linea_id turno label sec_shift~ shift_variance_score~ scrap_pct~ stop_minutes~",
    ),
)
def worst_shifts(spark, sf):
    from ..plans.diagnostics import shift_comparison

    return serving.worst_shifts(shift_comparison(Layers(spark, sf).stored("shift_features")))


@query(
    "scenario_totals",
    final(
        "(SELECT macro_scenario, sum(discounted_value) AS discounted_value, sum(downside_adjusted_value) AS downside_adjusted_value"
        " FROM scenario_cube GROUP BY ALL)",
        "macro_scenario discounted_value~ downside_adjusted_value~", 0,
    ),
    digits=0,
)
def scenario_totals(spark, sf):
    return serving.scenario_totals(Layers(spark, sf).stored("scenario_table"))


@query("wave_counts", "SELECT portfolio_wave, count(*) AS n_iniciativas FROM decided WHERE selected_portfolio_flag = 1 GROUP BY ALL")
def wave_counts(spark, sf):
    return serving.wave_counts(Layers(spark, sf).stored("prioritization"))


@query(
    "priority_bubbles",
    final(
        "(SELECT iniciativa_id, initiative_class, round_even(implementation_feasibility_score, 3) AS implementation_feasibility_score,"
        " round_even(improvement_priority_index, 3) AS improvement_priority_index, round_even(annual_saving_proxy, 3) AS annual_saving_proxy,"
        " round_even(greatest(4, least(16, greatest(annual_saving_proxy, 100000) / 120000)), 2) AS bubble_r FROM decided)",
        "iniciativa_id implementation_feasibility_score~ improvement_priority_index~ annual_saving_proxy~ initiative_class bubble_r~",
    ),
)
def priority_bubbles(spark, sf):
    return serving.priority_bubbles(Layers(spark, sf).stored("prioritization"))


@query(
    "investment_table",
    final(
        "(SELECT iniciativa_id, linea_id, initiative_class, round_even(annual_saving_proxy, 3) AS annual_saving_proxy,"
        " round_even(npv_risk_adjusted, 3) AS npv_risk_adjusted, round_even(payback_months, 3) AS payback_months,"
        " round_even(improvement_priority_index, 3) AS improvement_priority_index, initiative_tier, portfolio_wave, decision_rule,"
        " selected_portfolio_flag FROM decided)",
        "iniciativa_id linea_id initiative_class annual_saving_proxy~ npv_risk_adjusted~ payback_months~ improvement_priority_index~"
        " initiative_tier portfolio_wave decision_rule selected_portfolio_flag",
    ),
)
def investment_table(spark, sf):
    return serving.investment_table(Layers(spark, sf).stored("prioritization"))


@query(
    "initiative_type_split",
    final(
        "(SELECT CASE WHEN quick_win_flag = 1 THEN 'QuickWin' WHEN capex_estimado >= 700000 THEN 'CAPEX' ELSE 'Intermedio' END AS tipo_macro,"
        " avg(improvement_priority_index) AS score, sum(annual_saving_proxy) AS ahorro FROM decided GROUP BY ALL)",
        "tipo_macro score~ ahorro~", 2,
    ),
    digits=2,
)
def initiative_type_split(spark, sf):
    return serving.type_split(Layers(spark, sf).stored("prioritization"))


@query(
    "deviation_by_family",
    final(
        "(SELECT l.familia_proceso, avg(abs(d.desviacion_pct)) AS desviacion_abs FROM desvios_proceso d LEFT JOIN lineas_proceso l USING (linea_id) GROUP BY ALL)",
        "familia_proceso desviacion_abs~",
    ),
)
def deviation_by_family(spark, sf):
    layers = Layers(spark, sf)
    return serving.deviation_by_family(layers.role("desvios_proceso"), layers.role("lineas_proceso"))


@query("stops_by_cause", "SELECT causa_parada, count(*) AS n_paradas FROM paradas GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 12")
def stops_by_cause(spark, sf):
    return serving.stops_by_cause(Layers(spark, sf).role("paradas"))


@query(
    "internal_external_benchmark",
    final(
        "(SELECT a.*, b.sec_externo, b.oee_externo FROM (SELECT familia_proceso, avg(sec) AS sec_interno, avg(oee_synthetic) AS oee_interno"
        " FROM line_scored GROUP BY ALL) a LEFT JOIN (SELECT familia_proceso, avg(sec_referencia) AS sec_externo, avg(oee_referencia) AS oee_externo"
        " FROM benchmark_externo_proxy GROUP BY ALL) b USING (familia_proceso))",
        "familia_proceso sec_interno~ oee_interno~ sec_externo~ oee_externo~",
    ),
)
def internal_external_benchmark(spark, sf):
    layers = Layers(spark, sf)
    return serving.internal_external_benchmark(layers.stored("scored_line_days"), layers.role("benchmark_externo_proxy"))


@query(
    "shift_profile",
    final(
        "(SELECT turno, avg(sec_shift) AS sec_shift, avg(scrap_pct) AS scrap, avg(shift_variance_score) AS variance FROM shift_feature GROUP BY ALL)",
        "turno sec_shift~ scrap~ variance~",
    ),
)
def shift_profile(spark, sf):
    return serving.shift_profile(Layers(spark, sf).stored("shift_features"))


@query(
    "line_cost_points",
    final(
        "(SELECT linea_id, avg(sec) AS sec, avg(cost_energy_per_unit) AS coste, avg(emissions_per_unit) AS emisiones FROM line_scored GROUP BY ALL)",
        "linea_id sec~ coste~ emisiones~",
    ),
)
def line_cost_points(spark, sf):
    return serving.line_cost_points(Layers(spark, sf).stored("scored_line_days"))


@query(
    "equipment_heatmap",
    final(
        "(SELECT linea_id, equipo_id, avg(equipment_energy_anomaly_score) AS score FROM equipment_scored GROUP BY ALL)",
        "linea_id equipo_id score~",
    ),
)
def equipment_heatmap(spark, sf):
    return serving.equipment_heatmap(Layers(spark, sf).stored("equipment_scores"))


@query(
    "ranking_sensitivity_of_leaders",
    final(
        "(SELECT iniciativa_id, avg(ranking) FILTER (WHERE scenario = 'energia_alta') AS energia_alta,"
        " avg(ranking) FILTER (WHERE scenario = 'operacion_critica') AS operacion_critica FROM sensitivity_row"
        " WHERE iniciativa_id IN (SELECT iniciativa_id FROM decided ORDER BY portfolio_objective_score DESC,"
        " improvement_priority_index DESC, iniciativa_id LIMIT 10) GROUP BY ALL)",
        "iniciativa_id energia_alta~ operacion_critica~",
    ),
)
def ranking_sensitivity_of_leaders(spark, sf):
    layers = Layers(spark, sf)
    alternatives = [s for s in portfolio.WEIGHT_SCENARIOS if s != "base"]
    return serving.ranking_sensitivity(layers.stored("weight_sensitivity"), layers.stored("prioritization"), alternatives)


@query(
    "headline_figures",
    final(
        "(SELECT l.*, q.quick_win_top_mean, c.capex_top_mean, s.* FROM (SELECT sum(loss_value_proxy) AS total_loss_proxy,"
        " avg(sec_benchmark_gap) AS avg_sec_gap, avg(oee_synthetic) AS avg_oee FROM line_criticality) l,"
        " (SELECT avg(improvement_priority_index) AS quick_win_top_mean FROM (SELECT * FROM decided WHERE quick_win_flag = 1"
        " ORDER BY improvement_priority_index DESC, iniciativa_id LIMIT 5)) q,"
        " (SELECT avg(improvement_priority_index) AS capex_top_mean FROM (SELECT * FROM decided WHERE capex_estimado >= 700000"
        " ORDER BY improvement_priority_index DESC, iniciativa_id LIMIT 5)) c,"
        " (SELECT count(*) FILTER (WHERE financial_maturity_stage = 'screening') AS screening_count,"
        " count(*) FILTER (WHERE financial_maturity_stage = 'pre_feasibility') AS pre_feasibility_count,"
        " count(*) FILTER (WHERE financial_maturity_stage = 'business_case_candidate') AS business_case_count FROM decided) s)",
        "total_loss_proxy~ avg_sec_gap~ avg_oee~ quick_win_top_mean~ capex_top_mean~ screening_count pre_feasibility_count business_case_count", 2,
    ),
    digits=2,
)
def headline_figures(spark, sf):
    layers = Layers(spark, sf)
    return serving.headline_figures(layers.stored("line_scores"), layers.stored("prioritization"))


@query(
    "prioritised_findings",
    "SELECT 1 AS prioridad, 'La línea ' || linea_prioritaria || ' concentra la mayor criticidad integrada.' AS hallazgo,"
    " 'Riesgo alto de pérdida económica y degradación de continuidad.' AS impacto FROM decision_row UNION ALL"
    " SELECT 2, 'El equipo ' || equipo_prioritario || ' lidera el riesgo de anomalía energética.',"
    " 'Penaliza coste energético y estabilidad operacional.' FROM decision_row UNION ALL"
    " SELECT 3, 'La causa raíz dominante es ' || causa_parada || '.', 'Explica la mayor fracción de pérdida operativa agregada.' FROM ("
    " SELECT causa_parada FROM cause_month GROUP BY ALL ORDER BY sum(loss_root_cause_score) DESC, 1 LIMIT 1) UNION ALL"
    " SELECT 4, 'El turno ' || turno || ' en ' || linea_id || ' muestra mayor varianza operativa.',"
    " 'Necesita estandarización operativa y control de rutina.' FROM (SELECT * FROM shift_mean"
    " ORDER BY shift_variance_score DESC NULLS LAST, linea_id || ' - ' || turno LIMIT 1)",
)
def prioritised_findings(spark, sf):
    from ..plans.diagnostics import shift_comparison

    layers = Layers(spark, sf)
    decision = quality.decision_snapshot(
        layers.stored("line_scores"), layers.stored("equipment_scores"), layers.stored("prioritization")
    )
    return serving.findings(decision, layers.cause_months(), shift_comparison(layers.stored("shift_features")))


define(
    "insight_figure",
    "SELECT (SELECT sum(capex_estimado) FROM decided WHERE selected_portfolio_flag = 1) / 4e7 AS use,"
    " (SELECT avg(quick_win_flag) FROM decided WHERE selected_portfolio_flag = 1) AS quick,"
    " (SELECT sum(cost_of_delay_12m) / sum(annual_saving_proxy) FROM decided) AS delay",
)


@query(
    "conditional_insights",
    "SELECT row_number() OVER (ORDER BY n)::INT AS orden, title, action FROM (SELECT * FROM ("
    " SELECT 2 AS n, delay >= 0.7 AS met, 'Riesgo elevado por inacción' AS title,"
    " 'Acelerar quick wins y adelantar iniciativas de mayor contribución neta.' AS action FROM insight_figure UNION ALL"
    " SELECT 3, use >= 0.9, 'Tensión de presupuesto CAPEX', 'Optimizar secuenciación por olas y preparar opciones de descoping.' FROM insight_figure"
    " UNION ALL SELECT 4, use <= 0.7, 'Capacidad de capturar valor adicional',"
    " 'Ejecutar escenario de relajación de budget/capacidad para maximizar valor capturable.' FROM insight_figure UNION ALL"
    " SELECT 5, quick < 0.25, 'Baja proporción de quick wins',"
    " 'Rebalancear cartera para asegurar captura temprana de valor y tracción operativa.' FROM insight_figure)"
    " WHERE met ORDER BY n LIMIT 2)",
)
def conditional_insights(spark, sf):
    done = Layers(spark, sf).stored("prioritization")
    chosen = F.col("selected_portfolio_flag") == 1
    figures = done.agg(
        F.lit("committee-candidate|publish").alias("validation_state"),
        F.sum("cost_of_delay_12m").alias("cost_of_delay_12m"),
        F.sum("annual_saving_proxy").alias("annual_saving"),
        F.sum(F.when(chosen, F.col("capex_estimado"))).alias("capex_selected"),
        F.lit(4e7).alias("capex_budget"),
        F.count_if(chosen).alias("selected_count"),
        F.count_if(chosen & (F.col("quick_win_flag") == 1)).alias("quick_wins_selected"),
        F.max_by("iniciativa_id", F.when(~chosen, F.col("annual_saving_proxy"))).alias("top_backlog"),
    )
    return serving.conditional_insights(figures)


def _json_sql(fields: str) -> str:
    """JSON text of a row: ``name~`` a number with two digits, ``name#`` a whole number, ``name`` a text."""
    cells = []
    for f in fields.split():
        c = f.rstrip("~#")
        value = {"~": f"{c}::DECIMAL(32,6)::DECIMAL(28,2)::VARCHAR", "#": f"{c}::VARCHAR"}.get(f[-1], f"'\"' || {c} || '\"'")
        cells.append(f"'\"{c}\":' || coalesce({value}, 'null')")
    return "'{' || " + " || ',' || ".join(cells) + " || '}'"


def _list_sql(relation: str, fields: str) -> str:
    row = _json_sql(fields)
    first = fields.split()[0].rstrip("~#")
    return f"(SELECT '[' || coalesce(string_agg({row}, ',' ORDER BY {first}), '') || ']' FROM {relation})"


_SNAPSHOT = (
    "production_volume~ oee_synthetic~ sec~ loss_value_proxy~ line_criticality_high# line_criticality_high_threshold~ annual_saving_proxy~"
    " portfolio_npv_risk_adjusted~ portfolio_selected# gross_technical_value_all~ net_captured_value_all~ downside_adjusted_value_all~"
    " cost_of_delay_12m_all~ screening_var_95_npv_all~ contextual_score_count# score_scaling_method score_scale_version"
    " financial_readiness_label"
)


@query(
    "serving_document",
    "SELECT '{\"kpi\":' || (SELECT " + _json_sql(_SNAPSHOT) + " FROM snapshot_row) || ',\"energia_por_linea\":' || "
    + _list_sql(
        "(SELECT linea_id, sum(cost_energy_per_unit * production_volume) AS coste_energia_total, avg(sec) AS sec_medio FROM line_scored"
        " GROUP BY ALL ORDER BY 2 DESC NULLS LAST, 1 LIMIT 10)",
        "linea_id coste_energia_total~ sec_medio~",
    )
    + " || ',\"causas\":' || "
    + _list_sql(
        "(SELECT causa_parada, sum(loss_root_cause_score) AS loss_root_cause_score FROM cause_month GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 8)",
        "causa_parada loss_root_cause_score~",
    )
    + " || ',\"olas\":' || "
    + _list_sql(
        "(SELECT portfolio_wave, count(*) AS n_iniciativas FROM decided WHERE selected_portfolio_flag = 1 GROUP BY ALL)",
        "portfolio_wave n_iniciativas#",
    )
    + " || '}' AS documento",
)
def serving_document(spark, sf):
    layers = Layers(spark, sf)
    done = layers.stored("prioritization")
    snapshot = quality.kpi_snapshot(layers.stored("scored_line_days"), layers.stored("line_scores"), done)
    doc = serving.serving_document(
        snapshot,
        {
            "energia_por_linea": serving.energy_cost_by_line(layers.stored("scored_line_days")),
            "causas": serving.top_causes(layers.cause_months()),
            "olas": serving.wave_counts(done),
        },
    )
    return serving.document_text(doc)


# --- single operators on the order tables ---------------------------------------------------
@query(
    "lineitem_price_pivot",
    final(
        "(SELECT l_returnflag, coalesce(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 0) AS F,"
        " coalesce(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY ALL)",
        "l_returnflag F~ O~", 3,
    ),
    digits=3,
)
def lineitem_price_pivot(spark, sf):
    return pivot_mean(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linestatus", ["F", "O"], "l_extendedprice")


@query(
    "quantity_quantiles_by_supplier",
    final(
        "(SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY ALL)",
        "l_suppkey p50~ p95~",
    ),
)
def quantity_quantiles_by_supplier(spark, sf):
    return exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", {"p50": 0.5, "p95": 0.95}, ["l_suppkey"])


@query(
    "supplier_daily_trend",
    final(
        "(SELECT l_suppkey, dia, ingreso, avg(ingreso) OVER w AS media_7, CASE WHEN count(*) OVER w < 3 THEN 0"
        " ELSE regr_slope(ingreso, i) OVER w END AS pendiente_7, CASE WHEN count(*) OVER m >= 7 THEN avg(ingreso) OVER m END AS media_14 FROM ("
        " SELECT l_suppkey, l_shipdate::DATE AS dia, sum(l_extendedprice) AS ingreso, row_number() OVER (PARTITION BY l_suppkey"
        " ORDER BY l_shipdate::DATE)::DOUBLE AS i FROM lineitem GROUP BY l_suppkey, l_shipdate::DATE)"
        " WINDOW w AS (PARTITION BY l_suppkey ORDER BY dia ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),"
        " m AS (PARTITION BY l_suppkey ORDER BY dia ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))",
        "l_suppkey dia ingreso~ media_7~ pendiente_7~ media_14~", 3,
    ),
    digits=3,
)
def supplier_daily_trend(spark, sf):
    daily = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("dia"))
        .agg(F.sum("l_extendedprice").alias("ingreso"))
    )
    return with_trailing(
        daily, ["l_suppkey"], ["dia"],
        {
            "media_7": Trailing("mean", "ingreso", 7),
            "pendiente_7": Trailing("slope", "ingreso", 7),
            "media_14": Trailing("mean", "ingreso", 14, 7),
        },
    )


@query(
    "order_value_positions",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS posicion,"
    " row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS posicion_prioridad FROM orders",
)
def order_value_positions(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    overall = with_position(orders, "posicion", order)
    return with_position(overall, "posicion_prioridad", order, ["o_orderpriority"]).select(
        "o_orderkey", "posicion", "posicion_prioridad"
    )


@query(
    "running_order_value",
    final(
        "(SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"
        " AS acumulado FROM orders)",
        "o_orderkey acumulado~", 1,
    ),
    digits=1,
)
def running_order_value(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return with_running_sum(
        orders, {"acumulado": F.col("o_totalprice")}, [F.asc("o_orderdate"), F.asc("o_orderkey")], ["o_orderstatus"]
    ).select("o_orderkey", "acumulado")


@query(
    "largest_orders_per_customer",
    "SELECT o_custkey, o_orderkey, r::INT AS lugar FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey"
    " ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
)
def largest_orders_per_customer(spark, sf):
    best = top_per_group(
        table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
        ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, "lugar",
    )
    return best.drop("o_totalprice")


@query(
    "near_priced_parts_of_a_brand",
    "SELECT a.p_brand, a.p_partkey AS id_1, b.p_partkey AS id_2 FROM part a JOIN part b ON a.p_brand = b.p_brand"
    " AND a.p_size = b.p_size AND (b.p_retailprice, b.p_partkey) > (a.p_retailprice, a.p_partkey)"
    " AND b.p_retailprice - a.p_retailprice <= 5",
)
def near_priced_parts_of_a_brand(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_size", "p_partkey", "p_retailprice")
    return near_value_pairs(parts, ["p_brand", "p_size"], "p_partkey", "p_retailprice", 5.0).select("p_brand", "id_1", "id_2")


@query(
    "item_price_relative_to_supplier",
    final(
        "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice / nullif(avg(l_extendedprice)"
        " OVER (PARTITION BY l_suppkey), 0) AS relativo FROM lineitem)",
        "l_orderkey l_linenumber l_partkey l_suppkey l_shipdate relativo~",
    ),
)
def item_price_relative_to_supplier(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    return with_group_stats(items, ["l_suppkey"], {"media": F.avg("l_extendedprice")}).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        (F.col("l_extendedprice") / F.nullif(F.col("media"), F.lit(0.0))).alias("relativo"),
    )


@query(
    "most_common_item_status",
    "SELECT l_suppkey, l_returnflag AS estado FROM (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey"
    " ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY l_suppkey, l_returnflag) WHERE r = 1",
)
def most_common_item_status(spark, sf):
    return most_common(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", "estado")


@query(
    "claim_patterns_in_documents",
    "SELECT doc_id, len(regexp_extract_all(text, '\\b(?:the|of)\\b', 0, 'i')) + len(regexp_extract_all(text, 'e[nr]t', 0, 'i')) AS hits"
    " FROM documents",
)
def claim_patterns_in_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", pattern_hits("text", [r"\b(?:the|of)\b", "e[nr]t"]).alias("hits"))


@query(
    "event_properties",
    final(
        "(SELECT event_type, count(*) AS n, avg((props->>'k')::INT) AS media_k, max((props->>'k')::INT) AS max_k FROM events GROUP BY ALL)",
        "event_type n media_k~ max_k",
    ),
)
def event_properties(spark, sf):
    parsed = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return parsed.groupBy("event_type").agg(
        F.count("*").alias("n"), F.avg("p.k").alias("media_k"), F.max("p.k").alias("max_k")
    )


@query(
    "orders_of_latest_month",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS periodo FROM orders WHERE strftime(o_orderdate, '%Y-%m') ="
    " (SELECT max(strftime(o_orderdate, '%Y-%m')) FROM orders)",
)
def orders_of_latest_month(spark, sf):
    return latest_period(table(spark, sf, "orders").select("o_orderkey", period("o_orderdate").alias("periodo")), "periodo")


@query(
    "customers_by_segment_or_all",
    "SELECT c_custkey, 'building' AS filtro FROM customer WHERE lower(c_mktsegment) = 'building'"
    " UNION ALL SELECT c_custkey, 'todos' FROM customer",
)
def customers_by_segment_or_all(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    found = keep_matching_or_all(customers, F.lower("c_mktsegment") == "building")
    whole = keep_matching_or_all(customers, F.lower("c_mktsegment") == "no-such-segment")
    return found.select("c_custkey", F.lit("building").alias("filtro")).unionByName(
        whole.select("c_custkey", F.lit("todos").alias("filtro"))
    )


@query(
    "customers_without_orders",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
)
def customers_without_orders(spark, sf):
    ordered = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return missing_from(table(spark, sf, "customer").select("c_custkey"), ordered, ["c_custkey"])


@query(
    "customers_and_suppliers",
    final(
        "(SELECT c_name AS nombre, c_acctbal AS saldo, c_mktsegment AS segmento FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier)",
        "nombre saldo~ segmento",
    ),
)
def customers_and_suppliers(spark, sf):
    return stack_rows(
        table(spark, sf, "customer").select(
            F.col("c_name").alias("nombre"), F.col("c_acctbal").alias("saldo"), F.col("c_mktsegment").alias("segmento")
        ),
        table(spark, sf, "supplier").select(F.col("s_name").alias("nombre"), F.col("s_acctbal").alias("saldo")),
    )


@query(
    "order_value_reconciliation",
    final(
        "(SELECT max(abs(o.o_totalprice - l.v)) AS diferencia FROM orders o JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v"
        " FROM lineitem GROUP BY ALL) l ON l.l_orderkey = o.o_orderkey)",
        "diferencia~", 2,
    ),
    digits=2,
)
def order_value_reconciliation(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return reconcile(orders, items, ["k"], {"diferencia": ("o_totalprice", "v")})


@query(
    "part_labels",
    "SELECT p_partkey, 'OLA_' || CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size AS secuencia,"
    " format('{:t,}', p_partkey * 1234567) AS con_miles, printf('%.2f', p_retailprice) AS precio,"
    " CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 3 ELSE 9 END AS nivel,"
    " lower(p_name) || '|' || p_brand AS clave, try_cast(p_brand AS DATE) IS NULL AS sin_fecha FROM part".replace("{:t,}", "{:,}"),
)
def part_labels(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select(
        "p_partkey",
        sequence_label("OLA_", "p_size").alias("secuencia"),
        grouped_number(F.col("p_partkey") * 1234567).alias("con_miles"),
        fixed("p_retailprice", 2).alias("precio"),
        lookup("p_type", {"SMALL": 1, "LARGE": 3}, 9).alias("nivel"),
        F.concat_ws("|", F.lower("p_name"), "p_brand").alias("clave"),
        lenient_timestamp("p_brand").isNull().alias("sin_fecha"),
    )


@query(
    "first_orders_sample",
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 500",
)
def first_orders_sample(spark, sf):
    """Reproducible head sample by key."""
    return sample_head(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), [F.asc("o_orderkey")], 500)


@query(
    "orders_with_customer_segment",
    final(
        "(SELECT coalesce(c_mktsegment, 'sin segmento') AS segmento, o_orderpriority, count(*) AS n, avg(o_totalprice) AS medio,"
        " stddev_samp(o_totalprice) AS desviacion, sum(o_totalprice * o_custkey) / nullif(sum(o_custkey), 0) AS ponderado,"
        " count(*) FILTER (WHERE o_orderstatus = 'F') AS finalizados FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ALL)",
        "segmento o_orderpriority n medio~ desviacion~ ponderado~ finalizados", 2,
    ),
    digits=2,
)
def orders_with_customer_segment(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    joined = left_on(table(spark, sf, "orders"), customers, ["o_custkey"])
    return joined.groupBy(F.coalesce("c_mktsegment", F.lit("sin segmento")).alias("segmento"), "o_orderpriority").agg(
        F.count("*").alias("n"),
        F.avg("o_totalprice").alias("medio"),
        F.stddev_samp("o_totalprice").alias("desviacion"),
        (F.sum(F.col("o_totalprice") * F.col("o_custkey")) / F.nullif(F.sum("o_custkey"), F.lit(0))).alias("ponderado"),
        F.count_if(F.col("o_orderstatus") == "F").alias("finalizados"),
    )


@query(
    "guarded_item_ratios",
    final(
        "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, coalesce(l_tax / nullif(l_discount, 0), 0) AS razon FROM lineitem)",
        "l_orderkey l_linenumber l_partkey l_suppkey l_shipdate razon~",
    ),
)
def guarded_item_ratios(spark, sf):
    """Ratios with zero denominators, cleaned to 0 like unusable numbers."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        finite_or_zero(F.col("l_tax") / F.nullif(F.col("l_discount"), F.lit(0.0))).alias("razon"),
    )
