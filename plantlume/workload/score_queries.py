"""Feature tables, diagnostic scores and their robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import Band, anchored
from ..operators.robustness import outlier_shifts, spearman, topk_overlap, with_minmax_score
from ..plans import diagnostics, features
from .catalog import define, final, query
from .layers import Layers
from .roles import table


def anc(x: str, low: float, high: float, invert: bool = False) -> str:
    """SQL of an anchored score scaled to 0..1, NULL kept."""
    share = f"(({x}) - {low}::DOUBLE) / {high - low}::DOUBLE"
    share = f"1 - {share}" if invert else share
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0::DOUBLE, least(1::DOUBLE, {share})) END"


def pos(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN greatest({x}, 0::DOUBLE) END"


def slope(y: str, key: str, rows: int) -> str:
    frame = f"(PARTITION BY {key} ORDER BY fecha ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"CASE WHEN count(*) OVER {frame} < {max(3, rows // 2)} THEN 0"
        f" WHEN count({y}) OVER {frame} < 2 THEN NULL ELSE regr_slope({y}, i) OVER {frame} END"
    )


SCALED = "'anchored_reference_linear'"
VERSION = "'anchored_reference_v1'"
ABS = "'absolute_comparable_inter_release'"
CTX = "'contextual_comparable_inter_release'"

# --- line-day -------------------------------------------------------------------------------
define(
    "line_feature_base",
    "SELECT m.*, l.criticidad_linea, b.sec_referencia,"
    " row_number() OVER (PARTITION BY m.linea_id ORDER BY m.fecha)::DOUBLE AS i"
    " FROM mart_line m JOIN lineas_proceso l USING (linea_id) LEFT JOIN ("
    " SELECT periodo, familia_proceso, avg(sec_referencia) AS sec_referencia FROM benchmark_externo_proxy"
    " GROUP BY ALL) b ON b.periodo = strftime(m.fecha, '%Y-%m') AND b.familia_proceso = m.familia_proceso",
)
define(
    "line_feature",
    "SELECT *, loss_value_proxy * (0.45 * (" + anc("process_deviation_density", 0, 0.03) + ") + 0.35 * ("
    + anc("quality_loss_proxy", 0.01, 0.05) + ") + 0.2) AS process_loss_proxy,"
    " coalesce(greatest(sec_vs_target, 0) * production_volume * 0.09, 0)"
    " * (sec_vs_target IS NOT NULL)::INT AS thermal_loss_proxy FROM ("
    "SELECT fecha, planta_id, linea_id, familia_proceso, i, production_volume_ton AS production_volume,"
    " utilization_rate / 0.88 AS planned_vs_actual_utilization, sec_kwh_ton AS sec,"
    " sec_kwh_ton - sec_target_kwh_ton AS sec_vs_target, sec_kwh_ton - sec_referencia AS sec_vs_benchmark,"
    " cost_energy_per_unit,"
    " CASE WHEN production_volume_ton > 0 THEN emissions_kg / production_volume_ton END AS emissions_per_unit,"
    " oee_synthetic, availability_rate, " + pos("(1 - utilization_rate)") + " AS performance_loss_proxy, "
    + pos("(1 - quality_rate_proxy)") + " AS quality_loss_proxy,"
    " CASE WHEN production_volume_ton > 0 THEN n_paradas / production_volume_ton ELSE 0 END AS stop_density,"
    " CASE WHEN production_volume_ton > 0 THEN n_desvios / production_volume_ton ELSE 0 END"
    " AS process_deviation_density, loss_value_proxy_eur AS loss_value_proxy,"
    " least(criticidad_linea / 5, 1) AS line_criticality_weight, "
    + slope("sec_kwh_ton", "linea_id", 7) + " AS trend_sec_7d, "
    + slope("oee_synthetic", "linea_id", 7) + " AS trend_oee_7d FROM line_feature_base)",
)
LINE_FEATURES = (
    "fecha planta_id linea_id familia_proceso production_volume~ planned_vs_actual_utilization~ sec~"
    " sec_vs_target~ sec_vs_benchmark~ cost_energy_per_unit~ emissions_per_unit~ oee_synthetic~"
    " availability_rate~ performance_loss_proxy~ quality_loss_proxy~ stop_density~"
    " process_deviation_density~ loss_value_proxy~ thermal_loss_proxy~ process_loss_proxy~"
    " line_criticality_weight~ trend_sec_7d~ trend_oee_7d~"
)


@query("line_day_features", final("line_feature", LINE_FEATURES, 3), digits=3)
def line_day_features(spark, sf):
    return Layers(spark, sf).line_day_features()


define(
    "line_scored",
    "SELECT *, sec_vs_benchmark AS sec_benchmark_gap, CASE WHEN count(sec_vs_benchmark) OVER w >= 7"
    " THEN avg(sec_vs_benchmark) OVER w END AS sec_gap_persistencia_14d, 100 * (0.45 * ("
    + anc("process_deviation_density", 0, 0.03) + ") + 0.25 * (" + anc("quality_loss_proxy", 0.01, 0.05)
    + ") + 0.2 * (" + anc("stop_density", 0, 0.02) + ") + 0.1 * (" + anc("performance_loss_proxy", 0, 0.35)
    + ")) AS process_deviation_risk_score, stop_density * loss_value_proxy AS loss_stop_proxy,"
    " process_loss_proxy AS loss_process_proxy, thermal_loss_proxy AS loss_thermal_proxy,"
    f" {SCALED} AS process_deviation_risk_scaling_method, {VERSION} AS process_deviation_risk_scale_version,"
    f" {ABS} AS process_deviation_risk_comparability_tag"
    " FROM line_feature WINDOW w AS (PARTITION BY linea_id ORDER BY fecha"
    " ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)",
)


@query(
    "scored_line_days",
    final(
        "line_scored",
        LINE_FEATURES + " sec_benchmark_gap~ sec_gap_persistencia_14d~ process_deviation_risk_score~"
        " process_deviation_risk_scaling_method process_deviation_risk_scale_version"
        " process_deviation_risk_comparability_tag loss_stop_proxy~ loss_process_proxy~ loss_thermal_proxy~",
        3,
    ),
    digits=3,
)
def scored_line_days(spark, sf):
    return Layers(spark, sf).scored_line_days()


# --- equipment-day --------------------------------------------------------------------------
define(
    "equipment_feature",
    "SELECT *, 100 * (0.3 * (" + anc("energy_intensity_relative", 0.85, 1.25) + ") + 0.2 * ("
    + anc("downtime_hours", 0, 8) + ") + 0.2 * (" + anc("anomaly_count", 0, 3) + ") + 0.15 * ("
    + anc(pos("performance_drift"), 0, 0.006) + ") + 0.15 * (" + anc("criticality_weight", 0.2, 1)
    + ")) AS energy_risk_proxy FROM (SELECT fecha, planta_id, linea_id, equipo_id, tipo_equipo, subsistema,"
    " consumo_relativo_tipo AS energy_intensity_relative,"
    " (factor_carga_prom >= 1 OR consumo_relativo_tipo >= 1.15"
    " OR consumo_relativo_tipo * potencia_nominal_kw >= potencia_nominal_kw * 1.12::DOUBLE)::INT AS overload_events,"
    " (consumo_relativo_tipo >= 1.2)::INT + (disponibilidad_proxy <= 0.9)::INT + (n_paradas >= 2)::INT"
    " + (n_mantenimientos >= 1)::INT AS anomaly_count, horas_parada AS downtime_hours,"
    " n_paradas AS downtime_frequency, horas_mantenimiento / 24 AS maintenance_load,"
    " coalesce(CASE WHEN count(*) OVER w >= 3 THEN sum(n_paradas) OVER w END >= 5, false)::INT AS repeated_stop_flag, "
    + slope("consumo_relativo_tipo", "equipo_id", 14) + " AS performance_drift,"
    " coste_energia_eur + coste_mantenimiento_eur + horas_parada * 420 AS cost_impact_proxy,"
    " least(criticidad_equipo / 5, 1) AS criticality_weight FROM ("
    " SELECT m.*, q.potencia_nominal_kw, row_number() OVER (PARTITION BY m.equipo_id ORDER BY m.fecha)::DOUBLE AS i"
    " FROM mart_equipment m JOIN equipos q USING (equipo_id))"
    " WINDOW w AS (PARTITION BY equipo_id ORDER BY fecha ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))",
)
EQUIPMENT_FEATURES = (
    "fecha planta_id linea_id equipo_id tipo_equipo subsistema energy_intensity_relative~ overload_events"
    " anomaly_count downtime_hours~ downtime_frequency maintenance_load~ repeated_stop_flag"
    " performance_drift~ cost_impact_proxy~ criticality_weight~ energy_risk_proxy~"
)


@query(
    "equipment_day_features",
    final(
        f"(SELECT *, {SCALED} AS energy_risk_proxy_scaling_method, {VERSION} AS energy_risk_proxy_scale_version,"
        f" {ABS} AS energy_risk_proxy_comparability_tag FROM equipment_feature)",
        EQUIPMENT_FEATURES + " energy_risk_proxy_scaling_method energy_risk_proxy_scale_version"
        " energy_risk_proxy_comparability_tag",
    ),
)
def equipment_day_features(spark, sf):
    return Layers(spark, sf).equipment_day_features()


define(
    "equipment_scored",
    "SELECT *, 100 * (0.35 * (" + anc("energy_intensity_relative", 0.85, 1.25) + ") + 0.25 * ("
    + anc("anomaly_count", 0, 3) + ") + 0.2 * (" + anc("overload_events", 0, 1) + ") + 0.2 * ("
    + anc(pos("performance_drift"), 0, 0.006) + ")) AS equipment_energy_anomaly_score FROM equipment_feature",
)


@query(
    "equipment_anomaly_scores",
    final(
        "(SELECT * FROM equipment_scored)",
        "fecha planta_id linea_id equipo_id equipment_energy_anomaly_score~ overload_events anomaly_count"
        " repeated_stop_flag performance_drift~",
    ),
)
def equipment_anomaly_scores(spark, sf):
    return (
        Layers(spark, sf)
        .equipment_scores()
        .select(
            "fecha", "planta_id", "linea_id", "equipo_id", "equipment_energy_anomaly_score", "overload_events",
            "anomaly_count", "repeated_stop_flag", "performance_drift",
        )
    )


# --- shift ----------------------------------------------------------------------------------
define(
    "shift_feature",
    "SELECT *, 100 * (0.3 * (CASE familia_proceso WHEN 'Laminacion' THEN " + anc("sec_shift", 360, 620)
    + " WHEN 'TratamientoTermico' THEN " + anc("sec_shift", 420, 700) + " WHEN 'Acabado' THEN "
    + anc("sec_shift", 330, 560) + " WHEN 'InspeccionFinal' THEN " + anc("sec_shift", 300, 520) + " ELSE "
    + anc("sec_shift", 320, 620) + " END) + 0.2 * (" + anc("deviation_rate", 0, 0.05) + ") + 0.2 * ("
    + anc("stop_minutes", 0, 480) + ") + 0.15 * (" + anc("scrap_pct", 0.8, 5) + ") + 0.15 * ("
    + anc("operator_pressure_proxy", 75, 112) + ")) AS shift_variance_score FROM ("
    "SELECT s.fecha, s.turno, s.planta_id, s.linea_id, s.familia_proceso,"
    " s.toneladas_producidas_proxy AS throughput, s.sec_shift_kwh_ton AS sec_shift,"
    " CASE WHEN s.toneladas_producidas_proxy > 0 THEN s.n_desvios_shift / s.toneladas_producidas_proxy ELSE 0 END"
    " AS deviation_rate, s.horas_parada_shift * 60 AS stop_minutes, s.scrap_pct, s.reproceso_pct AS rework_pct,"
    " 45 * coalesce(c.demanda_operativa_indice, 1) + 35 * coalesce(c.tension_operativa_proxy, 1)"
    " + 20 * coalesce(c.mix_complejidad_indice, 1) AS operator_pressure_proxy"
    " FROM int_line_shift s LEFT JOIN contexto_operativo c USING (fecha, turno, planta_id))",
)


@query(
    "shift_features",
    final(
        f"(SELECT *, {SCALED} AS shift_variance_score_scaling_method, {VERSION} AS shift_variance_score_scale_version,"
        f" {ABS} AS shift_variance_score_comparability_tag FROM shift_feature)",
        "fecha turno planta_id linea_id familia_proceso throughput~ sec_shift~ deviation_rate~ stop_minutes~"
        " scrap_pct~ rework_pct~ operator_pressure_proxy~ shift_variance_score~"
        " shift_variance_score_scaling_method shift_variance_score_scale_version"
        " shift_variance_score_comparability_tag",
    ),
)
def shift_features(spark, sf):
    return Layers(spark, sf).shift_features()


@query(
    "shift_comparison",
    final(
        "(SELECT planta_id, linea_id, turno, avg(sec_shift) AS sec_shift,"
        " avg(shift_variance_score) AS shift_variance_score, avg(scrap_pct) AS scrap_pct,"
        " avg(stop_minutes) AS stop_minutes FROM shift_feature GROUP BY ALL)",
        "planta_id linea_id turno sec_shift~ shift_variance_score~ scrap_pct~ stop_minutes~",
    ),
)
def shift_comparison(spark, sf):
    return diagnostics.shift_comparison(Layers(spark, sf).stored("shift_features"))


# --- opportunities --------------------------------------------------------------------------
define(
    "line_base_means",
    "SELECT planta_id, linea_id, avg(emissions_per_unit) AS base_emissions_per_unit,"
    " avg(loss_value_proxy) AS base_loss, avg(line_criticality_weight) AS base_line_criticality"
    " FROM line_feature GROUP BY ALL",
)
define(
    "opportunity_base",
    "SELECT v.*, coalesce(b.base_emissions_per_unit, 0) AS be, coalesce(b.base_loss, 0) AS bl,"
    " coalesce(b.base_line_criticality, 0) AS bc,"
    " v.ahorro_anual_estimado * v.impacto_esperado_energia_pct / 100 AS expected_energy_saving,"
    " CASE v.horizonte_implantacion WHEN '0-12 meses' THEN 1 ELSE 3 END AS hz,"
    " CASE v.riesgo_implantacion WHEN 'Bajo' THEN 1 WHEN 'Alto' THEN 5 ELSE 3 END AS rk"
    " FROM value_pool v LEFT JOIN line_base_means b USING (planta_id, linea_id)",
)
define(
    "opportunity_feature",
    "SELECT iniciativa_id, planta_id, linea_id, equipo_id, categoria_iniciativa, tipo_iniciativa,"
    " descripcion_resumida, expected_energy_saving, impacto_esperado_oee_pct AS expected_oee_gain,"
    " be * impacto_esperado_emisiones_pct * 10 AS expected_emissions_reduction,"
    " 0.7 * ahorro_anual_estimado + 0.2 * expected_energy_saving + 0.001 * bl * impacto_esperado_oee_pct"
    " AS annual_saving_proxy,"
    " 100 * (0.6::DOUBLE * dificultad_implementacion / 5 + 0.25 * (" + anc("capex_estimado", 50000, 2300000)
    + ") + 0.15::DOUBLE * hz / 5) AS implementation_complexity_score,"
    " 100 * (0.5::DOUBLE * rk / 5 + 0.3::DOUBLE * dificultad_implementacion / 5 + 0.2::DOUBLE * (1 - quick_win_flag))"
    " AS execution_risk_score, payback_estimado_meses AS payback_months,"
    " 100 * (0.45::DOUBLE * least(criticidad_estrategica / 5, 1) + 0.3 * bc + 0.25 * ("
    + anc("impacto_esperado_emisiones_pct", 1, 20) + ")) AS strategic_alignment_score,"
    " 100 * (0.4 * (" + anc("bl", 8000, 45000) + ") + 0.3 * bc + 0.2 * (" + anc("impacto_esperado_oee_pct", 1, 15)
    + ") + CASE WHEN quick_win_flag = 1 THEN 0.1 ELSE 0.04 END) AS operational_urgency_score,"
    " quick_win_flag, capex_estimado FROM opportunity_base",
)
OPPORTUNITY = (
    "iniciativa_id planta_id linea_id equipo_id categoria_iniciativa tipo_iniciativa descripcion_resumida"
    " expected_energy_saving~ expected_oee_gain~ expected_emissions_reduction~ annual_saving_proxy~"
    " implementation_complexity_score~ execution_risk_score~ payback_months~ strategic_alignment_score~"
    " operational_urgency_score~ quick_win_flag capex_estimado~"
)
define(
    "opportunity_scored",
    "SELECT *, 100 * (0.35 * (" + anc("annual_saving_proxy", 100000, 800000) + ") + 0.2 * ("
    + anc("payback_months", 6, 36, True) + ") + 0.2 * (" + anc("operational_urgency_score", 30, 85)
    + ") + 0.15 * (" + anc("strategic_alignment_score", 30, 95) + ") + 0.1 * ("
    + anc("implementation_complexity_score", 20, 95, True) + ")) AS opportunity_priority_score"
    " FROM opportunity_feature",
)


@query(
    "opportunity_scores",
    final(
        f"(SELECT *, {SCALED} AS implementation_complexity_score_scaling_method,"
        f" {SCALED} AS operational_urgency_score_scaling_method, {SCALED} AS strategic_alignment_score_scaling_method,"
        f" {VERSION} AS score_scale_version, {CTX} AS opportunity_feature_comparability_tag,"
        f" {SCALED} AS opportunity_priority_scaling_method, {VERSION} AS opportunity_priority_scale_version,"
        f" {CTX} AS opportunity_priority_comparability_tag FROM opportunity_scored)",
        OPPORTUNITY + " opportunity_priority_score~ implementation_complexity_score_scaling_method"
        " operational_urgency_score_scaling_method strategic_alignment_score_scaling_method score_scale_version"
        " opportunity_feature_comparability_tag opportunity_priority_scaling_method"
        " opportunity_priority_scale_version opportunity_priority_comparability_tag",
    ),
)
def opportunity_scores(spark, sf):
    return Layers(spark, sf).opportunity_scores()


# --- line criticality, drivers, persistence -------------------------------------------------
define(
    "line_mean",
    "SELECT planta_id, linea_id, avg(sec_benchmark_gap) AS sec_benchmark_gap, avg(oee_synthetic) AS oee_synthetic,"
    " avg(process_deviation_risk_score) AS process_deviation_risk_score, avg(loss_value_proxy) AS loss_value_proxy,"
    " avg(line_criticality_weight) AS line_criticality_weight, avg(trend_sec_7d) AS trend_sec_7d,"
    " avg(loss_stop_proxy) AS ls, avg(loss_process_proxy) AS lp, avg(loss_thermal_proxy) AS lt,"
    " avg(sec_gap_persistencia_14d) AS sec_gap_persistencia_14d, stddev_samp(sec_benchmark_gap) AS sec_gap_std"
    " FROM line_scored GROUP BY ALL",
)
define(
    "line_criticality",
    "SELECT *, 100 * (0.3 * (" + anc("loss_value_proxy", 9000, 45000) + ") + 0.2 * ("
    + anc(pos("sec_benchmark_gap"), 0, 120) + ") + 0.2 * (" + anc("oee_synthetic", 0.75, 1, True) + ") + 0.2 * ("
    + anc("process_deviation_risk_score", 10, 80) + ") + 0.1 * (" + anc("line_criticality_weight", 0.4, 1)
    + ")) AS line_criticality_score,"
    " CASE WHEN ls >= lp AND ls >= lt THEN 'Paradas' WHEN lp >= lt THEN 'DesvioProceso'"
    " ELSE 'IneficienciaTermica' END AS main_loss_driver FROM line_mean",
)


@query(
    "line_criticality_scores",
    final(
        "(SELECT *, CASE main_loss_driver"
        " WHEN 'Paradas' THEN 'Priorizar mantenimiento y confiabilidad de equipos criticos'"
        " WHEN 'DesvioProceso' THEN 'Optimizar parametros de proceso y disciplina operativa por turno'"
        " ELSE 'Ejecutar quick wins energeticos y plan de eficiencia termica' END AS recommended_action_initial,"
        f" {SCALED} AS line_criticality_scaling_method, {VERSION} AS line_criticality_scale_version,"
        f" {CTX} AS line_criticality_comparability_tag FROM line_criticality)",
        "planta_id linea_id sec_benchmark_gap~ oee_synthetic~ process_deviation_risk_score~ loss_value_proxy~"
        " line_criticality_weight~ trend_sec_7d~ line_criticality_score~ line_criticality_scaling_method"
        " line_criticality_scale_version line_criticality_comparability_tag main_loss_driver"
        " recommended_action_initial",
        3,
    ),
    digits=3,
)
def line_criticality_scores(spark, sf):
    return Layers(spark, sf).line_scores()


@query(
    "line_persistence",
    final(
        "(SELECT planta_id, linea_id, sec_benchmark_gap AS sec_gap_avg, sec_gap_std, sec_gap_persistencia_14d,"
        " abs(sec_benchmark_gap) / nullif(sec_gap_std, 0) AS signal_to_noise,"
        " (coalesce(sec_gap_persistencia_14d > 0, false)"
        " AND coalesce(abs(sec_benchmark_gap) / nullif(sec_gap_std, 0), 0) > 0.8)::INT AS problema_estructural_flag"
        " FROM line_mean)",
        "planta_id linea_id sec_gap_avg~ sec_gap_std~ sec_gap_persistencia_14d~ signal_to_noise~"
        " problema_estructural_flag",
    ),
)
def line_persistence(spark, sf):
    return diagnostics.line_persistence(Layers(spark, sf).stored("scored_line_days"))


@query(
    "root_cause_scores",
    final(
        "(SELECT planta_id, linea_id, causa_parada, sum(n_eventos)::BIGINT AS n_eventos,"
        " sum(horas_parada) AS horas_parada, sum(impacto_produccion_proxy) AS impacto_produccion_proxy,"
        " sum(impacto_energia_proxy) AS impacto_energia_proxy,"
        " sum(emisiones_asociadas_kg) AS emisiones_asociadas_kg,"
        " sum(loss_root_cause_score) AS loss_root_cause_score FROM cause_month GROUP BY ALL)",
        "planta_id linea_id causa_parada n_eventos horas_parada~ impacto_produccion_proxy~"
        " impacto_energia_proxy~ emisiones_asociadas_kg~ loss_root_cause_score~",
        3,
    ),
    digits=3,
)
def root_cause_scores(spark, sf):
    return diagnostics.root_cause_scores(Layers(spark, sf).cause_months())


# --- summaries ------------------------------------------------------------------------------
def _feature_tables(layers: Layers) -> dict:
    return {
        "line_day_features": layers.stored("line_day_features"),
        "equipment_day_features": layers.stored("equipment_day_features"),
        "shift_features": layers.stored("shift_features"),
        "improvement_opportunity_features": layers.opportunity_features(),
    }


@query(
    "feature_summary",
    "SELECT 'line_day_features' AS tabla, count(*) AS filas, 23 AS columnas FROM line_feature"
    " UNION ALL SELECT 'equipment_day_features', count(*), 20 FROM equipment_feature"
    " UNION ALL SELECT 'shift_features', count(*), 16 FROM shift_feature"
    " UNION ALL SELECT 'improvement_opportunity_features', count(*), 23 FROM opportunity_feature",
)
def feature_summary(spark, sf):
    return features.feature_summary(_feature_tables(Layers(spark, sf)))


def _coverage_sql() -> str:
    source = {
        "line_day_features": "line_feature",
        "equipment_day_features": "equipment_feature",
        "shift_features": "shift_feature",
        "improvement_opportunity_features": "opportunity_feature",
    }
    parts = [
        f"SELECT '{t}' AS tabla, '{f}' AS feature, '{kind}' AS tipo, '{text}' AS logica_negocio,"
        f" count({f}) AS conocidos, avg({f}) AS media FROM {source[t]}"
        for t, f, kind, text in features.FEATURE_DICTIONARY
    ]
    return final("(" + " UNION ALL ".join(parts) + ")", "tabla feature tipo logica_negocio conocidos media~", 3)


@query("feature_dictionary_coverage", _coverage_sql(), digits=3)
def feature_dictionary_coverage(spark, sf):
    return features.feature_coverage(_feature_tables(Layers(spark, sf)))


# --- robustness -----------------------------------------------------------------------------
def minmax(x: str, over: str = "") -> str:
    lo, hi = f"min({x}) OVER ({over})", f"max({x}) OVER ({over})"
    return (
        f"CASE WHEN ({x}) IS NULL THEN CASE WHEN {lo} IS NULL OR {lo} = {hi} THEN NULL END"
        f" WHEN {lo} = {hi} THEN 50 ELSE 100 * (({x}) - {lo}) / ({hi} - {lo}) END"
    )


@query(
    "lineitem_minmax_scores",
    final(
        "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, " + minmax("l_extendedprice")
        + " AS price_score, 100 - (" + minmax("l_discount") + ") AS discount_score, "
        + anc("l_quantity", 5, 40) + " * 100 AS quantity_score FROM lineitem)",
        "l_orderkey l_linenumber l_partkey l_suppkey l_shipdate price_score~ discount_score~ quantity_score~",
    ),
)
def lineitem_minmax_scores(spark, sf):
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount", "l_quantity"
    )
    scored = with_minmax_score(
        items, {"price_score": (F.col("l_extendedprice"), False), "discount_score": (F.col("l_discount"), True)}
    )
    return scored.withColumn("quantity_score", anchored("l_quantity", Band(5.0, 40.0))).drop(
        "l_extendedprice", "l_discount", "l_quantity"
    )


def avg_rank_sql(column: str, source: str, name: str) -> str:
    return (
        f"SELECT *, rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2 AS {name}"
        f" FROM {source}"
    )


@query(
    "rank_correlation_of_item_measures",
    "SELECT round(coalesce(corr(ra, rb), 0) + 3.17e-10, 6) AS spearman FROM ("
    + avg_rank_sql("l_extendedprice", "(" + avg_rank_sql("l_quantity", "lineitem", "ra") + ")", "rb")
    + ")",
    digits=6,
)
def rank_correlation_of_item_measures(spark, sf):
    return spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


define(
    "order_peak",
    "SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1 AS top FROM orders",
)


@query(
    "outlier_shift_of_order_value",
    "SELECT o_orderpriority, round(median(abs(m2 - m1)) + 3.17e-10, 6) AS legacy_outlier_median_abs_shift,"
    " round(median(abs(a2 - a1)) + 3.17e-10, 6) AS anchored_outlier_median_abs_shift FROM (SELECT o_orderpriority, top,"
    + " 100 * (" + anc("o_totalprice", 1000, 400000) + ") AS a1,"
    + " 100 * (" + anc("CASE WHEN top THEN o_totalprice * 3 ELSE o_totalprice END", 1000, 400000) + ") AS a2,"
    + minmax("o_totalprice", "PARTITION BY o_orderpriority") + " AS m1, "
    + minmax("CASE WHEN top THEN o_totalprice * 3 ELSE o_totalprice END", "PARTITION BY o_orderpriority")
    + " AS m2 FROM order_peak) WHERE NOT top GROUP BY ALL",
    digits=6,
)
def outlier_shift_of_order_value(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority",
        F.lit(1000.0).alias("low"), F.lit(400000.0).alias("high"), F.lit(False).alias("invert"),
    )
    return outlier_shifts(orders, "o_totalprice", ["o_orderkey"], ["low", "high", "invert"], ["o_orderpriority"])


define(
    "part_revenue",
    "SELECT l_partkey, sum(l_extendedprice) AS revenue, sum(l_quantity) AS units FROM lineitem GROUP BY ALL",
)


@query(
    "top_parts_overlap",
    "SELECT count(*) AS overlap FROM (SELECT l_partkey FROM part_revenue ORDER BY revenue DESC, l_partkey LIMIT 50) a"
    " JOIN (SELECT l_partkey FROM part_revenue ORDER BY units DESC, l_partkey LIMIT 50) b USING (l_partkey)",
)
def top_parts_overlap(spark, sf):
    parts = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_extendedprice").alias("revenue"), F.sum("l_quantity").alias("units")
    )
    return topk_overlap(parts, "revenue", "units", ["l_partkey"], 50)


def _stability_sql() -> str:
    """Rows of the stability table for the four diagnostic scores."""

    def legacy(terms: list[tuple[float, str, bool]]) -> str:
        return "100 * (" + " + ".join(
            f"{w} * ({'100 - ' if inv else ''}({minmax(x)})) / 100" for w, x, inv in terms
        ) + ")"

    specs = [
        (
            "equipment_energy_anomaly_score", "equipment_scored", "equipo_id, fecha", "energy_intensity_relative",
            (0.85, 1.25), ABS,
            [(0.35, "energy_intensity_relative", False), (0.25, "anomaly_count", False),
             (0.2, "overload_events", False), (0.2, pos("performance_drift"), False)],
        ),
        (
            "process_deviation_risk_score", "line_scored", "linea_id, fecha", "process_deviation_density",
            (0, 0.03), ABS,
            [(0.45, "process_deviation_density", False), (0.25, "quality_loss_proxy", False),
             (0.2, "stop_density", False), (0.1, "performance_loss_proxy", False)],
        ),
        (
            "line_criticality_score", "line_criticality", "linea_id", "loss_value_proxy", (9000, 45000), CTX,
            [(0.3, "loss_value_proxy", False), (0.2, pos("sec_benchmark_gap"), False), (0.2, "oee_synthetic", True),
             (0.2, "process_deviation_risk_score", False), (0.1, "line_criticality_weight", False)],
        ),
        (
            "opportunity_priority_score", "opportunity_scored", "iniciativa_id", "annual_saving_proxy",
            (100000, 800000), CTX,
            [(0.35, "annual_saving_proxy", False), (0.2, "payback_months", True),
             (0.2, "operational_urgency_score", False), (0.15, "strategic_alignment_score", False),
             (0.1, "implementation_complexity_score", True)],
        ),
    ]
    rows = []
    for name, source, ids, raw, (lo, hi), tag, terms in specs:
        ids, keys = "id", ids
        base = (
            f"(SELECT concat_ws('|', {keys}) AS id, {name} AS s, {legacy(terms)} AS g, {raw} AS x,"
            f" row_number() OVER (ORDER BY {raw} DESC NULLS LAST, concat_ws('|', {keys})) = 1 AS top FROM {source})"
        )
        moved = "CASE WHEN top THEN x * 3 ELSE x END"
        shifts = (
            f"SELECT median(abs(m2 - m1)) AS lm, median(abs(a2 - a1)) AS am FROM (SELECT top,"
            f" 100 * ({anc('x', lo, hi)}) AS a1, 100 * ({anc(moved, lo, hi)}) AS a2,"
            f" {minmax('x')} AS m1, {minmax(moved)} AS m2 FROM {base}) WHERE NOT top"
        )
        known = f"(SELECT * FROM {base} WHERE s IS NOT NULL AND g IS NOT NULL)"
        ranks = avg_rank_sql("g", "(" + avg_rank_sql("s", known, "ra") + ")", "rb")
        overlap = (
            f"SELECT count(*) AS n FROM (SELECT {ids} FROM {base} ORDER BY s DESC NULLS LAST, {ids} LIMIT 10) a"
            f" JOIN (SELECT {ids} FROM {base} ORDER BY g DESC NULLS LAST, {ids} LIMIT 10) b USING ({ids})"
        )
        rows.append(
            f"SELECT '{name}' AS score_name, lm AS legacy_outlier_median_abs_shift,"
            f" am AS anchored_outlier_median_abs_shift,"
            f" (SELECT coalesce(corr(ra, rb), 0) FROM ({ranks})) AS spearman_anchored_vs_legacy,"
            f" ({overlap}) AS top10_overlap_anchored_vs_legacy, {tag} AS comparability_tag FROM ({shifts})"
        )
    return final(
        "(" + " UNION ALL ".join(rows) + ")",
        "score_name legacy_outlier_median_abs_shift~ anchored_outlier_median_abs_shift~"
        " spearman_anchored_vs_legacy~ top10_overlap_anchored_vs_legacy comparability_tag",
    )


@query("score_stability", _stability_sql())
def score_stability(spark, sf):
    layers = Layers(spark, sf)
    return diagnostics.score_stability(
        layers.stored("equipment_scores"),
        layers.stored("scored_line_days"),
        layers.stored("line_scores"),
        layers.stored("opportunity_scores"),
    )
