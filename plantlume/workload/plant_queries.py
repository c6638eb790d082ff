"""Integration, marts and indicator views over the event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import fill_hours, overlap_by_hour, overlap_by_shift
from ..plans import emissions, kpis, marts
from .catalog import define, final, query
from .layers import Layers

SHIFT = (
    "CASE WHEN hour({0}) BETWEEN 6 AND 13 THEN 'A' WHEN hour({0}) BETWEEN 14 AND 21 THEN 'B'"
    " ELSE 'C' END"
)

# --- emissions ------------------------------------------------------------------------------
define(
    "energy_source_hour",
    "SELECT date_trunc('hour', timestamp) AS h, planta_id, linea_id, fuente_energia,"
    " sum(consumo_kwh) AS consumo_kwh FROM consumos_energia_horarios GROUP BY ALL",
)
define(
    "emission_factor_hour",
    "SELECT *, round(greatest(0.12, least(0.34, CASE fuente_energia WHEN 'Electricidad' THEN 0.22::DOUBLE"
    " + CASE WHEN month(h) IN (12, 1, 2) THEN 0.03 WHEN month(h) IN (7, 8) THEN -0.02 ELSE 0 END"
    " WHEN 'GasNatural' THEN 0.19::DOUBLE ELSE 0.24::DOUBLE END)), 5) AS factor_emision_proxy"
    " FROM energy_source_hour",
)
define(
    "emission_hours",
    "SELECT e.h AS timestamp, e.planta_id, e.linea_id, e.fuente_energia, e.consumo_kwh,"
    " e.factor_emision_proxy, round(e.consumo_kwh * e.factor_emision_proxy, 5) AS emisiones_co2e_kg,"
    " coalesce(round(CASE WHEN p.toneladas_producidas_proxy > 0 THEN"
    " round(e.consumo_kwh * e.factor_emision_proxy, 5) / (p.toneladas_producidas_proxy / 8) END, 5), 0)"
    " AS intensidad_emisiones_por_unidad"
    " FROM emission_factor_hour e LEFT JOIN produccion_turno p ON p.fecha = e.h::DATE"
    f" AND p.turno = {SHIFT.format('e.h')} AND p.linea_id = e.linea_id AND p.planta_id = e.planta_id",
)


@query(
    "estimated_emissions",
    final(
        "emission_hours",
        "timestamp planta_id linea_id fuente_energia consumo_kwh~ factor_emision_proxy~"
        " emisiones_co2e_kg~ intensidad_emisiones_por_unidad~",
        3,
    ),
    digits=3,
)
def estimated_emissions(spark, sf):
    return Layers(spark, sf).emissions()


# --- line-hour ------------------------------------------------------------------------------
define(
    "energy_line_hour",
    "SELECT date_trunc('hour', timestamp) AS timestamp_hour, planta_id, linea_id,"
    " sum(consumo_kwh) AS consumo_kwh, sum(coste_energia_proxy) AS coste_energia_eur,"
    " avg(factor_carga) AS factor_carga_prom, avg(precio_energia_proxy) AS precio_energia_prom"
    " FROM consumos_energia_horarios GROUP BY ALL",
)
define(
    "emission_line_hour",
    "SELECT timestamp AS timestamp_hour, planta_id, linea_id, sum(emisiones_co2e_kg) AS emisiones_co2e_kg,"
    " avg(factor_emision_proxy) AS factor_emision_prom FROM emission_hours GROUP BY ALL",
)
define(
    "deviation_line_hour",
    "SELECT date_trunc('hour', timestamp) AS timestamp_hour, planta_id, linea_id, count(*) AS n_desvios,"
    " avg(abs(desviacion_pct)) AS desv_abs_media_pct, sum(impacto_en_calidad_proxy) AS impacto_calidad_sum"
    " FROM desvios_proceso GROUP BY ALL",
)
define(
    "stop_line_hour",
    "SELECT date_trunc('hour', fecha_inicio) AS timestamp_hour, planta_id, linea_id, count(*) AS n_paradas,"
    " sum(duracion_horas) AS horas_parada,"
    " coalesce(sum(duracion_horas) FILTER (WHERE planificada_flag = 0), 0) AS horas_parada_no_plan"
    " FROM paradas GROUP BY ALL",
)
define(
    "hour_base",
    f"SELECT e.*, e.timestamp_hour::DATE AS fecha, {SHIFT.format('e.timestamp_hour')} AS turno,"
    " coalesce(m.emisiones_co2e_kg, 0) AS emisiones_co2e_kg,"
    " coalesce(m.factor_emision_prom, 0) AS factor_emision_prom, coalesce(d.n_desvios, 0) AS n_desvios,"
    " coalesce(d.desv_abs_media_pct, 0) AS desv_abs_media_pct,"
    " coalesce(d.impacto_calidad_sum, 0) AS impacto_calidad_sum, coalesce(s.n_paradas, 0) AS n_paradas,"
    " coalesce(s.horas_parada, 0) AS horas_parada, coalesce(s.horas_parada_no_plan, 0) AS horas_parada_no_plan"
    " FROM energy_line_hour e LEFT JOIN emission_line_hour m USING (timestamp_hour, planta_id, linea_id)"
    " LEFT JOIN deviation_line_hour d USING (timestamp_hour, planta_id, linea_id)"
    " LEFT JOIN stop_line_hour s USING (timestamp_hour, planta_id, linea_id)",
)
define(
    "int_line_hour",
    "SELECT b.*, l.familia_proceso, p.toneladas_producidas_proxy / 8 AS toneladas_equivalentes_hora,"
    " p.unidades_producidas / 8 AS unidades_equivalentes_hora, p.utilization_rate, p.scrap_pct,"
    " p.reproceso_pct, p.horas_operativas, p.horas_planificadas,"
    " CASE WHEN p.toneladas_producidas_proxy / 8 >= 0.5"
    " THEN b.consumo_kwh * 8 / p.toneladas_producidas_proxy END AS sec_kwh_ton,"
    " CASE WHEN p.unidades_producidas > 0 THEN b.coste_energia_eur * 8 / p.unidades_producidas END"
    " AS coste_energia_por_unidad,"
    " b.coste_energia_eur + coalesce(p.toneladas_producidas_proxy / 8 * p.scrap_pct * 2.1, 0)"
    " + b.horas_parada * l.capacidad_nominal_hora * 480 + b.emisiones_co2e_kg * 0.085"
    " AS perdida_total_proxy_eur"
    " FROM hour_base b LEFT JOIN lineas_proceso l USING (linea_id)"
    " LEFT JOIN produccion_turno p ON p.fecha = b.fecha AND p.turno = b.turno AND p.linea_id = b.linea_id",
)
LINE_HOUR = (
    "timestamp_hour fecha turno planta_id linea_id familia_proceso consumo_kwh~ coste_energia_eur~"
    " factor_carga_prom~ precio_energia_prom~ emisiones_co2e_kg~ factor_emision_prom~ n_desvios"
    " desv_abs_media_pct~ impacto_calidad_sum~ n_paradas horas_parada~ horas_parada_no_plan~"
    " toneladas_equivalentes_hora~ unidades_equivalentes_hora~ utilization_rate~ scrap_pct~"
    " reproceso_pct~ horas_operativas~ horas_planificadas~ sec_kwh_ton~ coste_energia_por_unidad~"
    " perdida_total_proxy_eur~"
)


@query("line_hour", final("int_line_hour", LINE_HOUR, 3), digits=3)
def line_hour(spark, sf):
    return Layers(spark, sf).line_hour()


# --- equipment-day --------------------------------------------------------------------------
define(
    "energy_equipment_day",
    "SELECT c.timestamp::DATE AS fecha, c.planta_id, c.linea_id, c.equipo_id, q.tipo_equipo, q.subsistema,"
    " q.criticidad_equipo, q.eficiencia_nominal, sum(c.consumo_kwh) AS consumo_kwh,"
    " avg(c.factor_carga) AS factor_carga_prom, sum(c.coste_energia_proxy) AS coste_energia_eur,"
    " avg(c.demanda_kw) AS demanda_kw_media"
    " FROM consumos_energia_horarios c JOIN equipos q USING (equipo_id) GROUP BY ALL",
)
define(
    "stop_equipment_day",
    "SELECT fecha_inicio::DATE AS fecha, equipo_id, count(*) AS n_paradas, sum(duracion_horas) AS horas_parada,"
    " count(*) FILTER (WHERE planificada_flag = 0) AS n_paradas_no_plan FROM paradas GROUP BY ALL",
)
define(
    "care_equipment_day",
    "SELECT fecha_inicio::DATE AS fecha, equipo_id, count(*) AS n_mantenimientos,"
    " sum(horas_mantenimiento) AS horas_mantenimiento,"
    " sum(coste_mantenimiento_proxy) AS coste_mantenimiento_eur FROM mantenimientos GROUP BY ALL",
)
define(
    "deviation_equipment_day",
    "SELECT timestamp::DATE AS fecha, equipo_id, count(*) AS n_desvios,"
    " avg(abs(desviacion_pct)) AS desviacion_abs_media, sum(impacto_en_calidad_proxy) AS impacto_calidad_sum"
    " FROM desvios_proceso GROUP BY ALL",
)
define(
    "equipment_day_base",
    "SELECT e.*, coalesce(s.n_paradas, 0) AS n_paradas, coalesce(s.horas_parada, 0) AS horas_parada,"
    " coalesce(s.n_paradas_no_plan, 0) AS n_paradas_no_plan,"
    " coalesce(m.n_mantenimientos, 0) AS n_mantenimientos,"
    " coalesce(m.horas_mantenimiento, 0) AS horas_mantenimiento,"
    " coalesce(m.coste_mantenimiento_eur, 0) AS coste_mantenimiento_eur,"
    " coalesce(d.n_desvios, 0) AS n_desvios, coalesce(d.desviacion_abs_media, 0) AS desviacion_abs_media,"
    " coalesce(d.impacto_calidad_sum, 0) AS impacto_calidad_sum,"
    " avg(e.consumo_kwh) OVER (PARTITION BY e.tipo_equipo) AS media_tipo"
    " FROM energy_equipment_day e LEFT JOIN stop_equipment_day s USING (fecha, equipo_id)"
    " LEFT JOIN care_equipment_day m USING (fecha, equipo_id)"
    " LEFT JOIN deviation_equipment_day d USING (fecha, equipo_id)",
)
define(
    "int_equipment_day",
    "SELECT *, 1 - horas_parada / 24 AS disponibilidad_proxy,"
    " CASE WHEN media_tipo > 0 THEN consumo_kwh / media_tipo END AS consumo_relativo_tipo,"
    " 0.35::DOUBLE * horas_parada + 0.25::DOUBLE * n_desvios + 2::DOUBLE * (1 - eficiencia_nominal)"
    " + 0.2::DOUBLE * criticidad_equipo AS riesgo_equipo_proxy FROM equipment_day_base",
)
define(
    "mart_equipment",
    "SELECT *, 0.35::DOUBLE * coalesce(consumo_relativo_tipo, 0) + 0.25::DOUBLE * horas_parada"
    " + 0.2::DOUBLE * n_desvios + 0.2::DOUBLE * criticidad_equipo AS equipment_efficiency_risk_index"
    " FROM int_equipment_day",
)
EQUIPMENT_DAY = (
    "fecha planta_id linea_id equipo_id tipo_equipo subsistema criticidad_equipo eficiencia_nominal~"
    " consumo_kwh~ factor_carga_prom~ coste_energia_eur~ demanda_kw_media~ n_paradas horas_parada~"
    " n_paradas_no_plan n_mantenimientos horas_mantenimiento~ coste_mantenimiento_eur~ n_desvios"
    " desviacion_abs_media~ impacto_calidad_sum~ disponibilidad_proxy~ consumo_relativo_tipo~"
    " riesgo_equipo_proxy~"
)


@query("equipment_day", final("int_equipment_day", EQUIPMENT_DAY))
def equipment_day(spark, sf):
    return Layers(spark, sf).equipment_day()


@query(
    "equipment_efficiency_risk",
    final(
        "(SELECT *, CASE WHEN equipment_efficiency_risk_index >= 8 THEN 'MuyAlto'"
        " WHEN equipment_efficiency_risk_index >= 5 THEN 'Alto'"
        " WHEN equipment_efficiency_risk_index >= 3 THEN 'Medio' ELSE 'Bajo' END AS risk_band,"
        " avg(equipment_efficiency_risk_index) OVER (PARTITION BY equipo_id ORDER BY fecha"
        " ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS trend_deterioro_7d FROM mart_equipment)",
        EQUIPMENT_DAY + " equipment_efficiency_risk_index~ risk_band trend_deterioro_7d~",
    ),
)
def equipment_efficiency_risk(spark, sf):
    return marts.equipment_efficiency_risk(Layers(spark, sf).stored("mart_equipment_day"))


# --- line-shift, line-day, plant-week -------------------------------------------------------
define(
    "hours_of_shift",
    "SELECT fecha, turno, linea_id, sum(consumo_kwh) AS consumo_kwh_shift,"
    " sum(coste_energia_eur) AS coste_energia_shift_eur, sum(emisiones_co2e_kg) AS emisiones_shift_kg,"
    " avg(sec_kwh_ton) AS sec_shift_kwh_ton, sum(n_desvios)::BIGINT AS n_desvios_shift,"
    " sum(n_paradas)::BIGINT AS n_paradas_shift, sum(horas_parada) AS horas_parada_shift,"
    " avg(perdida_total_proxy_eur) * 8 AS perdida_proxy_shift_eur FROM int_line_hour GROUP BY ALL",
)
define(
    "int_line_shift",
    "SELECT p.*, l.familia_proceso, coalesce(h.consumo_kwh_shift, 0) AS consumo_kwh_shift,"
    " coalesce(h.coste_energia_shift_eur, 0) AS coste_energia_shift_eur,"
    " coalesce(h.emisiones_shift_kg, 0) AS emisiones_shift_kg,"
    " coalesce(h.sec_shift_kwh_ton, 0) AS sec_shift_kwh_ton,"
    " coalesce(h.n_desvios_shift, 0) AS n_desvios_shift, coalesce(h.n_paradas_shift, 0) AS n_paradas_shift,"
    " coalesce(h.horas_parada_shift, 0) AS horas_parada_shift,"
    " coalesce(h.perdida_proxy_shift_eur, 0) AS perdida_proxy_shift_eur,"
    " CASE WHEN p.horas_planificadas > 0 THEN p.horas_operativas / p.horas_planificadas END AS availability_shift,"
    " 0.45::DOUBLE * coalesce(h.sec_shift_kwh_ton, 0) + 0.25::DOUBLE * p.scrap_pct"
    " + 0.2::DOUBLE * coalesce(h.horas_parada_shift, 0)"
    " + 0.1::DOUBLE * coalesce(h.n_desvios_shift, 0) AS shift_variance_proxy"
    " FROM produccion_turno p LEFT JOIN hours_of_shift h"
    " ON h.fecha = p.fecha AND h.turno = p.turno AND h.linea_id = p.linea_id"
    " LEFT JOIN lineas_proceso l ON l.linea_id = p.linea_id",
)
LINE_SHIFT = (
    "fecha turno planta_id linea_id familia_proceso producto_familia unidades_producidas"
    " toneladas_producidas_proxy~ horas_planificadas~ horas_operativas~ scrap_pct~ reproceso_pct~"
    " velocidad_media_proceso~ utilization_rate~ consumo_kwh_shift~ coste_energia_shift_eur~"
    " emisiones_shift_kg~ sec_shift_kwh_ton~ n_desvios_shift n_paradas_shift horas_parada_shift~"
    " perdida_proxy_shift_eur~ availability_shift~ shift_variance_proxy~"
)


@query("line_shift", final("int_line_shift", LINE_SHIFT, 3), digits=3)
def line_shift(spark, sf):
    return Layers(spark, sf).line_shift()


define(
    "mart_line",
    "SELECT h.fecha, h.planta_id, h.linea_id, h.familia_proceso,"
    " sum(coalesce(h.toneladas_equivalentes_hora, 0)) AS production_volume_ton,"
    " avg(h.utilization_rate) AS utilization_rate, avg(h.sec_kwh_ton) AS sec_kwh_ton,"
    " avg(l.intensidad_energetica_objetivo) AS sec_target_kwh_ton,"
    " avg(h.coste_energia_por_unidad) AS cost_energy_per_unit, sum(h.coste_energia_eur) AS cost_energy_total,"
    " sum(h.emisiones_co2e_kg) AS emissions_kg,"
    " avg(h.horas_operativas / nullif(h.horas_planificadas, 0)) AS availability_rate,"
    " avg(1 - h.scrap_pct / 100) AS quality_rate_proxy,"
    " avg((1 - h.scrap_pct / 100) * coalesce(h.utilization_rate, 0)"
    " * coalesce(h.horas_operativas / nullif(h.horas_planificadas, 0), 0)) AS oee_synthetic,"
    " sum(h.n_desvios)::BIGINT AS n_desvios, sum(h.n_paradas)::BIGINT AS n_paradas,"
    " sum(h.horas_parada) AS horas_parada, sum(h.perdida_total_proxy_eur) AS loss_value_proxy_eur"
    " FROM int_line_hour h JOIN lineas_proceso l USING (linea_id) GROUP BY ALL",
)


@query(
    "line_energy_performance",
    final(
        "(SELECT *, sec_kwh_ton - sec_target_kwh_ton AS sec_gap,"
        " CASE WHEN production_volume_ton > 0 THEN loss_value_proxy_eur / production_volume_ton END"
        " AS loss_value_per_ton FROM mart_line)",
        "fecha planta_id linea_id familia_proceso production_volume_ton~ utilization_rate~ sec_kwh_ton~"
        " sec_target_kwh_ton~ sec_gap~ cost_energy_total~ cost_energy_per_unit~ emissions_kg~"
        " availability_rate~ quality_rate_proxy~ oee_synthetic~ n_desvios n_paradas horas_parada~"
        " loss_value_proxy_eur~ loss_value_per_ton~",
        3,
    ),
    digits=3,
)
def line_energy_performance(spark, sf):
    return marts.line_energy_performance(Layers(spark, sf).mart_line_day())


define(
    "mart_week",
    "SELECT date_trunc('week', fecha)::DATE AS semana, planta_id, sum(production_volume_ton) AS production_volume_ton,"
    " avg(sec_kwh_ton) AS sec_kwh_ton, avg(oee_synthetic) AS oee_synthetic,"
    " avg(availability_rate) AS availability_rate, sum(cost_energy_total) AS cost_energy_total,"
    " sum(emissions_kg) AS emissions_kg, sum(loss_value_proxy_eur) AS loss_value_proxy_eur,"
    " sum(n_paradas)::BIGINT AS n_paradas, sum(n_desvios)::BIGINT AS n_desvios FROM mart_line GROUP BY ALL",
)


@query(
    "plant_week",
    final(
        "mart_week",
        "semana planta_id production_volume_ton~ sec_kwh_ton~ oee_synthetic~ availability_rate~"
        " cost_energy_total~ emissions_kg~ loss_value_proxy_eur~ n_paradas n_desvios",
        2,
    ),
    digits=2,
)
def plant_week(spark, sf):
    return marts.mart_plant_week(Layers(spark, sf).stored("mart_line_day"))


@query(
    "shift_operational_variance",
    final(
        "(SELECT *, toneladas_producidas_proxy AS throughput_ton,"
        " avg(sec_shift_kwh_ton) OVER (PARTITION BY linea_id, turno) AS sec_promedio_turno_linea,"
        " avg(scrap_pct) OVER (PARTITION BY linea_id, turno) AS scrap_promedio_turno_linea"
        " FROM int_line_shift)",
        "fecha turno planta_id linea_id familia_proceso throughput_ton~ sec_shift_kwh_ton~ scrap_pct~"
        " reproceso_pct~ n_desvios_shift n_paradas_shift horas_parada_shift~ perdida_proxy_shift_eur~"
        " shift_variance_proxy~ availability_shift~ utilization_rate~ sec_promedio_turno_linea~"
        " scrap_promedio_turno_linea~",
        3,
    ),
    digits=3,
)
def shift_operational_variance(spark, sf):
    return marts.shift_operational_variance(Layers(spark, sf).stored("line_shift"))


# --- causes, value pool, indicators ---------------------------------------------------------
define(
    "cause_month",
    "SELECT s.*, coalesce(e.kg, 0) AS emisiones_asociadas_kg, 0.5::DOUBLE * s.impacto_produccion_proxy"
    " + 0.3::DOUBLE * s.impacto_energia_proxy + 20::DOUBLE * s.horas_parada AS loss_root_cause_score FROM ("
    "SELECT date_trunc('month', fecha_inicio)::TIMESTAMP AS periodo, planta_id, linea_id, causa_parada,"
    " count(*) AS n_eventos, sum(duracion_horas) AS horas_parada,"
    " sum(impacto_produccion_proxy) AS impacto_produccion_proxy,"
    " sum(impacto_energia_proxy) AS impacto_energia_proxy FROM paradas GROUP BY ALL) s LEFT JOIN ("
    "SELECT date_trunc('month', timestamp)::TIMESTAMP AS periodo, planta_id, linea_id,"
    " sum(emisiones_co2e_kg) AS kg FROM emission_hours GROUP BY ALL) e USING (periodo, planta_id, linea_id)",
)


@query(
    "root_cause_summary",
    final(
        "(SELECT *, row_number() OVER (PARTITION BY periodo, planta_id"
        " ORDER BY loss_root_cause_score DESC, linea_id, causa_parada) AS ranking_causa FROM cause_month)",
        "periodo planta_id linea_id causa_parada n_eventos horas_parada~ impacto_produccion_proxy~"
        " impacto_energia_proxy~ emisiones_asociadas_kg~ loss_root_cause_score~ ranking_causa",
        3,
    ),
    digits=3,
)
def root_cause_summary(spark, sf):
    layers = Layers(spark, sf)
    return kpis.root_cause_summary(layers.role("paradas"), layers.emissions())


define(
    "value_pool",
    "SELECT i.*, c.capex_estimado, c.opex_impacto_proxy, c.ahorro_anual_estimado, c.payback_estimado_meses,"
    " c.criticidad_estrategica, c.horizonte_implantacion, c.riesgo_implantacion,"
    " 0.3::DOUBLE * i.impacto_esperado_energia_pct + 0.25::DOUBLE * i.impacto_esperado_oee_pct"
    " + 0.2::DOUBLE * i.impacto_esperado_emisiones_pct"
    " + CASE WHEN c.payback_estimado_meses > 0 THEN 15 / c.payback_estimado_meses ELSE 0 END"
    " + CASE WHEN i.quick_win_flag = 1 THEN 1 ELSE 0.5 END AS prioridad_compuesta"
    " FROM iniciativas_mejora i LEFT JOIN capex_proyectos c USING (iniciativa_id)",
)


@query(
    "improvement_value_pool",
    final(
        "value_pool",
        "iniciativa_id planta_id linea_id equipo_id categoria_iniciativa tipo_iniciativa"
        " descripcion_resumida impacto_esperado_energia_pct~ impacto_esperado_oee_pct~"
        " impacto_esperado_emisiones_pct~ dificultad_implementacion quick_win_flag capex_estimado~"
        " opex_impacto_proxy~ ahorro_anual_estimado~ payback_estimado_meses~ criticidad_estrategica"
        " horizonte_implantacion riesgo_implantacion prioridad_compuesta~",
    ),
)
def improvement_value_pool(spark, sf):
    return Layers(spark, sf).value_pool()


@query(
    "top_lines_by_loss",
    final(
        "(SELECT planta_id, linea_id, sum(loss_value_proxy_eur) AS perdida_total_eur FROM mart_line GROUP BY ALL)",
        "planta_id linea_id perdida_total_eur~",
        2,
        "ORDER BY perdida_total_eur DESC, planta_id, linea_id LIMIT 15",
    ),
    digits=2,
)
def top_lines_by_loss(spark, sf):
    return kpis.top_lines_by_loss(Layers(spark, sf).mart_line_day())


@query(
    "top_equipment_by_use",
    final(
        "(SELECT planta_id, linea_id, equipo_id, avg(consumo_relativo_tipo) AS consumo_relativo_prom,"
        " sum(coste_energia_eur) AS coste_energia_total FROM mart_equipment GROUP BY ALL"
        " ORDER BY 4 DESC NULLS LAST, 5 DESC, 1, 2, 3 LIMIT 15)",
        "planta_id linea_id equipo_id consumo_relativo_prom~ coste_energia_total~",
    ),
)
def top_equipment_by_use(spark, sf):
    return kpis.top_equipment_by_use(Layers(spark, sf).stored("mart_equipment_day"))


@query(
    "top_shifts_by_inefficiency",
    final(
        "(SELECT planta_id, turno, avg(sec_shift_kwh_ton) AS sec_promedio, avg(scrap_pct) AS scrap_promedio,"
        " avg(shift_variance_proxy) AS varianza_operativa FROM int_line_shift GROUP BY ALL"
        " ORDER BY 5 DESC NULLS LAST, 1, 2 LIMIT 10)",
        "planta_id turno sec_promedio~ scrap_promedio~ varianza_operativa~",
    ),
)
def top_shifts_by_inefficiency(spark, sf):
    return kpis.top_shifts_by_inefficiency(Layers(spark, sf).stored("line_shift"))


@query(
    "top_root_causes",
    final(
        "(SELECT periodo, planta_id, causa_parada, sum(loss_root_cause_score) AS score_total FROM cause_month"
        " GROUP BY ALL ORDER BY 4 DESC NULLS LAST, 1, 2, 3 LIMIT 20)",
        "periodo planta_id causa_parada score_total~",
        3,
    ),
    digits=3,
)
def top_root_causes(spark, sf):
    return kpis.top_root_causes(Layers(spark, sf).cause_months())


@query(
    "lines_with_lowest_oee",
    final(
        "(SELECT planta_id, linea_id, avg(oee_synthetic) AS oee_promedio FROM mart_line GROUP BY ALL"
        " ORDER BY 3 ASC NULLS LAST, 1, 2 LIMIT 15)",
        "planta_id linea_id oee_promedio~",
        6,
    ),
    digits=6,
)
def lines_with_lowest_oee(spark, sf):
    return kpis.lines_with_lowest_oee(Layers(spark, sf).stored("mart_line_day"))


@query(
    "lines_with_highest_sec",
    final(
        "(SELECT planta_id, linea_id, avg(sec_kwh_ton) AS sec_promedio FROM mart_line GROUP BY ALL"
        " ORDER BY 3 DESC NULLS LAST, 1, 2 LIMIT 15)",
        "planta_id linea_id sec_promedio~",
    ),
)
def lines_with_highest_sec(spark, sf):
    return kpis.lines_with_highest_sec(Layers(spark, sf).stored("mart_line_day"))


@query(
    "top_initiatives_by_value",
    final(
        "(SELECT * FROM value_pool ORDER BY prioridad_compuesta DESC NULLS LAST, iniciativa_id LIMIT 20)",
        "iniciativa_id planta_id linea_id tipo_iniciativa prioridad_compuesta~ ahorro_anual_estimado~"
        " payback_estimado_meses~",
    ),
)
def top_initiatives_by_value(spark, sf):
    return kpis.top_initiatives(Layers(spark, sf).value_pool())


@query(
    "best_capex_payback",
    final(
        "(SELECT * FROM value_pool WHERE tipo_iniciativa = 'CAPEXTransformacional'"
        " ORDER BY payback_estimado_meses ASC NULLS LAST, iniciativa_id LIMIT 15)",
        "iniciativa_id planta_id linea_id capex_estimado~ ahorro_anual_estimado~ payback_estimado_meses~",
    ),
)
def best_capex_payback(spark, sf):
    return kpis.best_capex_payback(Layers(spark, sf).value_pool())


@query(
    "avoidable_emissions",
    final(
        "(SELECT planta_id, linea_id, sum(emissions_kg) AS emisiones_actuales_kg,"
        " sum(emissions_kg) * 0.12 AS emisiones_evitables_proxy_kg FROM mart_line GROUP BY ALL)",
        "planta_id linea_id emisiones_actuales_kg~ emisiones_evitables_proxy_kg~",
        3,
    ),
    digits=3,
)
def avoidable_emissions(spark, sf):
    return kpis.avoidable_emissions(Layers(spark, sf).stored("mart_line_day"))


@query(
    "global_criticality",
    final(
        "(SELECT planta_id, linea_id, avg(loss_value_proxy_eur) AS loss_promedio, avg(sec_kwh_ton) AS sec_promedio,"
        " avg(oee_synthetic) AS oee_promedio,"
        " 0.45 * avg(loss_value_proxy_eur) / nullif(max(avg(loss_value_proxy_eur)) OVER (), 0)"
        " + 0.3 * avg(sec_kwh_ton) / nullif(max(avg(sec_kwh_ton)) OVER (), 0)"
        " + 0.25 * (1 - avg(oee_synthetic)) AS criticidad_global_score FROM mart_line GROUP BY 1, 2)",
        "planta_id linea_id loss_promedio~ sec_promedio~ oee_promedio~ criticidad_global_score~",
    ),
)
def global_criticality(spark, sf):
    return kpis.global_criticality(Layers(spark, sf).stored("mart_line_day"))


# --- intervals, calendars and event indices -------------------------------------------------
@query(
    "stop_hours_by_clock_hour",
    final(
        "(SELECT linea_id, hora, least(1.0::DOUBLE, sum(epoch_us(least(fecha_fin, hora + INTERVAL 1 HOUR))"
        " - epoch_us(greatest(fecha_inicio, hora))) / 3.6e9) AS fraccion FROM ("
        " SELECT linea_id, fecha_inicio, fecha_fin, unnest(generate_series(date_trunc('hour', fecha_inicio),"
        " fecha_fin, INTERVAL 1 HOUR)) AS hora FROM paradas WHERE fecha_fin > fecha_inicio)"
        " WHERE least(fecha_fin, hora + INTERVAL 1 HOUR) > greatest(fecha_inicio, hora) GROUP BY ALL)",
        "linea_id hora fraccion~",
        5,
    ),
    digits=5,
)
def stop_hours_by_clock_hour(spark, sf):
    return overlap_by_hour(Layers(spark, sf).role("paradas"), ["linea_id"], "fecha_inicio", "fecha_fin", "fraccion")


@query(
    "stop_hours_by_shift",
    final(
        "(SELECT linea_id, fecha, turno, least(8.0::DOUBLE, sum(epoch_us(least(fecha_fin, fin))"
        " - epoch_us(greatest(fecha_inicio, ini))) / 3.6e9) AS horas FROM ("
        " SELECT s.linea_id, s.fecha_inicio, s.fecha_fin, d.dia::DATE AS fecha, t.turno,"
        " d.dia + t.h * INTERVAL 1 HOUR AS ini, d.dia + (t.h + 8) * INTERVAL 1 HOUR AS fin"
        " FROM (SELECT *, unnest(generate_series(date_trunc('day', fecha_inicio) - INTERVAL 1 DAY,"
        " date_trunc('day', fecha_fin), INTERVAL 1 DAY)) AS dia FROM paradas) d"
        " CROSS JOIN (VALUES ('A', 6), ('B', 14), ('C', 22)) t(turno, h) JOIN paradas s USING (parada_id))"
        " WHERE least(fecha_fin, fin) > greatest(fecha_inicio, ini) GROUP BY ALL)",
        "linea_id fecha turno horas~",
        5,
    ),
    digits=5,
)
def stop_hours_by_shift(spark, sf):
    return overlap_by_shift(Layers(spark, sf).role("paradas"), ["linea_id"], "fecha_inicio", "fecha_fin", "horas")


define(
    "deviation_weight",
    "SELECT linea_id, timestamp, duracion_min, impacto_en_calidad_proxy, CASE severidad_desvio"
    " WHEN 'Bajo' THEN 1 WHEN 'Medio' THEN 2 WHEN 'Alto' THEN 3 ELSE 4 END AS sev FROM desvios_proceso",
)
define(
    "deviation_index_hour",
    "SELECT linea_id, date_trunc('hour', timestamp) AS timestamp, greatest(0, least(3.5::DOUBLE,"
    " 0.07 * sum(sev * ln(1 + duracion_min) * (0.75 + impacto_en_calidad_proxy)))) AS indice_desvio_hora"
    " FROM deviation_weight GROUP BY ALL",
)


@query(
    "deviation_index_by_hour_filled",
    final(
        "(SELECT s.linea_id, s.timestamp, coalesce(d.indice_desvio_hora, 0) AS indice_desvio_hora FROM ("
        " SELECT linea_id, unnest((SELECT generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)"
        " FROM deviation_index_hour)) AS timestamp FROM (SELECT DISTINCT linea_id FROM deviation_index_hour)) s"
        " LEFT JOIN deviation_index_hour d USING (linea_id, timestamp))",
        "linea_id timestamp indice_desvio_hora~",
    ),
)
def deviation_index_by_hour_filled(spark, sf):
    hourly = emissions.deviation_index_by_hour(Layers(spark, sf).role("desvios_proceso"))
    return fill_hours(hourly, ["linea_id"], "timestamp", ["indice_desvio_hora"])


@query(
    "deviation_index_by_shift",
    final(
        "(SELECT linea_id, timestamp::DATE AS fecha, " + SHIFT.format("timestamp") + " AS turno,"
        " greatest(0, least(4.0::DOUBLE, 0.18 * avg(sev) + 0.14 * ln(1 + count(*))"
        " + 0.06 * ln(1 + sum(sev * ln(1 + duracion_min) * (0.8 + impacto_en_calidad_proxy)))))"
        " AS indice_desvio_turno, count(*) AS num_desvios_turno FROM deviation_weight GROUP BY 1, 2, 3)",
        "linea_id fecha turno indice_desvio_turno~ num_desvios_turno",
    ),
)
def deviation_index_by_shift(spark, sf):
    return emissions.deviation_index_by_shift(Layers(spark, sf).role("desvios_proceso"))


@query(
    "line_energy_variants",
    final(
        "(SELECT familia_proceso, sum(consumo_kwh) / nullif(sum(toneladas_equivalentes_hora), 0) AS sec_ponderado,"
        " avg(sec_kwh_ton) AS sec_medio_horario, count(*) AS horas FROM int_line_hour"
        " WHERE toneladas_equivalentes_hora IS NOT NULL GROUP BY ALL)",
        "familia_proceso sec_ponderado~ sec_medio_horario~ horas",
    ),
)
def line_energy_variants(spark, sf):
    """Weighted SEC (total energy over total tonnes) next to the mean of the hourly ratios."""
    hours = Layers(spark, sf).stored("line_hour").where(F.col("toneladas_equivalentes_hora").isNotNull())
    return hours.groupBy("familia_proceso").agg(
        (F.sum("consumo_kwh") / F.nullif(F.sum("toneladas_equivalentes_hora"), F.lit(0.0))).alias("sec_ponderado"),
        F.avg("sec_kwh_ton").alias("sec_medio_horario"),
        F.count("*").alias("horas"),
    )
