"""Schemas of the raw tables. Column order and types are fixed values of the data model."""

from __future__ import annotations

# table -> (columns with types, grain)
RAW_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "plantas": (
        "planta_id string, nombre_planta string, tipo_planta string, region string,"
        " intensidad_energetica_base double, criticidad_operativa int,"
        " estrategia_mejora_actual string",
        ("planta_id",),
    ),
    "lineas_proceso": (
        "linea_id string, planta_id string, nombre_linea string, familia_proceso string,"
        " capacidad_nominal_hora double, oee_objetivo double,"
        " intensidad_energetica_objetivo double, criticidad_linea int",
        ("linea_id",),
    ),
    "equipos": (
        "equipo_id string, linea_id string, tipo_equipo string, subsistema string,"
        " fecha_instalacion date, potencia_nominal_kw double, disponibilidad_objetivo double,"
        " criticidad_equipo int, eficiencia_nominal double",
        ("equipo_id",),
    ),
    "consumos_energia_horarios": (
        "timestamp timestamp_ntz, planta_id string, linea_id string, equipo_id string,"
        " fuente_energia string, consumo_kwh double, demanda_kw double, factor_carga double,"
        " energia_reactiva_proxy double, coste_energia_proxy double, precio_energia_proxy double",
        ("timestamp", "equipo_id", "fuente_energia"),
    ),
    "produccion_turno": (
        "fecha date, turno string, planta_id string, linea_id string, producto_familia string,"
        " unidades_producidas bigint, toneladas_producidas_proxy double, horas_planificadas double,"
        " horas_operativas double, scrap_pct double, reproceso_pct double,"
        " velocidad_media_proceso double, utilization_rate double",
        ("fecha", "turno", "linea_id"),
    ),
    "desvios_proceso": (
        "desvio_id string, timestamp timestamp_ntz, planta_id string, linea_id string,"
        " equipo_id string, variable_proceso string, valor_observado double, valor_objetivo double,"
        " desviacion_pct double, severidad_desvio string, duracion_min double,"
        " causa_probable_proxy string, impacto_en_calidad_proxy double",
        ("desvio_id",),
    ),
    "paradas": (
        "parada_id string, fecha_inicio timestamp_ntz, fecha_fin timestamp_ntz, planta_id string,"
        " linea_id string, equipo_id string, tipo_parada string, planificada_flag int,"
        " causa_parada string, duracion_horas double, impacto_produccion_proxy double,"
        " impacto_energia_proxy double",
        ("parada_id",),
    ),
    "mantenimientos": (
        "mantenimiento_id string, fecha_inicio timestamp_ntz, fecha_fin timestamp_ntz,"
        " planta_id string, linea_id string, equipo_id string, tipo_mantenimiento string,"
        " programado_flag int, correctivo_flag int, horas_mantenimiento double,"
        " coste_mantenimiento_proxy double, resultado_mantenimiento string",
        ("mantenimiento_id",),
    ),
    "emisiones_estimadas": (
        "timestamp timestamp_ntz, planta_id string, linea_id string, fuente_energia string,"
        " consumo_kwh double, factor_emision_proxy double, emisiones_co2e_kg double,"
        " intensidad_emisiones_por_unidad double",
        ("timestamp", "linea_id", "fuente_energia"),
    ),
    "iniciativas_mejora": (
        "iniciativa_id string, planta_id string, linea_id string, equipo_id string,"
        " categoria_iniciativa string, tipo_iniciativa string, descripcion_resumida string,"
        " impacto_esperado_energia_pct double, impacto_esperado_oee_pct double,"
        " impacto_esperado_emisiones_pct double, dificultad_implementacion int, quick_win_flag int",
        ("iniciativa_id",),
    ),
    "capex_proyectos": (
        "proyecto_id string, iniciativa_id string, capex_estimado double, opex_impacto_proxy double,"
        " ahorro_anual_estimado double, payback_estimado_meses double, criticidad_estrategica int,"
        " horizonte_implantacion string, riesgo_implantacion string",
        ("proyecto_id",),
    ),
    "contexto_operativo": (
        "fecha date, turno string, planta_id string, demanda_operativa_indice double,"
        " mix_complejidad_indice double, temperatura_ambiente double,"
        " precio_energia_mercado_proxy double, tension_operativa_proxy double",
        ("fecha", "turno", "planta_id"),
    ),
    "benchmark_externo_proxy": (
        "periodo string, familia_proceso string, sec_referencia double, oee_referencia double,"
        " emisiones_referencia double, disponibilidad_referencia double",
        ("periodo", "familia_proceso"),
    ),
    "escenarios_mejora": (
        "fecha date, escenario string, precio_energia_shock double, presion_demanda_indice double,"
        " disponibilidad_personal_indice double, restriccion_operativa_indice double",
        ("fecha", "escenario"),
    ),
}

# Time columns by preference, for coverage figures.
TIME_COLUMNS = ("timestamp", "fecha", "fecha_inicio", "periodo")

WAIVERS = (
    "waiver_id string, issue_id string, motivo string, owner string, fecha_caducidad string,"
    " nivel_maximo_permitido_uso string, plan_cierre string, estado string"
)

CONTRACTS = (
    "version string, assets array<struct<name: string, grain: array<string>,"
    " required_columns: array<string>, invariants: array<string>>>"
)

METRIC_REGISTRY = (
    "version string, metric_version_set string, metrics array<struct<metric_id: string,"
    " business_name: string, technical_name: string, formula: string, grain: array<string>,"
    " unit: string, direction: string, owner: string>>"
)

SECTOR_PROFILE = (
    "profile_id string, profile_name string, profile_version string,"
    " common_core_version_compat string,"
    " taxonomy_mapping map<string, map<string, string>>,"
    " process_family_definitions map<string, struct<sector_process_group: string,"
    " benchmark_priority: string, kpi_focus: array<string>, operational_risk_focus: string>>,"
    " benchmark_set map<string, map<string, double>>,"
    " energy_logic string,"
    " emission_factors struct<multiplier_by_source: map<string, double>,"
    " carbon_cost_eur_ton_base: double>,"
    " maintenance_logic string,"
    " initiative_library struct<preferred_sequence: array<string>,"
    " mandatory_categories: array<string>>,"
    " criticality_logic string,"
    " constraints_by_sector map<string, double>,"
    " scenario_sensitivities map<string, double>,"
    " kpi_priority struct<kpi_weights: map<string, double>>,"
    " metric_caveats array<struct<metric_name: string, caveat: string, misuse_prevention: string>>,"
    " misuse_risks array<string>"
)

RELEASE_POLICY = (
    "version string, profiles map<string, struct<description: string, governance:"
    " struct<require_readiness_states: array<string>, require_publish_decisions: array<string>>>>"
)
