"""Integration views and marts: line-hour, equipment-day, line-shift, line-day, plant-week.

Every event stream is aggregated to the target grain before it is joined, so joins never
multiply rows and a hot line is reduced on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import (
    bands,
    day,
    hour_start,
    or_zero,
    ratio_from,
    ratio_if_positive,
    shift_day,
    shift_of,
    week_start,
)
from ..operators.joins import pre_aggregated_fan_in, with_group_stats
from ..operators.rolling import Trailing, with_trailing


@dataclass(frozen=True)
class Prices:
    """Unit values of the loss proxy, EUR."""

    margin_per_ton: float = 480.0
    scrap_per_ton: float = 210.0
    carbon_per_ton: float = 85.0


SHIFT_HOURS = 8.0
MIN_TON_PER_HOUR = 0.50


def energy_by_line_hour(energy: DataFrame) -> DataFrame:
    return energy.groupBy(
        hour_start("timestamp").alias("timestamp_hour"), "planta_id", "linea_id"
    ).agg(
        F.sum("consumo_kwh").alias("consumo_kwh"),
        F.sum("coste_energia_proxy").alias("coste_energia_eur"),
        F.avg("factor_carga").alias("factor_carga_prom"),
        F.avg("precio_energia_proxy").alias("precio_energia_prom"),
    )


def emissions_by_line_hour(emissions: DataFrame) -> DataFrame:
    return emissions.groupBy(
        hour_start("timestamp").alias("timestamp_hour"), "planta_id", "linea_id"
    ).agg(
        F.sum("emisiones_co2e_kg").alias("emisiones_co2e_kg"),
        F.avg("factor_emision_proxy").alias("factor_emision_prom"),
    )


def deviations_by(deviations: DataFrame, *keys) -> DataFrame:
    return deviations.groupBy(*keys).agg(
        F.count("*").alias("n_desvios"),
        F.avg(F.abs("desviacion_pct")).alias("desv_abs_media_pct"),
        F.sum("impacto_en_calidad_proxy").alias("impacto_calidad_sum"),
    )


def stops_by(stops: DataFrame, *keys) -> DataFrame:
    unplanned = F.col("planificada_flag") == 0
    return stops.groupBy(*keys).agg(
        F.count("*").alias("n_paradas"),
        F.sum("duracion_horas").alias("horas_parada"),
        F.sum(F.when(unplanned, F.col("duracion_horas")).otherwise(0.0)).alias("horas_parada_no_plan"),
        F.count_if(unplanned).alias("n_paradas_no_plan"),
    )


def maintenance_by(maintenance: DataFrame, *keys) -> DataFrame:
    return maintenance.groupBy(*keys).agg(
        F.count("*").alias("n_mantenimientos"),
        F.sum("horas_mantenimiento").alias("horas_mantenimiento"),
        F.sum("coste_mantenimiento_proxy").alias("coste_mantenimiento_eur"),
    )


def line_hour(
    energy: DataFrame,
    emissions: DataFrame,
    deviations: DataFrame,
    stops: DataFrame,
    production: DataFrame,
    lines: DataFrame,
    prices: Prices = Prices(),
    night_to_previous_day: bool = False,
) -> DataFrame:
    """Energy per line and hour with emissions, deviations, stops and the shift's production."""
    keys = ["timestamp_hour", "planta_id", "linea_id"]
    hourly = pre_aggregated_fan_in(
        energy_by_line_hour(energy),
        [
            emissions_by_line_hour(emissions),
            deviations_by(deviations, hour_start("timestamp").alias("timestamp_hour"), "planta_id", "linea_id"),
            stops_by(stops, hour_start("fecha_inicio").alias("timestamp_hour"), "planta_id", "linea_id").drop(
                "n_paradas_no_plan"
            ),
        ],
        keys,
        zero=[
            "emisiones_co2e_kg",
            "factor_emision_prom",
            "n_desvios",
            "desv_abs_media_pct",
            "impacto_calidad_sum",
            "n_paradas",
            "horas_parada",
            "horas_parada_no_plan",
        ],
    ).withColumns(
        {
            "fecha": shift_day("timestamp_hour", night_to_previous_day),
            "turno": shift_of("timestamp_hour"),
        }
    )
    line_side = lines.select("linea_id", "familia_proceso", "capacidad_nominal_hora")
    shift_side = production.select(
        "fecha",
        "turno",
        "linea_id",
        (F.col("toneladas_producidas_proxy") / SHIFT_HOURS).alias("toneladas_equivalentes_hora"),
        (F.col("unidades_producidas") / SHIFT_HOURS).alias("unidades_equivalentes_hora"),
        "utilization_rate",
        "scrap_pct",
        "reproceso_pct",
        "horas_operativas",
        "horas_planificadas",
    )
    joined = hourly.join(line_side, "linea_id", "left").join(shift_side, ["fecha", "turno", "linea_id"], "left")
    tons = F.col("toneladas_equivalentes_hora")
    scrap = tons * (F.col("scrap_pct") / 100.0) * prices.scrap_per_ton
    lost_output = F.col("horas_parada") * F.col("capacidad_nominal_hora") * prices.margin_per_ton
    carbon = F.col("emisiones_co2e_kg") / 1000.0 * prices.carbon_per_ton
    return joined.select(
        "timestamp_hour",
        "fecha",
        "turno",
        "planta_id",
        "linea_id",
        "familia_proceso",
        "consumo_kwh",
        "coste_energia_eur",
        "factor_carga_prom",
        "precio_energia_prom",
        "emisiones_co2e_kg",
        "factor_emision_prom",
        "n_desvios",
        "desv_abs_media_pct",
        "impacto_calidad_sum",
        "n_paradas",
        "horas_parada",
        "horas_parada_no_plan",
        "toneladas_equivalentes_hora",
        "unidades_equivalentes_hora",
        "utilization_rate",
        "scrap_pct",
        "reproceso_pct",
        "horas_operativas",
        "horas_planificadas",
        ratio_from("consumo_kwh", "toneladas_equivalentes_hora", MIN_TON_PER_HOUR).alias("sec_kwh_ton"),
        ratio_if_positive("coste_energia_eur", "unidades_equivalentes_hora").alias("coste_energia_por_unidad"),
        (or_zero("coste_energia_eur") + or_zero(scrap) + or_zero(lost_output) + or_zero(carbon)).alias(
            "perdida_total_proxy_eur"
        ),
    )


def equipment_day(
    energy: DataFrame, stops: DataFrame, maintenance: DataFrame, deviations: DataFrame, equipment: DataFrame
) -> DataFrame:
    """Energy per equipment and day with stops, maintenance, deviations and use relative to type."""
    # Reduced to equipment-days before the dimension is joined: a busy equipment is combined on
    # the map side and the join sees one row per day.
    measured = energy.groupBy(day("timestamp").alias("fecha"), "planta_id", "linea_id", "equipo_id").agg(
        F.sum("consumo_kwh").alias("consumo_kwh"),
        F.avg("factor_carga").alias("factor_carga_prom"),
        F.sum("coste_energia_proxy").alias("coste_energia_eur"),
        F.avg("demanda_kw").alias("demanda_kw_media"),
    )
    daily = measured.join(
        equipment.select("equipo_id", "tipo_equipo", "subsistema", "criticidad_equipo", "eficiencia_nominal"),
        "equipo_id",
    )
    keys = ["fecha", "equipo_id"]
    stop_day = stops_by(stops, day("fecha_inicio").alias("fecha"), "equipo_id").drop("horas_parada_no_plan")
    care_day = maintenance_by(maintenance, day("fecha_inicio").alias("fecha"), "equipo_id")
    dev_day = deviations_by(deviations, day("timestamp").alias("fecha"), "equipo_id").withColumnRenamed(
        "desv_abs_media_pct", "desviacion_abs_media"
    )
    joined = pre_aggregated_fan_in(
        daily,
        [stop_day, care_day, dev_day],
        keys,
        zero=[
            "n_paradas",
            "horas_parada",
            "n_paradas_no_plan",
            "n_mantenimientos",
            "horas_mantenimiento",
            "coste_mantenimiento_eur",
            "n_desvios",
            "desviacion_abs_media",
            "impacto_calidad_sum",
        ],
    )
    compared = with_group_stats(joined, ["tipo_equipo"], {"__tipo": F.avg("consumo_kwh")})
    return compared.select(
        "fecha",
        "planta_id",
        "linea_id",
        "equipo_id",
        "tipo_equipo",
        "subsistema",
        "criticidad_equipo",
        "eficiencia_nominal",
        "consumo_kwh",
        "factor_carga_prom",
        "coste_energia_eur",
        "demanda_kw_media",
        "n_paradas",
        "horas_parada",
        "n_paradas_no_plan",
        "n_mantenimientos",
        "horas_mantenimiento",
        "coste_mantenimiento_eur",
        "n_desvios",
        "desviacion_abs_media",
        "impacto_calidad_sum",
        (1.0 - F.col("horas_parada") / 24.0).alias("disponibilidad_proxy"),
        ratio_if_positive("consumo_kwh", "__tipo").alias("consumo_relativo_tipo"),
        (
            0.35 * F.col("horas_parada")
            + 0.25 * F.col("n_desvios").cast("double")
            + 0.20 * (1.0 - F.col("eficiencia_nominal")) * 10.0
            + 0.20 * F.col("criticidad_equipo").cast("double")
        ).alias("riesgo_equipo_proxy"),
    )


def line_shift(line_hours: DataFrame, production: DataFrame, lines: DataFrame) -> DataFrame:
    """Shift production with the rolled-up hours of the shift."""
    rolled = line_hours.groupBy("fecha", "turno", "linea_id").agg(
        F.sum("consumo_kwh").alias("consumo_kwh_shift"),
        F.sum("coste_energia_eur").alias("coste_energia_shift_eur"),
        F.sum("emisiones_co2e_kg").alias("emisiones_shift_kg"),
        F.avg("sec_kwh_ton").alias("sec_shift_kwh_ton"),
        F.sum("n_desvios").alias("n_desvios_shift"),
        F.sum("n_paradas").alias("n_paradas_shift"),
        F.sum("horas_parada").alias("horas_parada_shift"),
        (F.avg("perdida_total_proxy_eur") * SHIFT_HOURS).alias("perdida_proxy_shift_eur"),
    )
    measures = [c for c in rolled.columns if c not in ("fecha", "turno", "linea_id")]
    joined = pre_aggregated_fan_in(production, [rolled], ["fecha", "turno", "linea_id"], zero=measures).join(
        lines.select("linea_id", "familia_proceso"), "linea_id", "left"
    )
    return joined.select(
        "fecha",
        "turno",
        "planta_id",
        "linea_id",
        "familia_proceso",
        "producto_familia",
        "unidades_producidas",
        "toneladas_producidas_proxy",
        "horas_planificadas",
        "horas_operativas",
        "scrap_pct",
        "reproceso_pct",
        "velocidad_media_proceso",
        "utilization_rate",
        *measures,
        ratio_if_positive("horas_operativas", "horas_planificadas").alias("availability_shift"),
        (
            0.45 * F.col("sec_shift_kwh_ton")
            + 0.25 * F.col("scrap_pct")
            + 0.20 * F.col("horas_parada_shift")
            + 0.10 * F.col("n_desvios_shift").cast("double")
        ).alias("shift_variance_proxy"),
    )


def mart_line_day(line_hours: DataFrame, lines: DataFrame) -> DataFrame:
    """Daily line performance; rates are averages of the hourly rates."""
    running = F.when(F.col("horas_planificadas") > 0, F.col("horas_operativas") / F.col("horas_planificadas"))
    good = 1.0 - F.col("scrap_pct") / 100.0
    targets = lines.select("linea_id", F.col("intensidad_energetica_objetivo").alias("sec_target_kwh_ton"))
    daily = line_hours.groupBy("fecha", "planta_id", "linea_id", "familia_proceso").agg(
        F.sum(or_zero("toneladas_equivalentes_hora")).alias("production_volume_ton"),
        F.avg("utilization_rate").alias("utilization_rate"),
        F.avg("sec_kwh_ton").alias("sec_kwh_ton"),
        F.avg("coste_energia_por_unidad").alias("cost_energy_per_unit"),
        F.sum("coste_energia_eur").alias("cost_energy_total"),
        F.sum("emisiones_co2e_kg").alias("emissions_kg"),
        F.avg(running).alias("availability_rate"),
        F.avg(good).alias("quality_rate_proxy"),
        F.avg(good * or_zero("utilization_rate") * or_zero(running)).alias("oee_synthetic"),
        F.sum("n_desvios").alias("n_desvios"),
        F.sum("n_paradas").alias("n_paradas"),
        F.sum("horas_parada").alias("horas_parada"),
        F.sum("perdida_total_proxy_eur").alias("loss_value_proxy_eur"),
    )
    return daily.join(targets, "linea_id")


def line_energy_performance(line_days: DataFrame) -> DataFrame:
    """Line-day view with the gap to target and the loss per tonne."""
    return line_days.select(
        "fecha",
        "planta_id",
        "linea_id",
        "familia_proceso",
        "production_volume_ton",
        "utilization_rate",
        "sec_kwh_ton",
        "sec_target_kwh_ton",
        (F.col("sec_kwh_ton") - F.col("sec_target_kwh_ton")).alias("sec_gap"),
        "cost_energy_total",
        "cost_energy_per_unit",
        "emissions_kg",
        "availability_rate",
        "quality_rate_proxy",
        "oee_synthetic",
        "n_desvios",
        "n_paradas",
        "horas_parada",
        "loss_value_proxy_eur",
        ratio_if_positive("loss_value_proxy_eur", "production_volume_ton").alias("loss_value_per_ton"),
    )


def mart_equipment_day(equipment_days: DataFrame) -> DataFrame:
    """Equipment-day mart with the efficiency-risk index."""
    index = (
        0.35 * or_zero("consumo_relativo_tipo")
        + 0.25 * or_zero("horas_parada")
        + 0.20 * F.col("n_desvios").cast("double")
        + 0.20 * F.col("criticidad_equipo").cast("double")
    )
    return equipment_days.withColumn("equipment_efficiency_risk_index", index)


def equipment_efficiency_risk(equipment_mart: DataFrame) -> DataFrame:
    """Risk band and trailing seven-day mean of the index per equipment."""
    index = "equipment_efficiency_risk_index"
    banded = equipment_mart.withColumn(
        "risk_band", bands(index, [(8, "MuyAlto"), (5, "Alto"), (3, "Medio")], "Bajo")
    )
    return with_trailing(
        banded, ["equipo_id"], ["fecha"], {"trend_deterioro_7d": Trailing("mean", index, 7)}
    )


def mart_plant_week(line_days: DataFrame) -> DataFrame:
    """Weekly plant rollup; weeks start on Monday."""
    return line_days.groupBy(day(week_start("fecha")).alias("semana"), "planta_id").agg(
        F.sum("production_volume_ton").alias("production_volume_ton"),
        F.avg("sec_kwh_ton").alias("sec_kwh_ton"),
        F.avg("oee_synthetic").alias("oee_synthetic"),
        F.avg("availability_rate").alias("availability_rate"),
        F.sum("cost_energy_total").alias("cost_energy_total"),
        F.sum("emissions_kg").alias("emissions_kg"),
        F.sum("loss_value_proxy_eur").alias("loss_value_proxy_eur"),
        F.sum("n_paradas").alias("n_paradas"),
        F.sum("n_desvios").alias("n_desvios"),
    )


def shift_operational_variance(shifts: DataFrame) -> DataFrame:
    """Shift rows next to the averages of their line and shift."""
    view = shifts.select(
        "fecha",
        "turno",
        "planta_id",
        "linea_id",
        "familia_proceso",
        F.col("toneladas_producidas_proxy").alias("throughput_ton"),
        "sec_shift_kwh_ton",
        "scrap_pct",
        "reproceso_pct",
        "n_desvios_shift",
        "n_paradas_shift",
        "horas_parada_shift",
        "perdida_proxy_shift_eur",
        "shift_variance_proxy",
        "availability_shift",
        "utilization_rate",
    )
    return with_group_stats(
        view,
        ["linea_id", "turno"],
        {
            "sec_promedio_turno_linea": F.avg("sec_shift_kwh_ton"),
            "scrap_promedio_turno_linea": F.avg("scrap_pct"),
        },
    )
