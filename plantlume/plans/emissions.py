"""Emission estimates and event indices derived from the raw streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, hour_start, lookup, shift_day, shift_of

# Kg CO2e per kWh by energy source, and event severities.
SOURCE_FACTORS = {"Electricidad": 0.22, "GasNatural": 0.19, "Vapor": 0.24}
SEVERITY = {"Bajo": 1.0, "Medio": 2.0, "Alto": 3.0, "Critico": 4.0}


def estimated_emissions(energy: DataFrame, production: DataFrame, factors: dict[str, float] = SOURCE_FACTORS) -> DataFrame:
    """Emissions per hour, line and source, with the winter and summer shift of electricity."""
    hourly = energy.groupBy(
        hour_start("timestamp").alias("timestamp"), "planta_id", "linea_id", "fuente_energia"
    ).agg(F.sum("consumo_kwh").alias("consumo_kwh"))
    month = F.month("timestamp")
    season = F.when(month.isin(12, 1, 2), 0.03).when(month.isin(7, 8), -0.02).otherwise(0.0)
    electric = F.when(F.col("fuente_energia") == "Electricidad", season).otherwise(0.0)
    factor = clip(lookup("fuente_energia", factors).cast("double") + electric, 0.12, 0.34)
    tons = production.select("fecha", "turno", "planta_id", "linea_id", "toneladas_producidas_proxy")
    estimated = (
        hourly.withColumns(
            {
                "factor_emision_proxy": F.round(factor, 5),
                "fecha": shift_day("timestamp"),
                "turno": shift_of("timestamp"),
            }
        )
        .withColumn("emisiones_co2e_kg", F.round(F.col("consumo_kwh") * F.col("factor_emision_proxy"), 5))
        .join(tons, ["fecha", "turno", "planta_id", "linea_id"], "left")
    )
    per_ton = F.when(
        F.col("toneladas_producidas_proxy") > 0,
        F.col("emisiones_co2e_kg") / (F.col("toneladas_producidas_proxy") / 8.0),
    )
    return estimated.select(
        "timestamp",
        "planta_id",
        "linea_id",
        "fuente_energia",
        "consumo_kwh",
        "factor_emision_proxy",
        "emisiones_co2e_kg",
        F.coalesce(F.round(per_ton, 5), F.lit(0.0)).alias("intensidad_emisiones_por_unidad"),
    )


def deviation_index_by_hour(deviations: DataFrame) -> DataFrame:
    """Severity- and duration-weighted deviation load of a line per hour."""
    weight = (
        lookup("severidad_desvio", SEVERITY, 1.0)
        * F.log1p("duracion_min")
        * (0.75 + F.col("impacto_en_calidad_proxy"))
    )
    return deviations.groupBy("linea_id", hour_start("timestamp").alias("timestamp")).agg(
        clip(0.07 * F.sum(weight), 0.0, 3.5).alias("indice_desvio_hora")
    )


def deviation_index_by_shift(deviations: DataFrame, night_to_previous_day: bool = False) -> DataFrame:
    """Mean severity, number and weighted load of deviations per shift as one index."""
    severity = lookup("severidad_desvio", SEVERITY).cast("double")
    weight = severity * F.log1p("duracion_min") * (0.8 + F.col("impacto_en_calidad_proxy"))
    grouped = deviations.groupBy(
        "linea_id",
        shift_day("timestamp", night_to_previous_day).alias("fecha"),
        shift_of("timestamp").alias("turno"),
    ).agg(
        F.count("*").alias("num_desvios_turno"),
        F.avg(severity).alias("severidad_media"),
        F.sum(weight).alias("score_total"),
    )
    index = (
        0.18 * F.col("severidad_media")
        + 0.14 * F.log1p("num_desvios_turno")
        + 0.06 * F.log1p("score_total")
    )
    return grouped.select(
        "linea_id", "fecha", "turno", clip(index, 0.0, 4.0).alias("indice_desvio_turno"), "num_desvios_turno"
    )
