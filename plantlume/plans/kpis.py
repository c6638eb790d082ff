"""Cause summaries, the improvement value pool and the top-k indicator views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import month_start, or_zero, ratio, ratio_if_positive
from ..operators.joins import with_table_stats
from ..operators.ordering import top_rows, with_position


def root_cause_months(stops: DataFrame, emissions: DataFrame) -> DataFrame:
    """Stops by month, line and cause with the line's emissions of that month.

    The emissions of a line and month repeat on each of its causes by design.
    """
    causes = stops.groupBy(month_start("fecha_inicio").alias("periodo"), "planta_id", "linea_id", "causa_parada").agg(
        F.count("*").alias("n_eventos"),
        F.sum("duracion_horas").alias("horas_parada"),
        F.sum("impacto_produccion_proxy").alias("impacto_produccion_proxy"),
        F.sum("impacto_energia_proxy").alias("impacto_energia_proxy"),
    )
    carbon = emissions.groupBy(month_start("timestamp").alias("periodo"), "planta_id", "linea_id").agg(
        F.sum("emisiones_co2e_kg").alias("emisiones_asociadas_kg")
    )
    score = (
        0.50 * F.col("impacto_produccion_proxy")
        + 0.30 * F.col("impacto_energia_proxy")
        + 0.20 * F.col("horas_parada") * 100.0
    )
    return causes.join(carbon, ["periodo", "planta_id", "linea_id"], "left").withColumns(
        {"emisiones_asociadas_kg": or_zero("emisiones_asociadas_kg"), "loss_root_cause_score": score}
    )


def root_cause_summary(stops: DataFrame, emissions: DataFrame) -> DataFrame:
    """Cause months ranked by score within period and plant."""
    return with_position(
        root_cause_months(stops, emissions),
        "ranking_causa",
        [F.col("loss_root_cause_score").desc(), F.col("linea_id").asc(), F.col("causa_parada").asc()],
        ["periodo", "planta_id"],
    )


def improvement_value_pool(initiatives: DataFrame, capex: DataFrame) -> DataFrame:
    """Initiatives with their project figures and a composite priority."""
    project = capex.select(
        "iniciativa_id",
        "capex_estimado",
        "opex_impacto_proxy",
        "ahorro_anual_estimado",
        "payback_estimado_meses",
        "criticidad_estrategica",
        "horizonte_implantacion",
        "riesgo_implantacion",
    )
    priority = (
        0.30 * F.col("impacto_esperado_energia_pct")
        + 0.25 * F.col("impacto_esperado_oee_pct")
        + 0.20 * F.col("impacto_esperado_emisiones_pct")
        + 0.15 * ratio_if_positive(F.lit(100.0), "payback_estimado_meses", 0.0)
        + 0.10 * F.when(F.col("quick_win_flag") == 1, 10.0).otherwise(5.0)
    )
    # A well compressed file of many rows is read by a task or two; dealt out, the wide work above it is not theirs alone.
    dealt = initiatives.repartition("iniciativa_id")
    return dealt.join(project, "iniciativa_id", "left").withColumn("prioridad_compuesta", priority)


def _top(df: DataFrame, k: int, order: list[Column], *keys: str) -> DataFrame:
    return top_rows(df, [*order, *[F.col(c).asc_nulls_last() for c in keys]], k)


def top_lines_by_loss(line_days: DataFrame, k: int = 15) -> DataFrame:
    grouped = line_days.groupBy("planta_id", "linea_id").agg(F.sum("loss_value_proxy_eur").alias("perdida_total_eur"))
    return _top(grouped, k, [F.desc_nulls_last("perdida_total_eur")], "planta_id", "linea_id")


def top_equipment_by_use(equipment_mart: DataFrame, k: int = 15) -> DataFrame:
    grouped = equipment_mart.groupBy("planta_id", "linea_id", "equipo_id").agg(
        F.avg("consumo_relativo_tipo").alias("consumo_relativo_prom"),
        F.sum("coste_energia_eur").alias("coste_energia_total"),
    )
    order = [F.desc_nulls_last("consumo_relativo_prom"), F.desc_nulls_last("coste_energia_total")]
    return _top(grouped, k, order, "planta_id", "linea_id", "equipo_id")


def top_shifts_by_inefficiency(shifts: DataFrame, k: int = 10) -> DataFrame:
    grouped = shifts.groupBy("planta_id", "turno").agg(
        F.avg("sec_shift_kwh_ton").alias("sec_promedio"),
        F.avg("scrap_pct").alias("scrap_promedio"),
        F.avg("shift_variance_proxy").alias("varianza_operativa"),
    )
    return _top(grouped, k, [F.desc_nulls_last("varianza_operativa")], "planta_id", "turno")


def top_root_causes(cause_months: DataFrame, k: int = 20) -> DataFrame:
    grouped = cause_months.groupBy("periodo", "planta_id", "causa_parada").agg(
        F.sum("loss_root_cause_score").alias("score_total")
    )
    return _top(grouped, k, [F.desc_nulls_last("score_total")], "periodo", "planta_id", "causa_parada")


def lines_with_lowest_oee(line_days: DataFrame, k: int = 15) -> DataFrame:
    grouped = line_days.groupBy("planta_id", "linea_id").agg(F.avg("oee_synthetic").alias("oee_promedio"))
    return _top(grouped, k, [F.asc_nulls_last("oee_promedio")], "planta_id", "linea_id")


def lines_with_highest_sec(line_days: DataFrame, k: int = 15) -> DataFrame:
    grouped = line_days.groupBy("planta_id", "linea_id").agg(F.avg("sec_kwh_ton").alias("sec_promedio"))
    return _top(grouped, k, [F.desc_nulls_last("sec_promedio")], "planta_id", "linea_id")


def top_initiatives(value_pool: DataFrame, k: int = 20) -> DataFrame:
    view = value_pool.select(
        "iniciativa_id",
        "planta_id",
        "linea_id",
        "tipo_iniciativa",
        "prioridad_compuesta",
        "ahorro_anual_estimado",
        "payback_estimado_meses",
    )
    return _top(view, k, [F.desc_nulls_last("prioridad_compuesta")], "iniciativa_id")


def best_capex_payback(value_pool: DataFrame, k: int = 15) -> DataFrame:
    view = value_pool.where(F.col("tipo_iniciativa") == "CAPEXTransformacional").select(
        "iniciativa_id",
        "planta_id",
        "linea_id",
        "capex_estimado",
        "ahorro_anual_estimado",
        "payback_estimado_meses",
    )
    return _top(view, k, [F.asc_nulls_last("payback_estimado_meses")], "iniciativa_id")


def avoidable_emissions(line_days: DataFrame, share: float = 0.12) -> DataFrame:
    return (
        line_days.groupBy("planta_id", "linea_id")
        .agg(F.sum("emissions_kg").alias("emisiones_actuales_kg"))
        .withColumn("emisiones_evitables_proxy_kg", F.col("emisiones_actuales_kg") * share)
        .orderBy(F.desc_nulls_last("emisiones_evitables_proxy_kg"), "planta_id", "linea_id")
    )


def global_criticality(line_days: DataFrame) -> DataFrame:
    """Line averages relative to the worst line, combined into one score."""
    lines = line_days.groupBy("planta_id", "linea_id").agg(
        F.avg("loss_value_proxy_eur").alias("loss_promedio"),
        F.avg("sec_kwh_ton").alias("sec_promedio"),
        F.avg("oee_synthetic").alias("oee_promedio"),
    )
    worst = with_table_stats(lines, {"__loss": F.max("loss_promedio"), "__sec": F.max("sec_promedio")})
    score = (
        0.45 * ratio("loss_promedio", "__loss")
        + 0.30 * ratio("sec_promedio", "__sec")
        + 0.25 * (1.0 - F.col("oee_promedio"))
    )
    return (
        worst.withColumn("criticidad_global_score", score)
        .drop("__loss", "__sec")
        .orderBy(F.desc_nulls_last("criticidad_global_score"), "planta_id", "linea_id")
    )
