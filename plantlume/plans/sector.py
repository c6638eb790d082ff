"""Sector profiles: one plan serves every profile, keyed by ``sector_profile_id``.

Profiles are small configuration documents; their maps and lists are exploded to tables and
joined by value, so the fact side is read once for all profiles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import clip, flag
from ..operators.joins import map_lookup
from ..operators.tables import latest_period, stack_rows

KEY = "sector_profile_id"
# What a complete profile holds.
REQUIRED = (
    "profile_id", "profile_name", "profile_version", "common_core_version_compat", "taxonomy_mapping",
    "process_family_definitions", "benchmark_set", "energy_logic", "emission_factors", "maintenance_logic",
    "initiative_library", "criticality_logic", "constraints_by_sector", "scenario_sensitivities", "kpi_priority",
    "metric_caveats", "misuse_risks",
)
TAXONOMY_DOMAINS = ("familia_proceso", "tipo_equipo", "categoria_iniciativa", "tipo_iniciativa", "fuente_energia")


def _id() -> Column:
    return F.col("profile_id").alias(KEY)


def validation_errors(profiles: DataFrame, core_version: str) -> DataFrame:
    """Problems per profile: missing keys, version mismatch, empty taxonomy domains."""
    problems = [F.when(F.col(k).isNull(), f"missing_key={k}") for k in REQUIRED if k in profiles.columns]
    problems += [F.lit(f"missing_key={k}") for k in REQUIRED if k not in profiles.columns]
    problems.append(
        F.when(~F.col("common_core_version_compat").eqNullSafe(F.lit(core_version)), "common_core_version_mismatch")
    )
    for d in TAXONOMY_DOMAINS:
        known = F.try_element_at("taxonomy_mapping", F.lit(d))
        problems.append(F.when(known.isNull() | (F.size(known) <= 0), f"taxonomy_mapping_incomplete={d}"))
    return profiles.select(_id(), F.explode(F.array_compact(F.array(*problems))).alias("error"))


def taxonomy(profiles: DataFrame) -> DataFrame:
    """(profile, domain, source value, target value)."""
    return profiles.select(_id(), F.explode("taxonomy_mapping").alias("domain", "m")).select(
        KEY, "domain", F.explode("m").alias("source_value", "target_value")
    )


def per_profile(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every row once per profile; the profile ids travel as an array and are exploded."""
    ids = profiles.agg(F.sort_array(F.collect_list("profile_id")).alias("ids")).scalar()
    return df.withColumn(KEY, F.explode(ids))


def _mapped(df: DataFrame, taxa: DataFrame, domain: str, source: str, out: str) -> DataFrame:
    mapping = taxa.where(F.col("domain") == domain)
    return map_lookup(df, mapping, {KEY: KEY, source: "source_value"}, "target_value", out, F.col(source))


def _factors(profiles: DataFrame, field: str, group: str | None = None) -> DataFrame:
    """(profile, key, value) of a numeric map, optionally nested below ``group``."""
    source = F.col(field) if group is None else F.try_element_at(field, F.lit(group))
    return profiles.select(_id(), F.explode(source).alias("key", "value"))


def _with_factor(df: DataFrame, factors: DataFrame, source: str, out: str, fallback: float) -> DataFrame:
    return map_lookup(df, factors, {KEY: KEY, source: "key"}, "value", out, F.lit(fallback))


def asset_hierarchy(profiles: DataFrame, plants: DataFrame, lines: DataFrame, equipment: DataFrame) -> DataFrame:
    """Equipment with its line and plant, in the words of every profile."""
    chain = equipment.select("equipo_id", "linea_id", "tipo_equipo", "subsistema").join(
        lines.select("linea_id", "planta_id", "nombre_linea", "familia_proceso"), "linea_id", "left"
    ).join(plants.select("planta_id", "nombre_planta", "tipo_planta", "region"), "planta_id", "left")
    taxa = taxonomy(profiles)
    named = _mapped(per_profile(chain, profiles), taxa, "familia_proceso", "familia_proceso", "sector_process_family")
    return _mapped(named, taxa, "tipo_equipo", "tipo_equipo", "sector_equipment_type")


def process_families(profiles: DataFrame) -> DataFrame:
    return profiles.select(_id(), F.explode("process_family_definitions").alias("familia_proceso", "d")).select(
        KEY,
        "familia_proceso",
        "d.sector_process_group",
        "d.benchmark_priority",
        F.array_join("d.kpi_focus", "|").alias("kpi_focus"),
        "d.operational_risk_focus",
    )


def sector_benchmark(profiles: DataFrame, benchmark: DataFrame, percent: bool = True) -> DataFrame:
    """Latest external benchmark adjusted by the profile; rates are kept within 0 and 1.

    With ``percent`` the OEE reference is given in percent and divided by 100 first.
    """
    latest = latest_period(benchmark, "periodo")
    if percent:
        latest = latest.withColumn("oee_referencia", F.col("oee_referencia") / 100.0)
    df = per_profile(latest, profiles)
    for field, out, fallback in (
        ("sec_multiplier_by_family", "sec_multiplier", 1.0),
        ("oee_shift_by_family", "oee_shift", 0.0),
        ("availability_shift_by_family", "availability_shift", 0.0),
        ("emissions_multiplier_by_family", "emissions_multiplier", 1.0),
    ):
        df = _with_factor(df, _factors(profiles, "benchmark_set", field), "familia_proceso", out, fallback)
    return df.withColumns(
        {
            "sec_referencia_sector": F.col("sec_referencia") * F.col("sec_multiplier"),
            "oee_referencia_sector": clip(F.col("oee_referencia") + F.col("oee_shift"), 0.0, 1.0),
            "disponibilidad_referencia_sector": clip(
                F.col("disponibilidad_referencia") + F.col("availability_shift"), 0.0, 1.0
            ),
            "emisiones_referencia_sector": F.col("emisiones_referencia") * F.col("emissions_multiplier"),
        }
    )


def sector_emission_factors(profiles: DataFrame, emissions: DataFrame) -> DataFrame:
    """Median emission factor per source with the profile's multiplier and carbon cost."""
    from ..operators.ordering import exact_quantiles

    base = exact_quantiles(emissions, "factor_emision_proxy", {"factor_emision_base": 0.5}, ["fuente_energia"])
    df = per_profile(base, profiles)
    factors = profiles.select(_id(), F.explode("emission_factors.multiplier_by_source").alias("key", "value"))
    costs = profiles.select(
        _id(), F.coalesce("emission_factors.carbon_cost_eur_ton_base", F.lit(85.0)).alias("carbon_cost_eur_ton")
    )
    return (
        _with_factor(df, factors, "fuente_energia", "factor_multiplier", 1.0)
        .join(costs, KEY)
        .withColumn("factor_emision_sector", F.col("factor_emision_base") * F.col("factor_multiplier"))
    )


def sector_initiatives(profiles: DataFrame, initiatives: DataFrame) -> DataFrame:
    """Initiatives in sector words with the mandatory flag and the preferred wave."""
    taxa = taxonomy(profiles)
    df = per_profile(
        initiatives.select("iniciativa_id", "categoria_iniciativa", "tipo_iniciativa", "quick_win_flag"), profiles
    )
    df = _mapped(df, taxa, "categoria_iniciativa", "categoria_iniciativa", "categoria_sectorial")
    df = _mapped(df, taxa, "tipo_iniciativa", "tipo_iniciativa", "tipo_sectorial")
    order = profiles.select(_id(), F.posexplode("initiative_library.preferred_sequence").alias("pos", "key")).select(
        KEY, "key", (F.col("pos") + 1).alias("value")
    )
    mandatory = profiles.select(_id(), F.explode("initiative_library.mandatory_categories").alias("key")).select(
        KEY, "key", F.lit(1).alias("value")
    )
    df = map_lookup(df, mandatory, {KEY: KEY, "categoria_iniciativa": "key"}, "value", "mandatory_by_profile", F.lit(0))
    return map_lookup(df, order, {KEY: KEY, "tipo_iniciativa": "key"}, "value", "recommended_wave_index", F.lit(99))


def profile_parameters(profiles: DataFrame) -> DataFrame:
    """Constraints, sensitivities and KPI weights as (profile, kind, name, value)."""
    sources = {
        "constraint": F.col("constraints_by_sector"),
        "sensitivity": F.col("scenario_sensitivities"),
        "kpi_weight": F.col("kpi_priority.kpi_weights"),
    }
    return stack_rows(
        *[
            profiles.select(_id(), F.lit(kind).alias("kind"), F.explode(m).alias("name", "value"))
            for kind, m in sources.items()
        ]
    )


def criticality_logic(profiles: DataFrame) -> DataFrame:
    """Criticality weights (top-level numbers) and nested multipliers as rows."""
    parsed = profiles.select(_id(), F.from_json("criticality_logic", "map<string, string>").alias("m"))
    entries = parsed.select(KEY, F.explode("m").alias("name", "text"))
    nested = F.col("text").startswith("{")
    flat = entries.where(~nested).select(
        KEY, F.lit("weights").alias("logic_group"), F.col("name").alias("logic_key"),
        F.col("text").cast("double").alias("logic_value"),
    )
    deep = entries.where(nested).select(
        KEY, F.col("name").alias("logic_group"),
        F.explode(F.from_json("text", "map<string, double>")).alias("logic_key", "logic_value"),
    )
    return flat.unionByName(deep)


def metric_caveats(profiles: DataFrame) -> DataFrame:
    return profiles.select(_id(), F.explode("metric_caveats").alias("c")).select(KEY, "c.*")


def misuse_risks(profiles: DataFrame) -> DataFrame:
    return profiles.select(_id(), F.posexplode("misuse_risks").alias("pos", "risk")).select(
        KEY,
        F.concat(F.upper(KEY), F.lit("_R"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("risk_id"),
        "risk",
    )


def sector_line_days(profiles: DataFrame, scored_days: DataFrame) -> DataFrame:
    """Line-days with sector family and adjusted SEC and emissions.

    ``sector_benchmark_gap`` is the adjusted level minus the benchmark gap, as defined upstream.
    """
    df = per_profile(scored_days, profiles)
    df = _mapped(df, taxonomy(profiles), "familia_proceso", "familia_proceso", "sector_process_family")
    df = _with_factor(df, _factors(profiles, "benchmark_set", "sec_multiplier_by_family"), "familia_proceso", "__sec", 1.0)
    df = _with_factor(
        df, _factors(profiles, "benchmark_set", "emissions_multiplier_by_family"), "familia_proceso", "__em", 1.0
    )
    adjusted = F.col("sec") * F.col("__sec")
    return df.select(
        KEY,
        "fecha",
        "planta_id",
        "linea_id",
        "familia_proceso",
        "sector_process_family",
        "sec",
        adjusted.alias("sec_sector_adjusted"),
        "sec_vs_benchmark",
        (adjusted - F.col("sec_vs_benchmark")).alias("sector_benchmark_gap"),
        "oee_synthetic",
        "availability_rate",
        "loss_value_proxy",
        "emissions_per_unit",
        (F.col("emissions_per_unit") * F.col("__em")).alias("emissions_per_unit_sector_adjusted"),
    )


def sector_investments(profiles: DataFrame, final: DataFrame) -> DataFrame:
    """Prioritised initiatives with sector words, budgets and adjusted downside."""
    taxa = taxonomy(profiles)
    df = _mapped(per_profile(final, profiles), taxa, "categoria_iniciativa", "categoria_iniciativa", "sector_category")
    df = _mapped(df, taxa, "tipo_iniciativa", "tipo_iniciativa", "sector_type")

    def number(field: str, key: str, fallback: float) -> Column:
        return F.coalesce(F.try_element_at(field, F.lit(key)), F.lit(fallback))

    numbers = profiles.select(
        _id(),
        number("constraints_by_sector", "capex_budget_default_eur", 0.0).alias("sector_capex_budget"),
        number("constraints_by_sector", "opex_budget_default_eur", 0.0).alias("sector_opex_budget"),
        number("scenario_sensitivities", "energy_price_beta", 1.0).alias("__energy"),
        number("scenario_sensitivities", "carbon_cost_beta", 1.0).alias("__carbon"),
    )
    return df.join(numbers, KEY).select(
        KEY,
        "iniciativa_id",
        "planta_id",
        "linea_id",
        "categoria_iniciativa",
        "sector_category",
        "tipo_iniciativa",
        "sector_type",
        "quick_win_flag",
        "improvement_priority_index",
        "decision_rule",
        "portfolio_wave",
        "selected_portfolio_flag",
        "annual_saving_proxy",
        "downside_adjusted_value",
        (F.col("downside_adjusted_value") * F.col("__energy") * (0.75 + 0.25 * F.col("__carbon"))).alias(
            "downside_adjusted_value_sector"
        ),
        "capex_estimado",
        "sector_capex_budget",
        "sector_opex_budget",
    )


def mapping_coverage(profiles: DataFrame, observed: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Share of the observed values of every domain that a profile maps."""
    seen = stack_rows(
        *[
            df.where(F.col(c).isNotNull()).select(F.lit(domain).alias("domain"), F.col(c).cast("string").alias("source_value")).distinct()
            for domain, (df, c) in observed.items()
        ]
    )
    known = taxonomy(profiles).select(KEY, "domain", "source_value", F.lit(1).alias("__hit"))
    return (
        per_profile(seen, profiles)
        .join(known, [KEY, "domain", "source_value"], "left")
        .groupBy(KEY, "domain")
        .agg(
            F.count("*").alias("observed_values"),
            F.count("__hit").alias("mapped_values"),
            (100.0 * F.avg(flag(F.col("__hit") == 1))).alias("mapping_coverage_pct"),
        )
    )


def profile_metadata(profiles: DataFrame, core_version: str) -> DataFrame:
    return profiles.select(
        _id(),
        "profile_name",
        "profile_version",
        "common_core_version_compat",
        F.lit(core_version).alias("common_core_version_active"),
        F.size("kpi_priority.kpi_weights").alias("kpi_priority_count"),
        F.size("metric_caveats").alias("metric_caveats_count"),
        F.size("misuse_risks").alias("misuse_risks_count"),
    )


def evidence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per profile of every sector table, one column per table."""
    counts = stack_rows(
        *[df.groupBy(KEY).agg(F.count("*").alias("n")).withColumn("t", F.lit(name)) for name, df in tables.items()]
    )
    return counts.groupBy(KEY).pivot("t", list(tables)).agg(F.max("n")).fillna(0)
