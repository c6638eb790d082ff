"""Lineage nodes and edges, recommendation traces and content versions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clip, fixed, lookup, top_contributions
from ..operators.joins import left_on
from ..operators.ordering import top_per_group
from ..operators.tables import fingerprint, literal_table, split_list, spread_distinct, stack_rows
from .portfolio import PRIORITY_WEIGHTS
from .scenario import base_scenario

# Which metric feeds which score, and which dataset feeds which output.
METRIC_TO_SCORE = (
    ("annual_saving_proxy", "energy_saving_score", "primary"),
    ("oee_synthetic", "operational_impact_score", "primary"),
    ("loss_value_proxy", "operational_impact_score", "secondary"),
    ("emissions_reduction_proxy", "emissions_reduction_score", "primary"),
    ("payback_months", "payback_score", "primary"),
    ("implementation_complexity_score", "implementation_feasibility_score", "primary"),
    ("execution_risk_score", "implementation_feasibility_score", "secondary"),
    ("strategic_alignment_score", "strategic_priority_score", "primary"),
    ("strategic_relevance_score", "strategic_priority_score", "secondary"),
    ("screening_var_95_npv", "uncertainty_index", "primary"),
)
SCORE_TO_DECISION = (
    ("improvement_priority_index", "decision_rule", 1),
    ("improvement_priority_index", "selected_portfolio_flag", 1),
    ("payback_score", "portfolio_wave", 2),
)
DATASETS = (
    ("mart_line_day", "semantic_mart", "int_line_hour", "Analytics Engineering"),
    ("line_day_features_scored", "scores", "mart_line_day;line_day_features", "Industrial Analytics"),
    ("scenario_table", "decision", "mart_line_day;stg_initiatives;stg_capex;stg_scenarios", "Decision Science"),
    (
        "investment_prioritization_final",
        "decision",
        "scenario_table;opportunity_priority_scores;scenario_dependencies;scenario_conflicts",
        "Strategy + PMO Analytics",
    ),
    (
        "executive_kpi_snapshot",
        "executive_serving",
        "line_day_features_scored;line_criticality_scores;investment_prioritization_final",
        "BI Lead",
    ),
)
OUTPUTS = (
    ("EXEC_SNAPSHOT_MAIN", "Executive KPI Snapshot", "line_day_features_scored;investment_prioritization_final"),
    ("EXEC_DASHBOARD_DECISION", "Dashboard Decision Block", "investment_prioritization_final;line_day_features_scored"),
    ("EXEC_ADVANCED_ANALYSIS_REPORT", "Advanced Analysis Report", "line_day_features_scored"),
)
READINESS_CONFIDENCE = {
    "committee-grade": 0.90,
    "committee-candidate": 0.80,
    "not-committee-grade": 0.60,
    "decision-support-only": 0.55,
    "screening-grade-only": 0.50,
    "analytically-acceptable": 0.65,
    "structurally-valid": 0.50,
    "publish-blocked": 0.35,
}
INDEX = "improvement_priority_index"


def metric_to_score(spark: SparkSession) -> DataFrame:
    return literal_table(spark, METRIC_TO_SCORE, "metric_name string, score_name string, relationship_type string")


def score_to_decision(spark: SparkSession) -> DataFrame:
    return literal_table(spark, SCORE_TO_DECISION, "score_name string, decision_output string, priority int")


def dataset_lineage(spark: SparkSession) -> DataFrame:
    return literal_table(spark, DATASETS, "dataset_name string, layer string, upstream_datasets string, owner string")


def executive_outputs(spark: SparkSession) -> DataFrame:
    return literal_table(spark, OUTPUTS, "output_id string, output_name string, source_datasets string")


def score_lineage(spark: SparkSession) -> DataFrame:
    """Formula and component metrics of every score of the priority index."""
    weights = literal_table(spark, list(PRIORITY_WEIGHTS.items()), "score_name string, weight double")
    metrics = metric_to_score(spark).groupBy("score_name").agg(
        F.array_join(F.sort_array(F.collect_list("metric_name")), ";").alias("component_metrics")
    )
    parts = weights.join(metrics, "score_name", "left").withColumn(
        "component_metrics", F.coalesce("component_metrics", F.lit(""))
    )
    total = spark.range(1).select(
        F.lit(INDEX).alias("score_name"), F.lit(1.0).alias("weight"),
        F.lit(";".join(PRIORITY_WEIGHTS)).alias("component_metrics"),
    )
    return parts.unionByName(total)


def metric_lineage(registry: DataFrame) -> DataFrame:
    """Registered metrics with the dataset that holds them."""
    home = {
        "production_volume": "line_day_features_scored",
        "oee_synthetic": "line_day_features_scored",
        "sec": "line_day_features_scored",
        "loss_value_proxy": "line_day_features_scored",
        "annual_saving_proxy": "investment_prioritization_final",
        "npv_risk_adjusted": "investment_prioritization_final",
        INDEX: "investment_prioritization_final",
    }
    return registry.select(
        F.col("technical_name").alias("metric_name"), "formula", "owner", "metric_version_set", "registry_version",
        lookup("technical_name", home).alias("canonical_dataset"),
    )


def nodes(final: DataFrame) -> DataFrame:
    """Registry of all dataset, metric, score, decision and output nodes."""
    spark = final.sparkSession

    def part(df: DataFrame, kind: str, name: str, layer: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"{kind}::"), F.col(name)).alias("node_id"), F.col(name).alias("node_name"),
            F.lit(kind).alias("node_type"), layer.alias("layer"),
        )

    metrics = metric_to_score(spark).select("metric_name").distinct()
    decisions = final.select(F.concat(F.lit("DEC_"), "iniciativa_id").alias("decision_id"))
    return stack_rows(
        part(dataset_lineage(spark), "dataset", "dataset_name", F.col("layer")),
        part(metrics, "metric", "metric_name", F.lit("semantic_layer")),
        part(score_lineage(spark), "score", "score_name", F.lit("scores")),
        part(decisions, "decision", "decision_id", F.lit("decision")),
        part(executive_outputs(spark), "output", "output_id", F.lit("executive_serving")),
    )


def edges(final: DataFrame) -> DataFrame:
    """Distinct parent-child edges between the nodes."""
    spark = final.sparkSession

    def edge(df: DataFrame, parent: Column, child: Column, kind: str) -> DataFrame:
        return df.select(parent.alias("parent_node_id"), child.alias("child_node_id"), F.lit(kind).alias("edge_type"))

    def named(kind: str, c: str) -> Column:
        return F.concat(F.lit(f"{kind}::"), F.col(c))

    datasets = split_list(dataset_lineage(spark), "upstream_datasets", "up")
    outputs = split_list(executive_outputs(spark), "source_datasets", "up")
    every_score = F.array(*[F.lit(s) for s in (*PRIORITY_WEIGHTS, INDEX)])
    # Decisions are told apart before each gets an edge per score, by tasks that hold a share of the ids.
    decisions = spread_distinct(final.select("iniciativa_id")).select(
        F.explode(every_score).alias("score_name"), F.concat(F.lit("DEC_"), "iniciativa_id").alias("decision_id")
    )
    few = stack_rows(
        edge(datasets, named("dataset", "up"), named("dataset", "dataset_name"), "dataset_flow"),
        edge(outputs, named("dataset", "up"), named("output", "output_id"), "dataset_flow"),
        edge(metric_to_score(spark), named("metric", "metric_name"), named("score", "score_name"), "metric_to_score"),
    ).distinct()
    return few.unionByName(edge(decisions, named("score", "score_name"), named("decision", "decision_id"), "score_to_decision"))


def dominant_drivers(k: int = 3) -> Column:
    """Strongest weighted components of the index as text."""
    return top_contributions({n: w * F.col(n) for n, w in PRIORITY_WEIGHTS.items()}, k)


def trade_off() -> Column:
    energy, operation, emission = (
        F.col(c) for c in ("energy_saving_score", "operational_impact_score", "emissions_reduction_score")
    )
    return (
        F.when(
            (F.col("capex_estimado") >= 700_000) & (F.col("payback_months") > 24),
            "alto_impacto_estructural_vs_time_to_value",
        )
        .when((F.col("payback_months") <= 18) & (energy >= 60), "captura_rapida_vs_impacto_estructural")
        .when((operation >= energy) & (operation >= emission), "continuidad_operativa_vs_ahorro_energetico")
        .when(emission >= F.greatest(energy, operation), "descarbonizacion_vs_retorno_financiero")
        .otherwise("equilibrio_multicriterio")
    )


def confidence(readiness: Column) -> Column:
    base = lookup(readiness, READINESS_CONFIDENCE, 0.50)
    success = F.coalesce(F.nullif(F.col("success_probability"), F.lit(0.0)), F.lit(0.6))
    doubt = F.coalesce(F.col("uncertainty_index"), F.lit(50.0)) / 100.0
    return clip(0.50 * base + 0.30 * success + 0.20 * (1.0 - doubt), 0.0, 1.0)


def recommendation_trace(
    final: DataFrame, scenarios: DataFrame, ranking: DataFrame, line_scores: DataFrame, readiness: str,
    caveats: DataFrame | None = None,
) -> DataFrame:
    """Every recommendation with drivers, trade-off, confidence, scenario and constraints.

    ``caveats`` is a one-row, one-column table with the open issue codes.
    """
    base = base_scenario(scenarios)
    figures = base.groupBy("iniciativa_id").agg(
        F.avg("success_probability").alias("__success"),
        F.max("dependency_penalty_pct").alias("dependency_penalty_pct"),
        F.max("conflict_penalty_pct").alias("conflict_penalty_pct"),
    )
    used = top_per_group(base, ["iniciativa_id"], [F.asc("macro_scenario"), F.asc("scenario_key")], 1).select(
        "iniciativa_id", F.col("macro_scenario").alias("scenario_used"), F.col("scenario_key").alias("scenario_key_used")
    )
    placed = ranking.groupBy("iniciativa_id").agg(
        F.avg("score_tradeoff").alias("score_tradeoff"), F.min("ranking").alias("scenario_ranking")
    )
    lines = line_scores.select("planta_id", "linea_id", "line_criticality_score")
    joined = (
        left_on(final, lines, ["planta_id", "linea_id"])
        .join(figures, "iniciativa_id", "left")
        .join(used, "iniciativa_id", "left")
        .join(placed, "iniciativa_id", "left")
        .withColumn("success_probability", F.col("__success"))
        .fillna(0.0, ["line_criticality_score"])
    )
    sure = confidence(F.lit(readiness))

    def points(c: str) -> Column:
        return fixed(F.coalesce(F.col(c), F.lit(0.0)), 2)

    active = F.concat(
        F.lit("dependency_penalty="), points("dependency_penalty_pct"),
        F.lit(";conflict_penalty="), points("conflict_penalty_pct"),
        F.lit(";constraint_reason="), F.col("portfolio_constraint_reason"),
    )
    codes = caveats.scalar() if caveats is not None else F.lit("none")
    return joined.select(
        F.col("iniciativa_id").alias("recommendation_id"),
        F.col("selected_portfolio_flag").alias("selected_flag"),
        "decision_rule",
        "portfolio_wave",
        F.col("portfolio_npv_contribution").alias("objective_contribution"),
        dominant_drivers().alias("dominant_drivers"),
        F.lit(";".join((*PRIORITY_WEIGHTS, INDEX))).alias("scores_involved"),
        active.alias("active_constraints"),
        "scenario_used",
        "scenario_key_used",
        trade_off().alias("trade_offs"),
        sure.alias("confidence_score"),
        F.when(sure >= 0.75, "high").when(sure >= 0.55, "medium").otherwise("low").alias("confidence_band"),
        codes.alias("caveat_codes"),
        "line_criticality_score",
        "score_tradeoff",
        "scenario_ranking",
    )


def decision_lineage(trace: DataFrame) -> DataFrame:
    return trace.select(
        F.concat(F.lit("DEC_"), "recommendation_id").alias("decision_id"),
        "recommendation_id",
        F.col("selected_flag"),
        F.col("decision_rule").alias("decision_output"),
        F.col("scores_involved").alias("upstream_scores"),
        F.col("active_constraints").alias("constraints_applied"),
        F.col("scenario_used").alias("scenario_reference"),
        "objective_contribution",
        "caveat_codes",
    )


def open_caveats(issues: DataFrame) -> DataFrame:
    """Codes of the open issues in one text."""
    codes = issues.where(F.col("effective_status").isin("WARN", "ERROR")).agg(
        F.array_join(F.sort_array(F.collect_set("issue_id")), ";").alias("codes")
    )
    return codes.select(F.when(F.col("codes") == "", "none").otherwise(F.col("codes")).alias("codes"))


def version_map(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Content fingerprint and row count per asset."""
    return stack_rows(*[fingerprint(df).withColumn("asset", F.lit(name)) for name, df in tables.items()])
