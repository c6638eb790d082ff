"""Objects that several queries share.

As in the data model, the marts and the scenario cube are tables: they are written once per
session and state of the input files to the shared folder and read by everything above them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import diagnostics, emissions, features, kpis, marts, portfolio, scenario
from ..session import durable, inputs_of, is_stored
from .roles import SOURCES, role

_TABLES: dict[tuple, DataFrame] = {}


class Layers:
    """Lazy access to every object over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.inputs = inputs_of(spark, [f"{sf_dir}/{name}.parquet" for name in SOURCES])

    def role(self, name: str) -> DataFrame:
        return role(self.spark, self.sf_dir, name)

    def key(self, name: str) -> tuple:
        return self.spark.sparkContext.applicationId, self.sf_dir, self.inputs, name

    def stored(self, name: str) -> DataFrame:
        """The object ``name`` as a written table, built again once its input files have changed or its scope has ended."""
        key = self.key(name)
        if key not in _TABLES or not is_stored(_TABLES[key]):
            _TABLES[key] = durable(getattr(self, name)(), name)
        return _TABLES[key]

    def emissions(self) -> DataFrame:
        return emissions.estimated_emissions(self.role("consumos_energia_horarios"), self.role("produccion_turno"))

    def line_hour(self) -> DataFrame:
        return marts.line_hour(
            self.role("consumos_energia_horarios"),
            self.emissions(),
            self.role("desvios_proceso"),
            self.role("paradas"),
            self.role("produccion_turno"),
            self.role("lineas_proceso"),
        )

    def equipment_day(self) -> DataFrame:
        return marts.equipment_day(
            self.role("consumos_energia_horarios"),
            self.role("paradas"),
            self.role("mantenimientos"),
            self.role("desvios_proceso"),
            self.role("equipos"),
        )

    def line_shift(self) -> DataFrame:
        return marts.line_shift(
            self.stored("line_hour"), self.role("produccion_turno"), self.role("lineas_proceso")
        )

    def mart_line_day(self) -> DataFrame:
        return marts.mart_line_day(self.stored("line_hour"), self.role("lineas_proceso"))

    def mart_equipment_day(self) -> DataFrame:
        return marts.mart_equipment_day(self.stored("equipment_day"))

    def value_pool(self) -> DataFrame:
        return kpis.improvement_value_pool(self.role("iniciativas_mejora"), self.role("capex_proyectos"))

    def cause_months(self) -> DataFrame:
        return kpis.root_cause_months(self.role("paradas"), self.emissions())

    def line_day_features(self) -> DataFrame:
        return features.line_day_features(
            self.stored("mart_line_day"), self.role("lineas_proceso"), self.role("benchmark_externo_proxy")
        )

    def equipment_day_features(self) -> DataFrame:
        return features.equipment_day_features(self.stored("mart_equipment_day"), self.role("equipos"))

    def shift_features(self) -> DataFrame:
        return features.shift_features(self.stored("line_shift"), self.role("contexto_operativo"))

    def opportunity_features(self) -> DataFrame:
        return features.opportunity_features(self.stored("value_pool"), self.stored("line_day_features"))

    def scored_line_days(self) -> DataFrame:
        return diagnostics.scored_line_days(self.stored("line_day_features"))

    def equipment_scores(self) -> DataFrame:
        return diagnostics.equipment_anomaly_scores(self.stored("equipment_day_features"))

    def line_scores(self) -> DataFrame:
        return diagnostics.line_criticality(self.stored("scored_line_days"))

    def opportunity_scores(self) -> DataFrame:
        return diagnostics.opportunity_priority(self.opportunity_features())

    def line_baseline(self) -> DataFrame:
        return scenario.line_baseline(self.stored("mart_line_day"), self.role("lineas_proceso"))

    def macro_shocks(self) -> DataFrame:
        return scenario.macro_shocks(self.role("escenarios_mejora"))

    def scenario_table(self) -> DataFrame:
        return scenario.scenario_table(self.stored("value_pool"), self.line_baseline(), self.macro_shocks())

    def scenario_comparison(self) -> DataFrame:
        return scenario.initiative_comparison(self.stored("scenario_table"))

    def dependencies(self) -> DataFrame:
        return scenario.dependencies(self.stored("value_pool"))

    def priorities(self) -> DataFrame:
        return portfolio.priorities(self.stored("opportunity_scores"), self.stored("scenario_table"))

    def budgets(self) -> DataFrame:
        return portfolio.what_if_budgets(self.spark)

    def selection(self) -> DataFrame:
        return portfolio.select_portfolio(self.stored("priorities"), self.dependencies(), self.budgets())

    def prioritization(self) -> DataFrame:
        return portfolio.prioritization(
            self.stored("priorities"), self.stored("selection"), self.dependencies(), self.budgets()
        )

    def scenario_ranking(self) -> DataFrame:
        return scenario.scenario_ranking(self.scenario_comparison())

    def weight_sensitivity(self) -> DataFrame:
        return portfolio.weight_sensitivity(self.stored("priorities"))

    def priority_stability(self) -> DataFrame:
        return portfolio.priority_stability(self.stored("priorities"))

    def ranking_robustness(self) -> DataFrame:
        return portfolio.ranking_robustness(self.stored("priorities"))


class PlannedLayers(Layers):
    """Layers for a query that needs few columns of them, such as their counts.

    An object that isn't written yet is handed on as its plan, of which Catalyst keeps what the query needs; the
    value pool, which its readers meet several times, is written all the same.
    """

    def stored(self, name: str) -> DataFrame:
        if name == "value_pool" or is_stored(_TABLES.get(self.key(name))):
            return super().stored(name)
        return getattr(self, name)()
