"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

The written layers (marts, features, scenario cube, priorities, selection) are timed under
``layer_*`` when they are built; the queries that read them are timed after that.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plantlume.session import build_session  # noqa: E402
from plantlume.workload import all_queries  # noqa: E402
from plantlume.workload.layers import Layers  # noqa: E402

LAYERS = (
    "line_hour", "equipment_day", "line_shift", "mart_line_day", "mart_equipment_day", "line_day_features",
    "equipment_day_features", "shift_features", "scored_line_days", "equipment_scores", "line_scores",
    "opportunity_scores", "scenario_table", "priorities", "selection", "prioritization",
)
QUERIES = (
    "line_hour", "equipment_day", "top_lines_by_loss", "equipment_efficiency_risk", "plant_week", "root_cause_summary",
    "global_criticality", "stop_hours_by_clock_hour", "score_stability", "scenario_ranking", "value_waterfall",
    "conflict_penalties", "weight_sensitivity", "portfolio_summary", "column_profile_of_lineitem",
    "quantity_quantiles_by_supplier", "supplier_daily_trend", "item_price_relative_to_supplier", "effective_issues",
    "readiness_summary", "recommendation_trace", "sector_line_days", "claim_patterns_in_documents",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "plantlume-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the executor threads
    times: dict[str, float] = {}
    layers = Layers(spark, sf_dir)
    for name in LAYERS:
        t0 = time.perf_counter()
        layers.stored(name)
        times[f"layer_{name}"] = round(time.perf_counter() - t0, 3)
    registered = all_queries()
    for name in QUERIES:
        t0 = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(
        json.dumps(
            {
                "metric": "operations intelligence, layers and headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
