"""Headline queries, timed: prints one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--conf spark.ui.showConsoleProgress=false pyspark-shell")

from sheetledger.plans.catalog import entries  # noqa: E402
from sheetledger.session import build_session  # noqa: E402

HEADLINE = [
    "top04_severity_then_cost", "agg11_multi_dim_counts", "top02_topn_merge", "joi06_overlay_join", "agg06_cost_summary",
    "agg12_quantity_rollup", "win02_effective_values", "win04_action_gap_median", "agg19_supported_vote", "agg21_witness_consensus",
    "agg18_majority_vote", "joi13_nearest_tolerance", "joi14_containment_join", "prj05_rule_dsl", "txt01_article_split", "txt08_checklist_screen",
    "agg39_recurrence", "str08_keyword_classify", "ret01_vector_topk", "evl06_prf_by_key", "agg26_entity_assembly", "ret05_connected_zones",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    runs = entries()
    runs["src01_table_scan"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engine
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        runs[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
