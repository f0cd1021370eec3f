"""Time the headline queries and print one JSON line.

Each query runs twice in one session and writes every row to a null sink; the
faster run counts, so the numbers are those of a warm session.
"""

from __future__ import annotations

import importlib
import json
import os
import sys
import time

HEADLINE = [
    "s6_transactions_since", "c1_clean_and_join", "c16_screen_documents", "m1_column_types_orders", "m10_number_customers",
    "j1_inner_many_to_one", "j8_dashboard_join", "a3_five_way_rollup", "a11_monthly_revenue", "a12_country_top10",
    "a13_kpis", "a15_numeric_summary", "a8_risk_level_counts", "a10_revenue_by_segment", "q1_quintile_codes",
    "f4_churn_rfm", "f5_revenue_rfm", "r1_risk_levels", "r4_churn_probability", "r6_balance_as_written",
    "r10_value_segments", "t3_retention_list", "t7_latest_run", "l10_roc_auc", "x1_run_totals", "x6_daily_quota",
    "x8_latest_dashboard", "x9_upsert", "w1_sessions", "w2_limit_attempts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    queries = importlib.import_module("__spark_entry__").queries()
    from patronage.session import build_session

    spark = build_session(
        "patronage-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    texts = sorted((n for n in queries if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))  # where their folder is present
    for name in HEADLINE + texts:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm, summed", "value": round(sum(seconds[n] for n in HEADLINE), 3), "unit": "sec",
        "text_queries_sum": round(sum(seconds[n] for n in texts), 3),
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
