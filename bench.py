"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

The three bound input tables are written once as parquet (timed as
``bind_tables``), the way a real deployment receives its application and
form tables; every query then runs against them.  Each query is executed
with the ``noop`` sink (the full plan runs, nothing is collected), once to
warm up and three times timed; the median is reported together with the
number of shuffle exchanges in the final adaptive plan.

Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tally.plans import catalog  # noqa: E402
from tally.plans.bindings import materialize  # noqa: E402
from tally.session import build_session, ensure_checkpoint_dir  # noqa: E402

HEADLINE = [
    "s1_state_conversion", "s2_sla_breach_groups", "s3_top_vendors", "s4_monthly_growth",
    "s4_monthly_growth_peak", "s5_grievance_summary", "s6_incentive_gap", "s7_rate_brackets", "s8_underserved",
    "s3_top_vendors_sql", "missing_profile", "summary_stats", "iqr_winsorize", "funnel", "stage_days_by",
    "resolution_table", "concentration_table", "gini", "pivot_mean", "payback_by_category", "state_summary",
    "vendor_summary", "violations_by_state", "enriched", "standardize_labels", "rule_evaluate",
    "mismatch_classify", "link_master", "city_fail_rate", "key_overlap", "oil_counts", "top_n_then_breakdown",
    "label_family", "group_stats",
]


def _shuffles(df) -> int:
    """Shuffle exchanges in the physical plan (broadcasts not counted)."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(1 for line in plan.splitlines()
               if re.search(r"(^|[^A-Za-z])Exchange ", line) and "BroadcastExchange" not in line)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    # Bound tables go under the reliable checkpoint folder (the shared
    # folder on a cluster; a scratch folder only when unset, as here).
    scratch = os.environ.get("BENCH_SCRATCH") or ensure_checkpoint_dir(spark).rstrip("/") + "/bench"

    t0 = time.perf_counter()
    tables = materialize(spark, sf_dir, scratch + "/bound", min_files=cpus)
    bind_s = time.perf_counter() - t0

    times, shuffles = {}, {}
    for name in HEADLINE:
        fn = catalog.QUERIES[name][0]
        fn(tables).write.format("noop").mode("overwrite").save()  # warm-up
        runs = []
        for _ in range(reps):
            t = time.perf_counter()
            df = fn(tables)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
        try:
            shuffles[name] = _shuffles(df)
        except Exception:  # noqa: BLE001 - plan string is best effort
            shuffles[name] = None

    sf_match = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf_match.group(1)) if sf_match else sf_dir,
        "bind_tables_sec": round(bind_s, 3),
        "shuffles": shuffles,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
