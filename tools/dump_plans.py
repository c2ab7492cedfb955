"""Run the headline queries and write their final adaptive plans (operator
tree only, expressions elided) to PLANS.md.

    python tools/dump_plans.py [sf_dir] [out.md]
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bench import HEADLINE  # noqa: E402
from tally.plans import catalog  # noqa: E402
from tally.plans.bindings import materialize  # noqa: E402
from tally.session import build_session, ensure_checkpoint_dir  # noqa: E402

KEEP = re.compile(r"(Scan parquet|FileScan|PushedFilters|HashAggregate|SortAggregate|Exchange|BroadcastHashJoin|"
                  r"SortMergeJoin|BroadcastNestedLoopJoin|ShuffledHashJoin|Window|WindowGroupLimit|TakeOrderedAndProject|"
                  r"ArrowEvalPython|BatchEvalPython|Subquery|ReusedExchange|Union|Expand|Generate|Sort \[|Filter|"
                  r"AQEShuffleRead|Limit|EmptyRelation|LocalTableScan)")


def tree(plan: str) -> list[str]:
    final = plan.split("== Initial Plan ==")[0]
    out = []
    for line in final.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        m = re.search(r"PushedFilters: \[[^\]]*\]", line)
        pushed = f"  {m.group(0)}" if m else ""
        line = re.sub(r"\[.*", "", line).rstrip() + pushed
        out.append(line[:160])
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out_md = sys.argv[2] if len(sys.argv) > 2 else os.path.join(ROOT, "PLANS.md")
    spark = build_session()
    tables = materialize(spark, sf_dir, ensure_checkpoint_dir(spark).rstrip("/") + "/plans", min_files=8)
    lines = ["# Final adaptive plans of the headline queries", "",
             f"Generated by `tools/dump_plans.py` on `{sf_dir}` (local[8], AQE on) after each query ran;",
             "operator tree only (expressions elided). Quantile queries show the plan that runs after",
             "the range-partitioned pairs were frozen in the checkpoint folder.", ""]
    for name in HEADLINE:
        df = catalog.QUERIES[name][0](tables)
        df.write.format("noop").mode("overwrite").save()
        lines += [f"## `{name}`", "", "```"] + tree(df._jdf.queryExecution().executedPlan().toString()) + ["```", ""]
    with open(out_md, "w") as f:
        f.write("\n".join(lines))
    spark.stop()


if __name__ == "__main__":
    main()
