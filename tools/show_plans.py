"""Write condensed physical plans of the headline queries to docs/PLANS.md.

usage: python tools/show_plans.py [sf_dir]
Keeps the operator lines that matter for scale: scans (with ReadSchema and
pushed filters), exchanges, joins, aggregates, windows, generators, sorts.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NAMES = ["decisions", "training_set", "run_summary", "message_sequence", "rail_reasons", "tfidf_weights",
         "layer_breakdowns", "pending_queue", "macro_auc", "dedup_first"]
KEEP = ("Scan", "Exchange", "Join", "HashAggregate", "SortAggregate", "Window", "Generate", "Sort ", "TakeOrdered",
        "BroadcastExchange", "Union", "Expand", "LogicalRDD", "Filter")


def condensed(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        if any(k in line for k in KEEP):
            line = re.sub(r"#\d+L?", "", line)
            line = re.sub(r"\[plan_id=\d+\]", "", line)
            out.append(line.rstrip()[:230])
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from acurail.plans.queries import QUERIES
    from acurail.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16)
    lines = ["# Physical plans of the headline queries", "",
             f"Generated by `python tools/show_plans.py {sf_dir}` (AQE final plans are shown where a query was "
             "executed; scans list the columns actually read).", ""]
    for name in NAMES:
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines += [f"## {name}", "", "```"] + condensed(plan) + ["```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(path, "w") as fh:
        fh.write("\n".join(lines))
    print(path)


if __name__ == "__main__":
    main()
