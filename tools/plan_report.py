"""Physical-plan facts for every registered query -> PLANS.md.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts operators in the physical plan of each catalogue query before it runs, and
exchanges and scans in the plan that adaptive execution ends with.  Plans
are taken at sf0.01, where the small genome tables are broadcast.  At scale
the planner and AQE choose from real sizes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seqlake.session import get_spark  # noqa: E402

PATTERNS = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning|Exchange SinglePartition",
    "broadcast_hash_joins": r"BroadcastHashJoin",
    "sort_merge_joins": r"SortMergeJoin",
    "nested_loop_or_cartesian": r"BroadcastNestedLoopJoin|CartesianProduct",
    "expand": r"\bExpand\b",
    "window_group_limit": r"WindowGroupLimit",
    "arrow_python_stages": r"MapInPandas|ArrowEvalPython|FlatMapGroupsInPandas",
    "row_python_udfs": r"BatchEvalPython",
    "pushed_filter_scans": r"PushedFilters: \[[^\]]+\]",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from seqlake.plans.catalogue import QUERIES

    spark = get_spark("local[8]", 8, extra={"spark.ui.enabled": "false"})
    print("# Physical plan report\n")
    print(f"Generated by `tools/plan_report.py` at `{sf_dir}`. The first columns count operators of the initial physical plan;")
    print("`final_exchanges` and `final_scans` count those of the plan that adaptive execution ended with (reused exchanges")
    print("are not counted again). Both include the round-robin spread of single-row-group driver tables.\n")
    cols = [*PATTERNS, "final_exchanges", "final_scans"]
    print("| query | " + " | ".join(cols) + " |")
    print("| --- |" + " --- |" * len(cols))
    totals = dict.fromkeys(cols, 0)
    for name, fn in sorted(QUERIES.items()):
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(p, plan)) for k, p in PATTERNS.items()}
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        counts["final_exchanges"] = len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|Round|Single)", final))
        counts["final_scans"] = len(re.findall(r"FileScan", final))
        for k, v in counts.items():
            totals[k] += v
        print(f"| {name} | " + " | ".join(str(counts[c]) for c in cols) + " |")
    print("| **total** | " + " | ".join(str(totals[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
