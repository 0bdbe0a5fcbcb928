"""Summarise the physical plan of every registered query (after execution, so AQE's final plan).

usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Counts per query: shuffles, broadcast joins, sort-merge joins, nested-loop joins, windows,
Python (pandas) operators, generated-code stages, and the columns read from each scanned table.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    final = plan.split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet \[([^\]]*)\][^\n]*?Location: InMemoryFileIndex\(\d+ paths?\)\[file:[^\]]*/(\w+)\.parquet",
                       final)
    reads = {}
    for cols, table in scans:
        reads.setdefault(table, set()).update(c.split("#")[0] for c in cols.split(","))
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", final)),
        "bhj": final.count("BroadcastHashJoin"),
        "smj": final.count("SortMergeJoin"),
        "nlj": final.count("NestedLoopJoin"),
        "window": len(re.findall(r"\bWindow(GroupLimit)? ", final)),
        "python": len(re.findall(r"FlatMap(Co)?GroupsInPandas|MapIn(?:Pandas|Arrow)|ArrowEvalPython|BatchEvalPython", final)),
        "codegen": len(set(re.findall(r"\*\((\d+)\)", final))),
        "reads": "; ".join(f"{t}({len(c)})" for t, c in sorted(reads.items())),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from footfall.session import build_session
    from footfall.testing.catalog import QUERIES
    spark = build_session("local[8]", 16)
    print("# Physical plans of the registered queries (AQE final plans)\n")
    print(f"Generated by `python tools/plan_summary.py {sf_dir}`. Columns: shuffles (exchanges), "
          "broadcast hash joins, sort-merge joins, nested-loop joins, window operators, pandas "
          "operators, whole-stage-codegen stages, and tables scanned (number of columns read).\n")
    print("| query | shuffles | BHJ | SMJ | NLJ | window | pandas | codegen stages | scans (columns read) |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, q in QUERIES.items():
        df = q(spark, sf_dir)
        df.collect()   # runs this DataFrame's own query execution, so AQE's final plan is available
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['shuffles']} | {s['bhj']} | {s['smj']} | {s['nlj']} | {s['window']} | "
              f"{s['python']} | {s['codegen']} | {s['reads']} |", flush=True)


if __name__ == "__main__":
    main()
