"""Write PLANS.md: the physical-plan skeleton of every registered query.

Usage: python tests/plan_report.py [sf_dir] > PLANS.md

For each entry, lists the operators that matter at scale (exchanges, joins,
aggregates, windows, limits, scans) in plan order, top-down, as printed by
``executedPlan`` (the initial AQE plan).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEP = re.compile(
    r"^(Exchange \w+|BroadcastExchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
    r"BroadcastNestedLoopJoin|CartesianProduct|Expand|WindowGroupLimit|Window|"
    r"TakeOrderedAndProject|HashAggregate|ObjectHashAggregate|SortAggregate|Generate|Union|"
    r"FileScan parquet|Scan ExistingRDD)")


def skeleton(plan: str) -> list[str]:
    out = []
    depths: list[int] = []
    for line in plan.splitlines():
        op = re.sub(r"^[\s:+\-*]*(\(\d+\) )?", "", line)
        indent = len(line) - len(op)
        m = KEEP.match(op)
        if not m:
            continue
        name = m.group(1)
        if name.startswith("Exchange"):
            detail = re.match(r"Exchange (\w+(?:\([^)]*\))?)", op).group(1)
            name = f"Exchange {re.sub(r'#[0-9]+L?', '', detail)}"
        elif name == "FileScan parquet":
            table = re.search(r"/([a-z_]+)\.parquet\]", op)
            name = f"Scan {table.group(1) if table else 'parquet'}"
        elif name in ("HashAggregate", "ObjectHashAggregate"):
            keys = re.search(r"keys=\[([^\]]*)\]", op)
            k = re.sub(r"#[0-9]+L?", "", keys.group(1)) if keys else ""
            name = f"{name}({k[:40]})"
        elif name == "WindowGroupLimit":
            name += " Partial" if op.rstrip().endswith("Partial") else " Final"
        while depths and depths[-1] >= indent:
            depths.pop()
        out.append("  " * len(depths) + name)
        depths.append(indent)
    return out


def main() -> None:
    from basketry.plans.registry import ENTRIES
    from basketry.session import local_session
    import __spark_entry__ as se

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(cores="4", shuffle_partitions=8, app="basketry-plans")
    qs = se.queries()
    print("# PLANS\n")
    print("Physical-plan skeletons of every registered query (initial adaptive plan, "
          f"top-down; fixture input `{sf}`, generated by `tests/plan_report.py`). "
          "The exact ranking operators label rows in place; their cut points are scalar "
          "subqueries of the plan, whose passes read the same exchanges when it runs. "
          "Dimension sides show as broadcasts only because "
          "Spark's size check admits them at this scale; larger dimensions plan as "
          "sort-merge joins.\n")
    for name, e in ENTRIES.items():
        plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        ops = skeleton(plan)
        n_ex = sum(1 for o in ops if o.strip().startswith("Exchange") and "SinglePartition" not in o)
        print(f"## {e.key} `{name}` — {n_ex} hash/range exchanges\n")
        print("```")
        print("\n".join(ops))
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
