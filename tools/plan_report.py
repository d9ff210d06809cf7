"""Write PLANS.md: the executed physical plan shape of every headline query.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
For each query: wall time (one warm run through the noop sink), number of
shuffles / reused shuffles, join strategies, sort vs hash aggregates, windows,
checkpoint reads, and the parquet scans with their ReadSchema / PushedFilters.
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seqspark.plans import catalog  # noqa: E402
from seqspark.session import get_session  # noqa: E402


def summary(plan: str) -> dict:
    scans = []
    for m in re.finditer(r"FileScan parquet [^\n]*", plan):
        line = m.group(0)
        loc = re.search(r"Location: \w+(?:\(\d+ paths?\))?\[([^\]]*)\]", line)
        rs = re.search(r"ReadSchema: (struct<[^>]*>)", line)
        pf = re.search(r"PushedFilters: (\[[^\]]*\])", line)
        table = Path(loc.group(1).split(",")[0]).name if loc else "?"
        scans.append(f"{table} {rs.group(1) if rs else ''} pushed={pf.group(1) if pf else '[]'}")
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)",
                                   plan)),
        "single_partition_shuffles": plan.count("Exchange SinglePartition"),
        "reused": plan.count("ReusedExchange"),
        "broadcasts": plan.count("BroadcastExchange"),
        "joins": {j: plan.count(j) for j in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
                                            "BroadcastNestedLoopJoin", "CartesianProduct") if j in plan},
        "aggregates": {a: len(re.findall(r"\b" + a + r"\(", plan))
                       for a in ("HashAggregate", "SortAggregate", "ObjectHashAggregate") if a in plan},
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "python": len(re.findall(r"MapInPandas|FlatMapGroupsInPandas|MapInArrow", plan)),
        "checkpoint_reads": plan.count("Scan ExistingRDD") + plan.count("LogicalRDD"),
        "scans": sorted(set(scans)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    catalog.load_all()
    print(f"# Executed plans of the headline queries ({sf}, local[8])\n")
    print("Generated by `tools/plan_report.py`. 'single-partition shuffles' are only over tables with a")
    print("proven bound (<= 5^k k-mers, T schedule rows, #partitions offsets); see README 'Design for scale'.\n")
    for name in catalog.HEADLINE:
        df = catalog.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        t0 = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        el = time.perf_counter() - t0
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        s = summary(plan)
        print(f"## {name} ({el:.2f} s)\n")
        for k, v in s.items():
            if k != "scans":
                print(f"* {k}: {v}")
        print("* scans:")
        for sc in s["scans"]:
            print(f"  * `{sc}`")
        print()


if __name__ == "__main__":
    main()
