"""Per-query detail for the headline queries: wall time, rows out, bytes/rows read, shuffle bytes.

usage: python tools/bench_detail.py [sf_dir] > BENCH_DETAIL.md
Each query runs once warm through the noop sink under its own job group;
metrics come from Spark's event log, written to a fresh scratch folder.
"""

from __future__ import annotations

import glob
import json
import sys
import tempfile
import time
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _lines(path: str):
    """Event-log lines; Spark 4 writes rolling, zstd-compressed files by default."""
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as f:
            text = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(f), encoding="utf-8")
            yield from text
    else:
        with open(path) as f:
            yield from f


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="seqspark-eventlog-")
    from pyspark.sql import SparkSession

    from seqspark.plans import catalog
    from seqspark.session import get_session
    spark = (SparkSession.builder.master("local[8]").appName("seqspark-bench-detail")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark = get_session()   # applies the remaining defaults to the same session
    catalog.load_all()
    sc = spark.sparkContext
    wall, rows = {}, {}
    for name in catalog.HEADLINE:
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()   # warm-up
        sc.setJobGroup(f"q:{name}", name)
        t0 = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        wall[name] = time.perf_counter() - t0
        sc.setJobGroup("other", "other")
        rows[name] = df.count()
    spark.stop()

    metrics = defaultdict(lambda: defaultdict(int))
    stage_job = {}
    for path in sorted(glob.glob(f"{log_dir}/**/*", recursive=True)):
        if Path(path).is_dir() or "appstatus" in Path(path).name:
            continue
        for line in _lines(path):
            if True:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for st in ev.get("Stage IDs", []):
                        stage_job[st] = g
                elif kind == "SparkListenerTaskEnd":
                    g = stage_job.get(ev.get("Stage ID"))
                    if not g or not g.startswith("q:"):
                        continue
                    tm = ev.get("Task Metrics") or {}
                    m = metrics[g[2:]]
                    m["tasks"] += 1
                    m["input_bytes"] += (tm.get("Input Metrics") or {}).get("Bytes Read", 0)
                    m["input_rows"] += (tm.get("Input Metrics") or {}).get("Records Read", 0)
                    sw = tm.get("Shuffle Write Metrics") or {}
                    m["shuffle_write_bytes"] += sw.get("Shuffle Bytes Written", 0)
                    m["shuffle_write_rows"] += sw.get("Shuffle Records Written", 0)
                    m["spill_bytes"] += tm.get("Disk Bytes Spilled", 0)
    print(f"# Headline query detail ({sf}, local[8], one warm run; from the Spark event log)\n")
    print("Timed from query construction (includes checkpoint / materialisation jobs) to the end of a noop write.\n")
    print("| query | wall s | rows out | tasks | input rows | shuffle write MB | shuffle rows | spill MB |")
    print("|---|---|---|---|---|---|---|---|")
    for name in catalog.HEADLINE:
        m = metrics[name]
        print(f"| {name} | {wall[name]:.2f} | {rows[name]} | {m['tasks']} | "
              f"{m['input_rows']} | {m['shuffle_write_bytes'] / 1e6:.2f} | {m['shuffle_write_rows']} | "
              f"{m['spill_bytes'] / 1e6:.1f} |")


if __name__ == "__main__":
    main()
