"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query is built and run into the no-op sink, so
all of its columns are computed; the second of two runs counts, as classes and
code are loaded by the first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.plans.catalogue import all_queries  # noqa: E402
from tracewell.session import build_session  # noqa: E402

HEADLINE = (
    "agg_multi", "agg_time", "agg_time_fill", "agg_dynamic", "bucket_agg", "bucket_flatten", "dedupe_first", "latest_per_key",
    "shift_group", "shift_all", "sql_rank", "sql_frame", "join_inner", "join_asof", "join_range", "apply_window", "cidr_lpm",
    "hier_parents", "hier_children", "union_tagged", "topk", "json_flatten", "line_grep", "f_bytes", "f_ip_private", "validate_cols",
    "sql_groupby", "sql_cube", "sql_array", "step_chain", "sink_parquet", "stream_bucket",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds: dict[str, float] = {}
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in queries]
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf") or "0"
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, warm wall time", "value": total, "unit": "sec", "queries": seconds, "sf": float(scale)}))
    spark.stop()


if __name__ == "__main__":
    main()
