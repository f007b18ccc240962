"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from rootscope.queries.registry import all_queries
from rootscope.session import build_session

HEADLINE = [
    "trace_features",
    "trace_features_bulk",
    "call_edges",
    "metric_features",
    "metric_resample",
    "interpolate",
    "mask_message",
    "mine_templates",
    "mine_templates_documents",
    "log_features",
    "score_cases",
    "feedback_score",
    "dense_cube",
    "graph_conv",
    "reconstruct",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            # plan building without a call-site look-up per column
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # start the JVM, the Python workers and the file listing before the clock
    queries["trace_red"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in HEADLINE:
        start = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
