"""Command line: python tests/check.py sf0.01 [key ...]"""

import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")
from compare import compare, data_dir  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from rootscope.queries.registry import all_oracles, all_queries  # noqa: E402

if __name__ == "__main__":
    sf, keys = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = all_oracles()
    for key, query in all_queries().items():
        if keys and not any(k in key for k in keys):
            continue
        start = time.time()
        try:
            if key in oracles:
                problems = compare(spark, query, oracles[key], data_dir(sf), strict=True)
                note = "ok" if not problems else "DIFF"
            else:
                rows = query(spark, data_dir(sf)).count()
                problems, note = [], f"rows {rows}"
        except Exception as e:  # noqa: BLE001
            problems, note = [f"{type(e).__name__} {e}"[:1500]], "ERROR"
        print(f"{key:28s} {note:10s} {time.time() - start:6.2f}s", flush=True)
        for p in problems:
            print("    ", str(p)[:700], flush=True)
