"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalogue

HEADLINE = ("snap_all_at_t", "snap_single_pass", "snap_filtered_topk", "snap_status_agg", "snap_diff_t1_t2", "snap_two_tables_join", "kv_scan_range_clears", "kv_multi_get_many_t", "gc_retained_rows", "occ_conflicts", "quorum_recover", "closure_reachable", "chain_verify", "sql_cube", "sql_rank", "win_session")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    found = {}
    for name in HEADLINE:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        found[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline queries, median of 3, summed", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
