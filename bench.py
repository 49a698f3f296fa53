"""Time the headline queries; print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload import tables
from workload.registry import QUERIES

HEADLINE = [
    "object_index", "size_duplicates", "etag_duplicates", "multipart_candidates", "hash_candidates",
    "hash_duplicates", "all_duplicates", "exclusive_duplicates", "scan_stats",
    "same_work_groups", "suspect_names", "snapshot_diff", "apply_listing_objects",
    "upsert_objects", "retention_keepers", "delete_plan", "ranked_groups", "report_rows",
    "folder_stats", "duplicate_folders", "orphan_plan", "resolve_conflicts", "emptied_folders",
    "rename_plan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/documents.parquet").write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    # The index that most queries read is built once, and timed as a row of its own.
    start = time.perf_counter()
    tables.objects(spark, folder)
    times = {"stored_index": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        seconds = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        times[name] = round(sorted(seconds)[len(seconds) // 2], 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
