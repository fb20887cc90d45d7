"""Seconds per headline query, one JSON line on stdout.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from cueglass.workload.queries import QUERIES

HEADLINE = [
    "title_similarity",
    "top_keywords",
    "word_index",
    "candidate_score",
    "line_grouping",
    "line_rollup",
    "position_filter_image",
    "top_candidates",
    "spatial_pairs",
    "timestamp_extract",
    "clip_range_join",
    "selection_blocks",
    "selection_latest",
    "quote_export",
    "episode_match",
    "fuzzy_episode_match",
    "podcast_match",
    "extract_candidates",
    "resolve_image",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cueglass-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, total = {}, 0.0
    for name in names:
        start = time.time()
        # All columns of all rows are computed and dropped.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        total += times[name]
        print(f"{name}: {times[name]}", file=sys.stderr)
    images = spark.read.parquet(f"{folder}/orders.parquet").count()
    result = {
        "metric": "total seconds of headline queries",
        "value": round(total, 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    if "resolve_image" in times:
        result["images_per_second"] = round(images / times["resolve_image"], 1)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
