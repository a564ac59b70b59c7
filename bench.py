"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "a01_em_abundance", "a02_weighted_coverage", "a05_largest_target", "a07_id_ranges", "a09_pileup", "a10_depth_cap",
    "a13_direction_vote", "a15_neighbour_sets", "g02_bounded_shortest_path", "g07_components", "g08_region_growth",
    "j01_interval_overlap_left", "j02_path_overlap", "j05_lift_ids", "j07_residual_alignments", "j08_extract_pairs",
    "j13_duplicates", "p03_near_best", "p18_softmax_scaled", "w06_islands", "w09_first_assignment",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    from strandloom.plans.catalogue import QUERIES
    from strandloom.session import local_session

    spark = local_session(cpus, "strandloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    took = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
