"""Time the headline queries: one JSON line on stdout.

``BENCH_SF_DIR`` is the folder of the tables, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "first_wins_links", "competitor_profile", "cumulative_by_year", "overlap_matrix", "link_type_v1", "tier_v2",
    "queue_v2", "keyword_profile", "keyword_page_top10", "keyword_overlap", "keyword_tasks", "page_category_rollup",
    "sitemap_metrics_outer", "url_tree_rollup", "url_tree_zombie_cap", "snapshot_changes", "slug_overlap",
    "link_fingerprint_dedupe", "link_profile_b", "cohorts_b", "domain_intel_b", "domain_examples_topn",
    "drop_detection", "action_path", "action_queue_full", "unenriched_batches", "lenient_numbers", "href_extract",
)


def main() -> None:
    from rankloom.plans.catalog import QUERIES
    from rankloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    names = sys.argv[1:] or HEADLINES
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
