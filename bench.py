"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from quire.plans.queries import QUERIES
from quire.session import session

HEADLINE = [
    "bm25_search", "bm25_fielded", "listing_blank_query", "filter_level_year_tag", "library_stats", "cocitation_mining", "expand_references", "cocitation_pairs",
    "title_f1_match", "find_duplicate", "assess_level", "candidate_rank", "trim_pool_quota", "pool_merge", "html_to_text", "boilerplate_dedupe", "marker_density",
    "evidence_grounding", "metadata_audit", "import_merge", "index_sync_diff", "link_references", "citation_chain", "throttle_schedule", "stream_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as e:
            print(f"{name}: {e}", file=sys.stderr)
            continue
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
