"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from skein.plans.queries import QUERIES
from skein.session import local_session

HEADLINE = [
    "text_bm25_topk", "text_bm25_heading_boost", "text_path_prefix", "raw_and", "raw_phrase", "raw_wildcard", "vector_topk", "hybrid_rrf", "snippet_window",
    "reindex_delta", "upsert_snapshot", "chunk_markdown", "chunk_comments", "debounce_sessions", "tokens_top",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_CPUS", "8")), "8g")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
