"""Time the headline queries: `BENCH_SF_DIR`, `BENCH_CPUS`, and optionally `BENCH_QUERIES` (comma-separated, or `all`).

Each query is built and run to the end once, every row computed and none kept. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from bazaarlens import plans
from bazaarlens.session import build_session

HEADLINE = (
    "classify_messages", "validate_posts", "pii_scan", "mask_digits", "normalise_text", "content_hash",
    "extract_price", "extract_size", "extract_brand", "caption_fallback", "query_filters", "parse_model_json",
    "item_attributes", "merge_attributes", "album_islands", "group_albums", "sliding_quota", "segment_posts",
    "pick_crops", "repost_by_hash", "repost_by_embedding", "repost_fold", "repost_clusters", "match_wishlists",
    "top_matches", "search_listings", "photo_search", "knn_brand", "admit_calls", "state_alerts", "coverage_report",
    "listing_detail", "price_history", "assemble_messages", "upsert_sink", "stream_albums",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    queries = plans.queries()
    names = list(queries) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors outside the clock
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name:28} {times[name]:8.2f}", flush=True)
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
