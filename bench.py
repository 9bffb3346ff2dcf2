"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("bm25_topk", "bm25_eval", "bm25_candidates", "embed_topk", "emax", "hybrid", "rerank", "metrics_by_type", "token_df", "facet_entries", "facet_people", "page_broken_links", "facet_paginate", "archive_fallback", "log_rotate", "near_names", "orphan_customers", "local_search", "unique_sessions", "mirror_drift", "lint_report")


def main() -> None:
    from marginalia.catalog import QUERIES
    from marginalia.session import local_session

    spark = local_session(CPUS, shuffle_partitions=int(CPUS), memory=os.environ.get("BENCH_MEMORY", "12g"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = dict(QUERIES)
    names = [n for n in HEADLINE if n in queries]
    try:
        from marginalia.llm.queries import QUERIES as more
    except ImportError:
        more = {}
    queries |= more
    names += sorted(more, key=lambda n: int(n[2:].split("_")[0]))
    took: dict[str, float] = {}
    for name in ["token_df", *names]:  # the first starts the session's machinery
        began = time.time()
        queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    total = round(sum(took[n] for n in names), 3)
    questions = 200 if "0.1" in FOLDER else 40
    rate = round(questions / took["bm25_topk"], 2)
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec", "queries": {n: took[n] for n in names}, "sf": os.path.basename(FOLDER.rstrip("/")), "bm25_questions_per_second": rate}))


if __name__ == "__main__":
    main()
