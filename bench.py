"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "tokenize_counts", "token_doc_freq", "keyword_coverage_topk", "hybrid_topic_search", "batch_hybrid_search",
    "bm25_topk", "hash_embedding_sparse", "vector_topk_cosine", "heading_carry_forward", "chunk_boundary",
    "design_keywords", "dedup_keepers", "heading_tree", "validation_counts", "rerank_scores",
    "multi_query_fusion", "requirement_sections", "upsert_merge",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from dossierlake.plans.registry import all_queries
    from dossierlake.session import build_session

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)), spark__driver__memory="16g",
        spark__ui__enabled="false", spark__log__level="ERROR", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("dossierlake.spread", cpus)
    queries = all_queries()
    names = sys.argv[1:] or [n for n in HEADLINE if n in queries]
    if names == ["all"]:
        names = list(queries)
    spark.range(1000).selectExpr("sum(id)").collect()
    timings: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
