"""Headline queries on one local Spark; prints a single JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads. Every query runs
once to warm up and once for the clock; the clock covers planning and writing all rows to the no-op sink.
"""

from __future__ import annotations

import importlib.util
import json
import os
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "outline_chunks", "split_long", "build_index", "bm25_topk", "bm25_filtered", "knn_topk", "knn_filtered", "hybrid_search",
    "check_compliance", "evaluate_cases", "embed_chunks", "check_current", "document_toc", "snapshot_diff", "upsert_documents",
    "content_hash_skip", "extract_links", "html_body", "circular_rows", "withdrawn_rows", "extract_all_dates", "corpus_profile",
    "latency_stats", "tool_telemetry", "rate_limit_audit", "stream_ingest",
)
#: Timed where their package is present.
TRAINING = ("op1_embedding_near_dedup", "op6_suffix_dedup", "op10_simhash_near_dedup", "op11_spelling_variants", "op12_token_files", "op13_hard_negatives", "pipeline")


def main() -> None:
    from citadex.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    contract = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(contract)
    queries = contract.queries()
    seconds: dict[str, float] = {}
    for name in (*HEADLINE, *(n for n in TRAINING if n in queries)):
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": pathlib.Path(sf).name}))


if __name__ == "__main__":
    main()
