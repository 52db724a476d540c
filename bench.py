"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from postquill.plans.registry import QUERIES  # noqa: E402
from postquill.session import local_session  # noqa: E402

HEADLINE = (
    "hybrid_search", "bm25_search", "dense_topk_batch", "rrf_fusion", "weighted_fusion", "rerank_head_tail", "recall_mrr_ndcg", "chunk_fixed", "chunk_thread_aware",
    "content_dedup", "drop_blasts", "thread_components", "stratified_sample", "incremental_dedup", "digest_summary", "session_windows",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # compiled code and file metadata are warm
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    questions = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    asked = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus,
        "hybrid_questions_per_sec": round(questions / took["hybrid_search"], 1), "dense_questions_per_sec": round(asked / took["dense_topk_batch"], 1),
    }))


if __name__ == "__main__":
    main()
