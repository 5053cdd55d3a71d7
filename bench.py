"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the test-data folder, ``BENCH_CPUS`` the number of local cores, ``BENCH_RUNS`` the runs per
query (the fastest counts). A time covers planning, the size checks and the whole result, which goes to Spark's no-op
sink. ``ingest`` queries start from the raw tables. ``store_tables`` writes spaces, documents, chunks and vectors
once; the ``stored`` queries read those, as searches do in use.
"""

import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession

from kbspark.plans.catalog import BUILDERS, QUERIES
from kbspark.sources.shipping import ship
from kbspark.sources.testdata import KnowledgeBase, StoredKnowledgeBase, store

INGEST = ["chunk_documents", "document_update_rebuild", "chunk_status_transition", "vectorize_rollup",
          "stream_task_rollup"]
STORED = ["vector_topk", "keyword_topk", "hybrid_topk", "hybrid_rerank_topk", "mixed_mode_search", "rag_prompts",
          "run_summary", "run_comparison", "session_history_flat", "integrity_report"]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("kbspark-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def timed(build: Callable[[], DataFrame], runs: int) -> float:
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(min(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = session(cpus)
    QUERIES["active_spaces"](spark, sf_dir).collect()
    seconds = {name: timed(lambda: QUERIES[name](spark, sf_dir), runs) for name in INGEST}
    with tempfile.TemporaryDirectory(prefix="kbspark-bench-") as root:
        start = time.perf_counter()
        store(KnowledgeBase(spark, sf_dir), root)
        seconds["store_tables"] = round(time.perf_counter() - start, 3)
        for name in STORED:
            seconds[name] = timed(lambda: BUILDERS[name](StoredKnowledgeBase(spark, sf_dir, root)), runs)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
