"""Time the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "chunk_paragraphs",
    "chunk_code",
    "chunk_pages",
    "hash_embed",
    "postings",
    "bm25_stats",
    "bm25_search",
    "bm25_search_batch",
    "match_phrase",
    "vector_topk_batch",
    "hybrid_search",
    "hybrid_search_batch",
    "detect_changes",
    "upsert_files",
    "assign_location",
    "index_roundtrip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="docloom-"))  # local[*]: one machine
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    import registry
    from registry import inputs

    def timed(run) -> float:
        start = time.perf_counter()
        run()
        return round(time.perf_counter() - start, 3)

    # The JVM and the Python workers start outside the clock; the searched index is built inside.
    inputs.documents(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {"build_index": timed(lambda: inputs.index(spark, folder))}
    for name in HEADLINES:
        query = registry.QUERIES[name]
        seconds[name] = timed(
            lambda query=query: query(spark, folder).write.format("noop").mode("overwrite").save()
        )
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
