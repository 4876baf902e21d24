"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder (default /root/testdata/sf0.1), BENCH_CPUS the
number of cores (default 8). Every query runs once untimed and is then timed
on its full result.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gristmill.plans import catalog  # noqa: E402
from gristmill.plans.registry import REGISTRY  # noqa: E402
from gristmill.session import build_session  # noqa: E402

HEADLINES = (
    "revenue_share_by_region", "aggregate_basic", "analysis_from_spec", "count_distinct_parts", "summary_statistics",
    "percentiles_spread", "running_total_by_status", "trend_monthly", "top_parts", "filter_tree",
    "text_column_statistics", "value_profile", "top_values", "key_inclusion",
    "clean_table", "cast_noisy_text", "upsert_rows", "first_of_equal_texts", "first_by_id_or_hash",
    "sentiment", "topic_words", "intelligence_table", "chunk_documents", "shingle_counts",
    "search_top_k", "rank_fusion", "quantize", "embed_documents", "unique_texts",
    "hybrid_rerank", "rank_evidence", "chunked_documents", "messages_within_budget", "trailing_hour",
    "stream_deduplicate", "drop_near_duplicates", "drop_similar", "diverse_hits", "approximate_recall", "discover_relationships",
    "similar_pairs", "graph_recall",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load()
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINES:
        query = REGISTRY[name]
        query(spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
