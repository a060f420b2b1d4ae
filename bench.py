"""Headline timings: one JSON line with seconds per query.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local task slots and
BENCH_QUERIES a comma list that replaces the default one.
"""

from __future__ import annotations

import json
import os
import time

from heliograph.plans import load_catalog
from heliograph.session import build_session

HEADLINE = (
    "normalize_text content_hash detect_language emotion_classify quality_gate extract_entities minhash_signature "
    "dedup_greedy near_dup_pairs graph_minmax_score propagate_scores pagerank trend_state seasonal_boost attribution_total "
    "event_match mann_whitney_u inverse_variance_weights weight_update ctr_posterior duration_histogram "
    "cluster_keywords embedding_dup_pairs stream_rate_5m daily_content_run"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
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
    queries, _ = load_catalog()
    queries["clamp"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the session
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
