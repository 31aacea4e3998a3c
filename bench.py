"""Headline benchmark: prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plazalens import catalog  # noqa: E402
from plazalens.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# Query, and the driver table whose rows it works through.
HEADLINE = {
    "F1_label": "documents",
    "C2_label_distribution": "documents",
    "F5_entity_tags": "documents",
    "E5_top_claims": "documents",
    "E10_key_terms": "documents",
    "E1_extract_matches": "documents",
    "F20_page_text": "pages",
    "G7_G9_scored_verdict": "pages",
    "G26_verify": "documents",
    "C15_consensus": "labels",
    "C5_accounts_with_stats": "documents",
    "B1_pending_posts": "documents",
    "B10_timeline": "documents",
    "D1_reply_threads": "conversations",
    "D2_proximity_threads": "events",
    "A4_upsert_posts": "documents",
    "H3_until_known_run": "events",
    "H9_rate_breaches": "events",
    "H10_request_volume": "events",
    "G17_match_fact_checks": "documents",
    "G18_rank_articles": "documents",
    "H1_stream_upsert": "documents",
    "H12_analyse_pending": "documents",
}
#: Jobs of many steps: one run each.
ONCE = {"G17_match_fact_checks", "G18_rank_articles", "H1_stream_upsert", "H12_analyse_pending"}


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    queries = catalog.queries()
    rows = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in set(HEADLINE.values())}
    seconds = {}
    for name in HEADLINE:
        if name not in ONCE:
            run(queries[name], spark)  # warm-up: compilation, worker start
        seconds[name] = round(statistics.median(run(queries[name], spark) for _ in range(1 if name in ONCE else RUNS)), 3)
    text_mb = spark.read.parquet(f"{FOLDER}/documents.parquet").selectExpr("sum(octet_length(text)) / 1e6").first()[0]
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_second": {n: round(rows[t] / seconds[n]) for n, t in HEADLINE.items()},
                "F1_mb_per_second": round(text_mb / seconds["F1_label"], 1),
                "sf": os.path.basename(FOLDER.rstrip("/")),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
