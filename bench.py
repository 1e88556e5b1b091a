"""Benchmark: wall time of the headline queries, warm, on one machine. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cardmill.session import local_session  # noqa: E402
from checks.queries import QUERIES  # noqa: E402

HEADLINE = [
    "canonical_url", "clean_text", "deduplicate", "keyword_score", "ranked_documents", "harvest_first_seen",
    "pagination_cutoff", "health_history", "parse_verdict", "capture_body_plan", "flatten_dom", "match_selectors",
    "extract_cards", "scrape_pages", "infer_configs", "learn_sites", "stream_harvest",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    spark = local_session("bench", cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    times = {}
    for name in names.split(",") if names else HEADLINE:
        runs = []
        while len(runs) <= RUNS:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
