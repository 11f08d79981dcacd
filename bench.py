"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3).  Each query is built and fully executed into the
``noop`` sink (every row computed, nothing collected); the reported time is
the median of BENCH_RUNS runs after one warm-up of the flagship query.

Reports read the stored review table, which is built once; ``enriched_store``
is the time to build it (two batches with their day counts) and counts towards
the total.  Queries that are no reports (tagging, scoring) derive their rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reviewlens.plans import registry, store  # noqa: E402
from reviewlens.session import local_session  # noqa: E402
from reviewlens.sources.fixture import SPREAD  # noqa: E402

HEADLINE = [
    "enriched_store",
    "tag_complaints",
    "theme_summary",
    "recent_slice",
    "rising_themes",
    "key_signals",
    "theme_samples",
    "signal_cards",
    "theme_library",
    "sentiment",
    "sentiment_corpus",
]


def run(spark, fn, sf_dir) -> float:
    t = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8))
    spark.conf.set(SPREAD, "true")  # the test tables are files of one split
    run(spark, registry.flagship, sf_dir)  # warm-up: JVM, codegen, file listing
    out = {}
    for name in HEADLINE:
        if name == "enriched_store":
            times = []
            for _ in range(runs):
                t = time.perf_counter()
                path = registry.build_store(spark, sf_dir)
                times.append(time.perf_counter() - t)
            out[name] = round(statistics.median(times), 3)
            continue
        report = registry.REPORTS.get(name)
        fn = (lambda s, d, f=report: f(store.Stored(s, path))) if report else registry.QUERIES[name]
        out[name] = round(statistics.median(run(spark, fn, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total_median",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
