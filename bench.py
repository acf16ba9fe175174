"""Headline-query benchmark.

Runs each headline query over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Every query is executed to completion with
the ``noop`` sink (full evaluation, nothing collected to the driver); the time of the second of
two runs is reported so JVM warm-up and plan-compilation are not counted twice.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trawl.plans import queries as Q  # noqa: E402
from trawl.session import local_session  # noqa: E402

HEADLINE = (
    "grep_lines",
    "count_fuzzy",
    "multi_keyword_grep",
    "page_text",
    "grep_pages_snippets",
    "link_graph",
    "dedup_smart",
    "fetch_outcomes",
    "bfs_depth",
    "crawl_grep",
)


def run(spark, name, sf_dir):
    df = Q.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else list(HEADLINE)
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="trawl-bench", scan_partitions=int(cpus))
    timings = {}
    for name in names:
        run(spark, name, sf_dir)
        t0 = time.time()
        run(spark, name, sf_dir)
        timings[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
