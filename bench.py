"""Time the headline queries and print one JSON line.

Every query is computed in full into a sink that keeps nothing. It runs once to warm up and
then ``BENCH_RUNS`` times (3 unless set); the middle time counts, planning included.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from adtally.session import local_session
from checks.queries import queries

HEADLINE = (
    "sell_by_site",
    "sell_by_site_lines",
    "sell_by_publisher",
    "sell_page",
    "sell_total",
    "sell_by_site_today",
    "publisher_status_new",
    "filter_category",
    "page_panel",
    "theme_counts",
    "blocked_buyers",
    "exchange_by_date",
    "search_facets",
    "search_page",
    "referral_attribution",
    "clean_numbers",
    "cyr_to_latin",
    "sanitize_title",
    "smart_encode",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores)
    registered, seconds = queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(registered[name](spark, root))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
