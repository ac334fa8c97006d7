"""Wall time of the headline queries: one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the timed runs per query (the
median counts). Every query computes all its rows and columns; nothing is cached between runs.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.catalog import QUERIES  # noqa: E402
from hexwarden.session import build_session  # noqa: E402

HEADLINE = (
    "recent_alerts",
    "recent_transactions",
    "demo_feed",
    "alert_stats",
    "public_stats",
    "admin_overview",
    "risk_histogram",
    "daily_requests",
    "top_keys",
    "key_usage_daily",
    "validate_keys",
    "decode_transactions",
    "match_transactions",
    "first_writer",
    "insert_transactions",
    "backfill_new_protocol",
    "parse_scores",
    "apply_scores",
    "rule_scores",
    "new_alerts",
    "alert_outbox",
    "delete_protocols_alerts",
    "waitlist_decisions",
    "offered_load",
    "rate_limit_audit",
    "log_events",
    "stream_ingest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cpus),
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        once(name)  # Warm-up.
        # The stream runs whole micro-batches; one timed run is enough.
        seconds[name] = round(statistics.median(once(name) for _ in range(1 if name.startswith("stream") else runs)), 4)
    print(
        json.dumps(
            {
                "metric": "headline queries, median wall time, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
