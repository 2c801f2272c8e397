"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siemspark.session import build_session  # noqa: E402

HEADLINE = [
    "detect_run", "threshold_signals", "sequence", "event_signals", "batch_scan_dedup",
    "search_bool", "search_page", "search_stored", "field_state", "raw_verify", "source_gaps", "parse_outcomes",
    "normalize", "retry_state", "replay_reserve", "incident_apply", "case_timeline",
    "risk_ledger", "run_compare",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("siemspark-bench", f"local[{cpus}]", spark__ui__enabled="false",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
                          spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    from siemspark.plans.catalog import QUERIES

    names = sys.argv[1:] or HEADLINE
    seconds, first = {}, {}
    for name in names:
        # The first run also pays for code generation and starting workers.
        for taken in (first, seconds):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "first_run": first, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "event_rows": events,
        "events_per_sec": {n: round(events / seconds[n]) for n in ("detect_run", "parse_outcomes", "normalize")
                           if n in seconds}}))
    spark.stop()


if __name__ == "__main__":
    main()
