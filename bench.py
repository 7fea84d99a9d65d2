"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one discarded run, then the median of three. Prints one JSON line."""

import json
import os
import statistics
import time

from patchlens import session
from patchlens.plans import queries as plans

HEADLINE = ("success_matrix", "token_rollup", "failure_by_entity", "dedup_regroup", "status_histogram", "tristate_class", "pair_success_rate", "lookup_enrich", "attempt_explode_outer", "hunk_stats", "pipeline_funnel", "scan_scanner", "scan_parsed", "sink_by_file", "sink_sorted", "content_at_commit", "commit_patch")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.local(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
