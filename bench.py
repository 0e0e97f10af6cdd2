"""Times the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the run."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.plans import QUERIES  # noqa: E402
from assayer.plans.tables import Given  # noqa: E402
from assayer.session import local  # noqa: E402

HEADLINE = [
    "score_summary",
    "pattern_match",
    "first_mention",
    "prepare_cases",
    "peak_concurrency",
    "order_violations",
    "all_findings",
    "token_drift",
    "run_seal",
    "closure",
    "bundle_verify",
    "source_survey",
    "about",
    "behind",
    "select_compare",
    "render_requests",
    "assemble_chunks",
    "lint_pairs",
    "score_runs",
    "score_run_summary",
    "score_views",
    "proposal",
    "schedule_shuffled",
    "whitespace_runs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local(os.environ.get("BENCH_CPUS", "8"))
    given = Given.open(spark, sf_dir)
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](given).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median seconds over the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(os.environ.get("BENCH_CPUS", "8")),
                "spark": spark.version,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
