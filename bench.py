"""Time the registered queries: one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (cores), BENCH_QUERIES (comma-separated names, or
``all``), BENCH_ROUNDS (timed rounds; the fastest counts).
"""

from __future__ import annotations

import json
import os
import sys
import time

from widecast.registry import registered
from widecast.session import local_session

HEADLINE = [
    "derived_wide",
    "quantize_points",
    "profile_wide",
    "profile_documents",
    "sanity_report",
    "vectorize",
    "split_parts",
    "fold_assign",
    "balance_down",
    "nb_probabilities",
    "nb_oof",
    "nb_grid_selection",
    "metrics_by_model",
    "leaderboard",
    "boost_gradient_score",
    "boost_newton_score",
    "boost_sampled_score",
    "forest_score",
    "logistic_score",
    "stack_score",
    "search_leaderboard",
    "permutation_importance",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    rounds = int(os.environ.get("BENCH_ROUNDS", "1"))
    spark = local_session(cpus, app="widecast-bench")
    spark.sparkContext.setLogLevel("ERROR")
    found = registered()
    names = list(found) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    # Start the JVM's and Python's workers before the clock runs.
    found["nb_class_priors"].run(spark, sf).collect()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(rounds):
            start = time.perf_counter()
            found[name].run(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
