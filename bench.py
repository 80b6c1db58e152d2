"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "group_holdout", "double_holdout", "coverage_blocks", "split_audit", "reconstruct_cued_trials", "parse_prompted_responses",
    "loo_group_prior", "prediction_table", "regression_metrics", "compile_cells", "match_donors", "evaluate_cells",
    "crossed_bootstrap", "paired_contrasts", "workflow_audit", "log_bandpower", "flatten_benchmark_rows",
)


def main() -> None:
    from tests.session import session

    from heldout.plans.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session()
    QUERIES["global_mean"](spark, sf_dir).collect()  # start the JVM and the Python workers
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }), flush=True)


if __name__ == "__main__":
    main()
