"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion with all columns computed (noop sink), twice; the second, warm time counts. Published
tables (event index, draws) are forgotten before every run, so each query builds its own inputs inside its time.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "flagship_merged_events", "wn01_runs", "wn03_merge_intervals", "jn01_available_strict", "jn02_containing_event",
    "it06_build_event_index", "it02_grouped_folds_customers", "jn16_draw_from_cdf", "jn18_materialize_signatures",
    "wn10_dense_reindex", "ag01_accumulate_target", "ag10_merge_moments", "ag16_residual_scales", "ag32_rollup_report",
    "jn07_covariate_window", "jn08_asof_cycle", "jn11_regrid_mean", "it01_wet_components", "it03_fit_probability",
    "me02_contingency", "me03_fss", "me04_fair_crps", "me09_reliability", "me15_oof_shift", "me20_block_bootstrap",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from petrichor.plans import QUERIES, bindings
    from petrichor.session import builder
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    spark = (builder("bench", f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", folder).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM start is not a query
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            bindings.forget()
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)  # made above


if __name__ == "__main__":
    main()
