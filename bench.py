"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Each query runs to completion into a no-op sink: every row and column is
computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cinderframe.plans.catalog import QUERIES  # noqa: E402
from cinderframe.session import build_session  # noqa: E402

HEADLINE = [
    "p2_layer_risks",
    "a2_wind_weighted_score",
    "a4_state_counts",
    "a7_multi_domain_scores",
    "a9_roc_auc",
    "a12_threshold_sweep",
    "a14_across_seeds",
    "a22_mask_fingerprint",
    "a24_sensitivity_band",
    "j3_transition_labels",
    "j5_as_of_snapshot",
    "j6_circle_cells",
    "j7_polygon_cells",
    "g3_perturbed_scores",
    "w1_ignition_sample",
    "w2_stratified_split",
    "p13_feature_rows",
    "p22_linear_scoring",
    "d6_single_feature_auc",
    "d8_equal_area_circle",
    "s5_snapshot_table",
    "l2_weighted_logistic",
    "l5_hyperparameter_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "10g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # start the JVM's workers outside the timings
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
