"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelrec.plans import QUERIES  # noqa: E402
from panelrec.session import build_session  # noqa: E402

HEADLINE = (
    "impute_group_median", "panel_features", "serving_features", "holdout_targets", "fit_frequency_codes",
    "apply_frequency_codes", "global_zscore", "scale_robust", "sigma_clip", "scale_quantile",
    "six_strata_sample", "stratified_split", "split_compositions", "feature_upsert", "feature_lookup",
    "held_state", "knn_l2", "cascade_route", "cascade_on_events", "sweep_margin", "sweep_configs",
    "fuse_rrf", "decision_bundle", "model_record", "roc_auc_ovo", "latency_percentiles",
    "materialize_features",
)

WARM_UP = ("action_mix", "ratio_to_group_median", "random_n", "acquisitions", "gate_odds")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
