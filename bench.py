"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "job_00_fleet_watch", "win_02b_trailing_mean_channels", "win_03_trailing_std", "win_04_trailing_median", "win_06_exponential_mean",
    "win_10_regression_slope", "win_11_theil_sen_slope", "win_15b_segmented_persistence", "lbl_06_censor_status", "dq_10_trajectory_quality",
    "dq_16_request_rules", "jn_05_left_reconciliation", "jn_10_interpolating_asof", "agg_07_sensor_profile", "agg_09_rank_correlation",
    "agg_15_waveform_statistics", "agg_18_curve_features", "agg_21_cutoff_integral", "agg_23_support_bounds", "agg_26_robust_scale",
    "eval_09_error_slices", "eval_10_balanced_scores", "spl_02_group_folds", "spl_12_perturbation", "mdl_06b_one_pass_out_of_fold",
    "mdl_12b_envelope_mahalanobis", "mdl_15_threshold_and_alerts", "mdl_26_disjoint_audit", "job_04_train_baselines", "job_06_batch_scoring",
    "job_10_nested_detector_evaluation", "str_01_online_features",
)


def main() -> None:
    from wearpath.plans import catalog
    from wearpath.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    pattern = os.environ.get("BENCH_QUERIES")
    names = [n for n in catalog.BUILDERS if re.search(pattern, n)] if pattern else list(HEADLINE)
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "wearpath-bench")
    catalog.BUILDERS["flt_01_predicate_filters"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.BUILDERS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
