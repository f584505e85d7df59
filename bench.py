"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Arguments name queries to run instead of the default list; 'all' runs every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "a1_household_totals", "a3_weighted_rate", "a4_weighted_share", "a8_quantiles", "a9_histogram", "a12_first_per_group",
    "c8_parse_survey_date", "c10_count_codes", "j1_scenario_join", "r2_pivot_longer", "p1_stratified_split", "p2_mc_cv",
    "e1_roc_auc", "e2_roc_curve", "e5_threshold_sweep", "m1_ols", "m2_logit_saturated", "m3_gamma_inverse", "m5_survey_glm",
    "m6_fe_ols", "m10_knn_classify", "m14_score_long", "x1_iptw_binary", "x9_table_one", "d3_gamma_test", "t2_twfe", "t3_bacon",
    "t5_att_gt_never", "t5_att_gt_cross_section", "t9_did2s_rows", "t13_switchers", "z1_segmented_regression",
]


def main() -> None:
    from quasi.queries import QUERIES
    from quasi.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = list(QUERIES) if sys.argv[1:] == ["all"] else (sys.argv[1:] or HEADLINE)
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    # Start the JVM, the Parquet reader and a Python worker before timing.
    QUERIES["a14_category_count"](spark, sf_dir).collect()
    QUERIES["a6_mean_cl_normal"](spark, sf_dir).collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(
        json.dumps(
            {"metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
             "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
