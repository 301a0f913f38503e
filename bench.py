"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import registry  # noqa: E402
from regiometra.session import build_session  # noqa: E402

HEADLINE = [
    "srt2_top_n", "ag7_describe", "ag9_value_share", "ag11_status_summary", "ag13_group_profile_median",
    "ag16_crosstab_row_percent", "ag17_correlation_matrix", "ag18_kpis", "prj5_iqr_outlier_flag",
    "prj7_near_upgrade_band", "cln1_coerce_numeric", "cln6_impute_median", "cln10_forward_fill",
    "ag1_collapse_children", "jn1_left_attach", "smp1_sample_n", "ml1_stratified_split",
    "ml2_standardize", "ml8_silhouette_exact", "ml16_classification_report",
    "scr1_scenario_features", "scr4_benchmark_percentile", "ml4_kmeans_centroids", "ml6_k_sweep",
    "ml19_model_comparison", "src4_to_src8_read_directory", "pl1_scrub_modeling",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    # One small query first, so that starting the JVM is not charged to the first name.
    registry.QUERIES["ag8_value_counts"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
