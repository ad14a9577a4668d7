"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.  Each query is planned and run to the
end twice; the second run counts.
"""

from __future__ import annotations

import importlib.util
import json
import os
import time

from pyspark.sql import SparkSession

HEADLINES = (
    "c03_box_score_rank w04_ema_and_box w17_skew_kurt w28_calendar_rolling w35_future_extreme w29_cross_rank j03_star j07_asof_backward j08_bounded_changes j11_range_join "
    "c04_derivative_score d02_waves e01_forward_outcomes e03_outcome_labels e05_horizon_returns f01_auc f05_permutation_band f20_precision_at_n g03_threshold_sweep t06_retention_scale"
).split()
OPTIONAL = "op1_suffix_tree op2_robust_quality op3_norm_buckets op4_event_chat op5_toxicity op6_simhash op7_byte_bpe op8_best_fit op9_url_filter op10_arrow_ids op11_summa_negatives op12_source_divergence op13_byte_network".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.sql.files.maxPartitionBytes", "16m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(os.path.dirname(os.path.abspath(__file__)), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries, seconds = entry.queries(), {}
    for name in [*HEADLINES, *OPTIONAL]:
        if name in queries:
            for _ in range(2 if name in HEADLINES else 1):
                began = time.time()
                queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
