"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line. BENCH_MASSIVE=1 adds the 100-million-row PSI."""

import json
import os
import time

from pyspark.sql import SparkSession

from driftspan import benchmark
from driftspan.plans import catalogue

HEADLINE = "psi_quantile psi_by_feature chunked_psi js_divergence ks_statistic cvm_statistic wasserstein chi2_statistic univariate_bh mixed_type_report ensemble_votes slice_drift datetime_drift legacy_numeric cusum_first_alarm ddm_first_alarm window_mean_gap classification_metrics auc prediction_drift".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINE:
        run = catalogue.QUERIES[name]
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        began = time.monotonic()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.monotonic() - began, 3)
    rows = 100_000_000 if os.environ.get("BENCH_MASSIVE", "1") == "1" else 1_000_000
    massive = benchmark.massive_psi(spark, rows)
    took[f"massive_psi_{rows // 1_000_000}m"] = round(massive["seconds"], 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "massive_delta": round(massive["delta"], 5), "rows_per_second": round(massive["rows_per_second"])}))
    spark.stop()


if __name__ == "__main__":
    main()
