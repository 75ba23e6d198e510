"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + ":" + os.environ.get("PYTHONPATH", "")

from pyspark.sql import SparkSession  # noqa: E402

from ionlake import queries  # noqa: E402

HEADLINE = [
    "peptide_filter",
    "digest_trypsin",
    "peptide_redundancy",
    "precursor_mz",
    "fragment_ladder_by",
    "apply_mods",
    "mod_versions",
    "predict_spectra",
    "norm_tic",
    "corr_by_ion",
    "median_corr",
    "spectral_angle",
    "interval_targets",
    "range_match",
    "qvalue",
    "best_psm",
    "msp_text",
    "scan_numbers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # the input files are small: more, smaller tasks keep all cores busy
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
