"""A store of observed spectra, clustered by precursor m/z, and its probing by islands of predicted precursors.

Spectra are dealt to slices, ranges of m/z that are sorted and hold small row groups; a table of the
slices keeps the bounds of each. A search turns its precursors into islands and the islands into a
bounded number of scan ranges: slices outside of them are never opened, and row groups are skipped by
their statistics.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import contains_all, gap_islands, range_match

#: Spectra of a slice on average, bytes of a row group, and scan ranges of a search at most.
SLICE_SPECTRA = 50_000
ROW_GROUP = 4 << 20
SCAN_RANGES = 64


def write_spectrum_store(spectra: DataFrame, path: str, mode: str = "overwrite", slice_spectra: int = SLICE_SPECTRA) -> None:
    """``specfile``, ``spec`` and ``slices`` Parquet tables; spectra without precursor m/z are left out, peaks sorted.

    Rows of one m/z are told apart by their titles, so a frequent m/z fills several slices.
    """
    held = spectra.where(F.col("precursor_mz").isNotNull()).withColumn("file_id", F.md5("source_file"))
    held.select("file_id", F.col("source_file").alias("filename")).distinct().write.mode(mode).parquet(f"{path}/specfile")
    sorted_mzs = F.sort_array(F.transform("peaks", lambda p: p["mz"]))
    rows = held.select("file_id", "title", F.col("precursor_mz").alias("pepmass"), sorted_mzs.alias("mzs"))
    count = max(1, -(-held.count() // slice_spectra))
    own = F.concat(F.lit(uuid.uuid4().hex[:12] + "-"), F.spark_partition_id().cast("string"))
    ranged = rows.repartitionByRange(count, "pepmass", "title").withColumn("slice", own).sortWithinPartitions("pepmass")
    ranged.write.mode(mode).partitionBy("slice").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/spec")
    spark = spectra.sparkSession
    spec = spark.read.parquet(f"{path}/spec")
    if "slice" in spec.columns:
        bounds = spec.groupBy("slice").agg(F.min("pepmass").alias("low"), F.max("pepmass").alias("high"), F.count(F.lit(1)).alias("n"))
        bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/slices")  # a short row for each slice


def _between(ranges: list[tuple[float, float]]) -> Column:
    """Any of the inclusive ranges holds pepmass; as a tree, so that many ranges do not nest deeply."""
    tests = [F.col("pepmass").between(a, b) for a, b in ranges]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return tests[0] if tests else F.lit(False)


def read_spectrum_store(spark: SparkSession, path: str, low: float | None = None, high: float | None = None, ranges: list[tuple[float, float]] | None = None) -> DataFrame:
    """Spectra of a store with their file names, in an inclusive precursor range or any of several.

    Slices beyond the ranges are left out by partition, row groups by statistics.
    """
    spec = spark.read.parquet(f"{path}/spec")
    if low is not None and high is not None:
        ranges = [(low, high)]
    if ranges is not None and "slice" in spec.columns:
        slices = spark.read.parquet(f"{path}/slices").collect()  # as many as the store has files
        wanted = [r["slice"] for r in slices if any(a <= r["high"] and b >= r["low"] for a, b in ranges)]
        spec = spec.where(F.col("slice").isin(wanted) & _between(ranges))
    # a file that was added twice is listed twice
    files = spark.read.parquet(f"{path}/specfile").dropDuplicates(["file_id"])
    return spec.join(files, "file_id").select("title", F.col("filename").alias("source_file"), F.col("pepmass").alias("precursor_mz"), "mzs")


def scan_ranges(peptides: DataFrame, tolerance: float, most: int = SCAN_RANGES) -> list[tuple[float, float]]:
    """At most ``most`` ranges that hold every precursor with its tolerance: islands, joined over their smallest gaps."""
    islands = gap_islands(peptides.select("prec_mz").distinct(), "prec_mz", 2 * tolerance, [], [], "island")
    spans = islands.groupBy("island").agg(F.min("prec_mz").alias("low"), F.max("prec_mz").alias("high"))
    ends = spans.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    if ends["low"] is None:
        return []
    before = spans.select((F.col("island") + 1).alias("island"), F.col("high").alias("before"))
    gaps = spans.join(before, "island").select("before", "low", (F.col("low") - F.col("before")).alias("gap"))
    widest = sorted((r["before"], r["low"]) for r in gaps.orderBy(F.desc("gap"), "low").limit(most - 1).collect())
    lows, highs = [ends["low"], *(b for _, b in widest)], [*(a for a, _ in widest), ends["high"]]
    return [(a - tolerance, b + tolerance) for a, b in zip(lows, highs, strict=True)]


def match_store(spark: SparkSession, path: str, peptides: DataFrame, precursor_tolerance: float, peak_tolerance: float = 0.02, most_ranges: int = SCAN_RANGES) -> DataFrame:
    """(spec_id, source_file, title) of stored spectra that fit a peptide's precursor and hold all its top peaks.

    ``peptides``: spec_id, prec_mz, top_mzs; those without a precursor m/z match nothing. Only the parts of
    the store around islands of precursors are read.
    """
    held = peptides.where(F.col("prec_mz").isNotNull())
    spectra = read_spectrum_store(spark, path, ranges=scan_ranges(held, precursor_tolerance, most_ranges))
    observed = spectra.withColumn("mzs", F.col("mzs").cast("array<double>"))
    met = range_match(observed, held, "precursor_mz", "prec_mz", precursor_tolerance)
    return met.where(contains_all(F.col("mzs"), F.col("top_mzs"), peak_tolerance)).select("spec_id", "source_file", "title")
