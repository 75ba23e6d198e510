"""Observed spectra: checks, pre-processing, and targets for theoretical ions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import to_log, unlog
from ..functions.residues import PSEUDO, REPORTER_RANGES

PEAK = "array<struct<mz:float,intensity:float>>"


def tic(peaks: Column) -> Column:
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"].cast("double"))


def zero_range(peaks: Column, low: float, high: float) -> Column:
    """Peaks inside the inclusive range keep their place and lose their intensity."""
    return F.transform(
        peaks, lambda p: F.struct(p["mz"].alias("mz"), F.when(p["mz"].between(low, high), F.lit(0.0)).otherwise(p["intensity"]).cast("float").alias("intensity"))
    )


def remove_reporters(peaks: Column, label: str) -> Column:
    return zero_range(peaks, *REPORTER_RANGES[label])


def remove_precursor(peaks: Column, precursor_mz: Column, tolerance: float = 0.02) -> Column:
    near = lambda p: p["mz"].between(precursor_mz - tolerance, precursor_mz + tolerance)
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), F.when(near(p), F.lit(0.0)).otherwise(p["intensity"]).cast("float").alias("intensity")))


def tic_log(peaks: Column, total: Column) -> Column:
    """log2 of each peak's share of ``total`` plus the pseudo-count."""
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), to_log(F.try_divide(p["intensity"].cast("double"), total)).cast("float").alias("intensity")))


def preprocess(spectra: DataFrame, label: str | None = None) -> DataFrame:
    """Reporter removal, then log2 TIC shares; the TIC is that of the raw peaks."""
    held = spectra.withColumn("tic", tic(F.col("peaks")))
    peaks = F.col("peaks") if label is None else remove_reporters(F.col("peaks"), label)
    return held.withColumn("peaks", tic_log(peaks, F.col("tic")))


def spectrum_id(title: Column, pattern: str = "(.*)") -> Column:
    """Group 1 of ``pattern`` in the title; an error if the pattern is not found."""
    if "(" not in pattern:
        raise ValueError("the pattern needs a group")
    missing = F.raise_error(F.concat(F.lit("no spectrum id in title: "), title)).cast("string")
    return F.when(title.rlike(pattern), F.regexp_extract(title, pattern, 1)).otherwise(missing)


def row_targets(ions: Column, peaks: Column, tolerance: float = 0.02) -> Column:
    """Highest peak within the inclusive tolerance of each m/z, else log2 of the pseudo-count.

    Both arrays stand in one row, so nothing is shuffled; a peak may serve several ions.
    """
    missing = F.log2(F.lit(PSEUDO)).cast("float")
    near = lambda m: F.filter(peaks, lambda p: (p["mz"] >= m - tolerance) & (p["mz"] <= m + tolerance))
    return F.transform(ions, lambda m: F.coalesce(F.array_max(F.transform(near(m), lambda p: p["intensity"])), missing))


def interval_max(left: DataFrame, right: DataFrame, key: str, left_mz: str, right_mz: str, value: str, tolerance: float, out: str = "target") -> DataFrame:
    """``left`` with the largest ``value`` of the ``right`` rows of its key within +-tolerance, or null.

    An interval join by buckets of twice the tolerance: a left row meets the at most two buckets
    that its interval touches, by equality on (key, bucket), and the rest is a residual test.
    Matches are reduced before they go back to their rows, so a key with many rows is dealt by
    bucket and never meets itself in full.
    """
    width = 2 * tolerance
    numbered = left.withColumn("_row", F.monotonically_increasing_id())
    low, high = F.floor((F.col(left_mz) - tolerance) / width), F.floor((F.col(left_mz) + tolerance) / width)
    probes = numbered.select(F.col(key).alias("_k"), F.col("_row"), F.col(left_mz).alias("_m"), F.explode(F.sequence(low, high)).alias("_b"))
    peaks = right.select(F.col(key).alias("_k"), F.floor(F.col(right_mz) / width).alias("_b"), F.col(right_mz).alias("_x"), F.col(value).alias("_v"))
    met = probes.join(peaks, ["_k", "_b"]).where((F.col("_x") >= F.col("_m") - tolerance) & (F.col("_x") <= F.col("_m") + tolerance))
    best = met.groupBy("_row").agg(F.max("_v").alias(out))
    return numbered.join(best, "_row", "left").drop("_row")


def keyed_interval_max(left: DataFrame, right: DataFrame, keys: list[str], key: str, left_mz: str, right_mz: str, value: str, tolerance: float, out: str = "target") -> DataFrame:
    """As interval_max, for rows that the columns ``keys`` tell apart; grouped by them, without row numbers."""
    width = 2 * tolerance
    low, high = F.floor((F.col(left_mz) - tolerance) / width), F.floor((F.col(left_mz) + tolerance) / width)
    probes = left.select(*dict.fromkeys([*keys, key, left_mz]), F.explode(F.sequence(low, high)).alias("_b"))
    peaks = right.select(F.col(key).alias("_k"), F.floor(F.col(right_mz) / width).alias("_c"), F.col(right_mz).alias("_x"), F.col(value).alias("_v"))
    near = (F.col("_x") >= F.col(left_mz) - tolerance) & (F.col("_x") <= F.col(left_mz) + tolerance)
    met = probes.join(peaks, (F.col(key) == F.col("_k")) & (F.col("_b") == F.col("_c")) & near, "left")
    return met.groupBy(*dict.fromkeys([*keys, left_mz])).agg(F.max("_v").alias(out))


def normalise(predictions: DataFrame, method: str = "tic", log_space: bool = False, by: str = "spec_id", value: str = "prediction") -> DataFrame:
    """``value`` per spectrum: ``tic`` shares, or ``basepeak_1`` / ``basepeak_10000`` of the largest.

    With ``log_space`` the values are first taken out of log2 space and clipped at 0. A spectrum
    without intensity gets null.
    """
    x = unlog(F.col(value)) if log_space else F.col(value)
    own = Window.partitionBy(by)
    if method == "tic":
        scaled = F.try_divide(x, F.sum(x).over(own))
    elif method in ("basepeak_1", "basepeak_10000"):
        scaled = F.try_divide(x, F.max(x).over(own)) * (1.0 if method == "basepeak_1" else 10000.0)
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return predictions.withColumn(value, scaled)
