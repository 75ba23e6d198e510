"""The prediction operators over streams.

Every operator on spectra works on one row, so a stream of spectrum blocks goes through the same
functions as a table; windowed counts with a watermark and library sinks complete the picture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectra import preprocess, tic

SPECTRA = "title string, precursor_mz double, precursor_charge int, peaks array<struct<mz:float,intensity:float>>, source_file string"


def stream_spectra(spark: SparkSession, folder: str, schema: str = SPECTRA) -> DataFrame:
    """Spectra that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def processed(stream: DataFrame, label: str | None = None) -> DataFrame:
    return preprocess(stream.where(F.size("peaks") > 0), label)


def windowed_tic(stream: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Spectra and their intensity by window; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("n_spectra"), F.sum(tic(F.col("peaks"))).alias("tic"))


def windowed_events(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and the sum of their values by window and type."""
    held = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return held.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = False):
    """Start a query that gives each micro-batch to ``write``; its checkpoint makes restarts exact.

    ``once`` takes what is there and stops.
    """
    out = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
