"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which a cluster has to set; a temporary folder only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's checkpoint folder and cut its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a pure ASCII text takes the faster built-in path."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold(id_col: str, modulus: int) -> Column:
    """The cross-validation remainder of an id: crc32 of its decimal text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back; cuts lineage."""
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch, column: str, rows: int = 1000, size: int = 2 << 20):
    """Consecutive parts of an Arrow batch with at most ``rows`` rows and about ``size`` bytes of ``column``.

    A single longer value is a part of its own, so memory follows the longest text and no more.
    """
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for k, n in enumerate(lengths):
        if k > start and (k - start >= rows or held + n > size):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


_state: dict = {}


def worker_state(owner: str, make):
    """What ``make`` gives, kept in this Python worker for later tasks of the same owner.

    A worker holds one owner's state: tasks of another operator drop it, so caches that tasks
    share do not add up over the operators that a worker serves.
    """
    if owner not in _state:
        _state.clear()
        gc.collect()
        _state[owner] = make()
    return _state[owner]
