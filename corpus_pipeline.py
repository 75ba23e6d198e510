"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage gets what its predecessor kept and hands on the columns of ``documents``; the last one
returns the packed pieces. Rows are told apart by id and text, so an id that occurs with two texts
is two documents; rows that repeat both are one document once the duplicate stages have run. Texts of
any length are taken whole, further columns are carried along whatever their names, and an empty
table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.llm.common import documents, shared_table
from ionlake.llm.exact_dedup import exact_dedup
from ionlake.llm.near_dedup import near_dedup
from ionlake.llm.packing import pack_documents
from ionlake.llm.quality_rules import quality_rules
from ionlake.llm.secret_scan import redact_secrets

ID, TEXT = "doc_id", "text"


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col(TEXT), F.lit("")))


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame], once: bool) -> DataFrame:
    """The rows of ``docs`` that ``judge(rows, name of their id)`` keeps, told apart by id and text.

    With ``once`` rows that repeat both stay once. Columns are those of ``docs``, whatever their names.
    """
    row, text_hash, kept_id, kept_hash = (_fresh(docs, n) for n in ("row", "text_hash", "kept_id", "kept_hash"))
    keyed = docs.withColumn(text_hash, _hash())
    verdicts = judge(keyed.withColumn(row, F.struct(F.col(ID).alias("id"), F.col(text_hash).alias("hash"))), row).where("kept")
    wanted = verdicts.select(F.col(f"{row}.id").alias(kept_id), F.col(f"{row}.hash").alias(kept_hash)).distinct()
    same = F.col(ID).eqNullSafe(F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash))
    kept = keyed.join(wanted, same, "left_semi")
    return (kept.dropDuplicates([ID, text_hash]) if once else kept).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go. Null and empty texts fail; rows that repeat each other are judged alike."""
    return _kept(docs, quality_rules, once=False)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays, once; null counts as the empty text, and a null id loses to any other."""
    return _kept(docs, lambda rows, row: exact_dedup(rows, row, keep="largest"), once=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the one with the smallest id stays, once; texts without words are one class."""
    return _kept(docs, near_dedup, once=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and ``n_chars`` follows; every document stays, and a null text stays null."""
    masked = redact_secrets(docs)
    return masked.withColumn("n_chars", F.length(TEXT).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a null or empty text is its separator alone."""
    # a small cache: the workers have served the stages before
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache_chunks=250_000)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: Packing and the Markov models have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
