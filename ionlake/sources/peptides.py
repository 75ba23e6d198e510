"""Readers of peptide tables and protein sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mods import blank_mods
from ..functions.residues import IRT_PEPTIDES
from ..operators.digest import with_decoys


def read_peprec(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A peptide record file: its header begins with ``spec_id``, the next character separates fields.

    Ids and modifications are strings, charge and ce integers, rt a double; a protein_list given
    as a list literal becomes an array. A record whose collision energy is there and no number is left out.
    """
    head = spark.read.text(path).first()
    header = head[0] if head else ""
    if not header.startswith("spec_id") or len(header) < 8:
        raise ValueError(f"{path}: the header must begin with spec_id")
    rows = spark.read.csv(path, header=True, sep=header[7], quote='"', enforceSchema=False)
    casts = {"charge": "int", "rt": "double"}
    if "ce" in rows.columns:
        rows = rows.withColumn("ce", F.nullif(F.trim("ce"), F.lit(""))).where(F.col("ce").isNull() | F.col("ce").try_cast("double").isNotNull()).withColumn("ce", F.col("ce").cast("double"))
        casts["ce"] = "double"
    rows = rows.select(*[F.col(f"`{c}`").cast(casts.get(c, "string")).alias(c) for c in rows.columns])
    if "ce" in rows.columns:
        rows = rows.withColumn("ce", F.col("ce").cast("int"))
    if "modifications" in rows.columns:
        rows = rows.withColumn("modifications", blank_mods(F.col("modifications")))
    if "protein_list" in rows.columns:
        inner = F.regexp_replace(F.col("protein_list"), r"^\[|\]$", "")
        rows = rows.withColumn("protein_list", F.transform(F.split(inner, r",\s*"), lambda p: F.regexp_replace(p, r"^['\"]|['\"]$", "")))
    return rows if limit is None else rows.limit(limit)


def _fasta_blocks(batches):
    """Records without the ``>`` of a file's first; what stands before a file's first header goes.

    Rows of a file come in order, and only the first of its first split can lack the separator in front.
    """
    seen = None
    for batch in batches:
        held = []
        for value, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
            if start == 0 and seen != file:
                value = value[1:] if value.startswith(">") else ""
            seen = file
            if value.strip():
                held.append(value)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])


def read_fasta(spark: SparkSession, path: str, decoys: bool = False) -> DataFrame:
    """(protein, description, sequence); the protein id is the description up to its first blank.

    A record begins where a line begins with ``>``, as count_fasta counts; the character may stand inside a
    description. Text before a file's first header, such as comments, is no record.
    """
    split = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = F.split("value", r"\r?\n")
    rows = split.mapInArrow(_fasta_blocks, "value string").select(F.trim(F.get(lines, F.lit(0))).alias("description"), F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.regexp_replace(x, r"\s", "")), "").alias("sequence"))
    rows = rows.select(F.substring_index("description", " ", 1).alias("protein"), "description", "sequence")
    return with_decoys(rows) if decoys else rows


def count_fasta(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def any_case(pattern: str) -> str:
    """A path pattern whose file name matches in either case, such as ``*.peprec``."""
    folder, slash, name = pattern.rpartition("/")
    return folder + slash + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in name)


def with_spectrum_charges(peprec: DataFrame, spectra: DataFrame, overwrite: bool = False) -> DataFrame:
    """Records with the charge of the spectrum that has their id as title; others get null.

    Records that have charges keep them unless ``overwrite``.
    """
    if "charge" in peprec.columns and not overwrite:
        return peprec
    charges = spectra.select(F.col("title").alias("spec_id"), F.col("precursor_charge").alias("charge")).dropDuplicates(["spec_id"])
    return peprec.drop("charge").join(charges, "spec_id", "left")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(peptide, modifications, rt) of a retention-time calibration CSV with columns seq, modifications and tr."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.col("seq").alias("peptide"), blank_mods(F.col("modifications")).alias("modifications"), F.col("tr").cast("double").alias("rt"))


def irt_peptides(spark: SparkSession) -> DataFrame:
    """(peptide, modifications, irt): the built-in retention-time calibration set."""
    return spark.createDataFrame([(p, "-", rt) for p, rt in IRT_PEPTIDES], "peptide string, modifications string, irt double")
