"""Spectral-library formats as DataFrames of text, and their writers.

A spectrum is one row before it is text: its ions are gathered in m/z order by one aggregation on
the id. Files are written in id order by a range sort; ``single_file`` coalesces at the very end.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mods import Catalogue, diff_sequence, msp_mods, parse_mods
from ..operators.peptides import precursor_mass, precursor_mz
from ..operators.spectra import normalise
from ..operators.windows import global_numbers, stable_split
from ..sources.tables import encode_array

MODES = ("overwrite", "append", "error")
#: Name of the id field in a library entry's comment.
ID_TAG = "Spec_ID"


def protein_string(proteins: Column) -> Column:
    return F.coalesce(F.array_join(proteins, "/"), F.lit(""))


def described(peprec: DataFrame, catalogue: Catalogue) -> DataFrame:
    """Records with precursor mass and m/z, and parsed modifications."""
    rows = peprec.withColumn("pairs", parse_mods(F.col("modifications")))
    rows = rows.withColumn("prec_mass", precursor_mass(F.col("peptide"), F.col("pairs"), catalogue))
    return rows.withColumn("prec_mz", precursor_mz(F.col("prec_mass"), F.col("charge")))


def _spectra(predictions: DataFrame, peprec: DataFrame, catalogue: Catalogue, method: str, log_space: bool) -> DataFrame:
    """One row per spectrum: the record's columns and ``ions`` (mz, ion, ionnumber, intensity) by m/z."""
    scaled = normalise(predictions, method, log_space)
    ions = scaled.groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("mz", "ion", "ionnumber", F.col("prediction").alias("intensity")))).alias("ions"))
    return described(peprec, catalogue).join(ions, "spec_id")


def _seconds(peprec: DataFrame) -> Column:
    return F.col("rt") * 60 if "rt" in peprec.columns else F.lit(None).cast("double")


def _peaks(sep: str, whole: bool, annotated: bool) -> Column:
    kept = F.filter("ions", lambda p: p["intensity"] != 0)

    def line(p):
        intensity = p["intensity"].cast("int").cast("string") if whole else p["intensity"].cast("string")
        parts = [F.format_string("%.6f", p["mz"].cast("double")), intensity]
        if annotated:
            parts.append(F.concat(F.lit('"'), F.lower(p["ion"]), p["ionnumber"].cast("string"), F.lit('/0.0"')))
        return F.concat_ws(sep, *parts)

    return F.array_join(F.transform(kept, line), "\n")


def msp(predictions: DataFrame, peprec: DataFrame, catalogue: Catalogue | None = None, log_space: bool = True, id_tag: str = ID_TAG) -> DataFrame:
    """(spec_id, value): MSP entries, base peak 10,000, whole intensities, annotated peaks.

    ``Num peaks`` counts all ions; those without intensity are not listed.
    """
    rows = _spectra(predictions, peprec, catalogue or Catalogue(), "basepeak_10000", log_space)
    comment = [F.concat(F.lit("Comment: Mods="), msp_mods(F.col("peptide"), F.col("pairs"))), F.concat(F.lit("Parent="), F.col("prec_mz").cast("string"))]
    if "protein_list" in peprec.columns:
        comment.append(F.concat(F.lit('Protein="'), protein_string(F.col("protein_list")), F.lit('"')))
    if "rt" in peprec.columns:
        comment.append(F.concat(F.lit("RetentionTime="), _seconds(peprec).cast("string")))
    comment.append(F.concat(F.lit(f'{id_tag}="'), F.col("spec_id").cast("string"), F.lit('"')))
    entry = F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), F.col("peptide"), F.lit("/"), F.col("charge").cast("string")),
        F.concat(F.lit("MW: "), F.col("prec_mass").cast("string")),
        F.concat_ws(" ", *comment),
        F.concat(F.lit("Num peaks: "), F.size("ions").cast("string")),
        _peaks("\t", True, True),
    )
    return rows.select("spec_id", F.concat(entry, F.lit("\n")).alias("value"))


def mgf(predictions: DataFrame, peprec: DataFrame, catalogue: Catalogue | None = None, log_space: bool = True) -> DataFrame:
    """(spec_id, value): MGF blocks, base peak 10,000."""
    rows = _spectra(predictions, peprec, catalogue or Catalogue(), "basepeak_10000", log_space)
    proteins = protein_string(F.col("protein_list")) if "protein_list" in peprec.columns else F.lit("")
    title = F.concat_ws(" ", F.concat(F.lit("TITLE="), F.col("spec_id").cast("string")), F.concat(F.col("peptide"), F.lit("/"), F.col("charge").cast("string")), msp_mods(F.col("peptide"), F.col("pairs")), proteins)
    lines = [F.lit("BEGIN IONS"), title, F.concat(F.lit("PEPMASS="), F.col("prec_mz").cast("string")), F.concat(F.lit("CHARGE="), F.col("charge").cast("string"), F.lit("+"))]
    if "rt" in peprec.columns:
        lines.append(F.concat(F.lit("RTINSECONDS="), _seconds(peprec).cast("string")))
    return rows.select("spec_id", F.concat_ws("\n", *lines, _peaks(" ", False, False), F.lit("END IONS\n")).alias("value"))


def spectronaut(predictions: DataFrame, peprec: DataFrame, catalogue: Catalogue | None = None, log_space: bool = True) -> DataFrame:
    """One row per ion with the column names of a Spectronaut library; TIC shares."""
    rows = described(peprec, catalogue or Catalogue())
    proteins = protein_string(F.col("protein_list")) if "protein_list" in peprec.columns else F.col("spec_id").cast("string")
    held = rows.select(
        "spec_id",
        F.concat(F.lit("_"), diff_sequence(F.col("peptide"), F.col("pairs"), catalogue or Catalogue()), F.lit("_")).alias("ModifiedPeptide"),
        F.col("peptide").alias("StrippedPeptide"),
        F.col("charge").alias("PrecursorCharge"),
        F.col("prec_mz").alias("PrecursorMz"),
        proteins.alias("ProteinId"),
        *([F.col("rt").alias("iRT")] if "rt" in peprec.columns else []),
        F.lit("noloss").alias("FragmentLossType"),
    )
    ions = normalise(predictions, "tic", log_space).select(
        "spec_id",
        F.when(F.col("ion").contains("2"), 2).otherwise(1).alias("FragmentCharge"),
        F.col("mz").alias("FragmentMz"),
        F.col("prediction").alias("RelativeIntensity"),
        F.lower(F.substring("ion", 1, 1)).alias("FragmentType"),
        F.col("ionnumber").alias("FragmentNumber"),
    )
    return held.join(ions, "spec_id").drop("spec_id")


def bibliospec(predictions: DataFrame, peprec: DataFrame, catalogue: Catalogue | None = None, log_space: bool = True, file_name: str = "predictions.ms2", start: int = 0) -> tuple[DataFrame, DataFrame]:
    """(SSL rows, MS2 blocks) that share scan numbers from ``start`` in the order of ids."""
    catalogue = catalogue or Catalogue()
    rows = global_numbers(_spectra(predictions, peprec, catalogue, "basepeak_10000", log_space), ["spec_id"], start)
    rows = rows.withColumn("mod_seq", diff_sequence(F.col("peptide"), F.col("pairs"), catalogue))
    rt = F.coalesce(_seconds(peprec).cast("string"), F.lit(""))
    ssl = rows.select(
        F.lit(file_name).alias("file"), "scan", "charge", F.col("mod_seq").alias("sequence"), F.lit("").alias("score-type"), F.lit("").alias("score"), rt.alias("retention-time")
    )
    z_line = lambda name, *c: F.concat_ws("\t", F.lit(name), *c)
    block = F.concat_ws(
        "\n",
        z_line("S", F.col("scan").cast("string"), F.col("prec_mz").cast("string")),
        z_line("Z", F.col("charge").cast("string"), F.col("prec_mass").cast("string")),
        z_line("D", F.lit("seq"), F.col("peptide")),
        z_line("D", F.lit("modified seq"), F.col("mod_seq")),
        _peaks("\t", False, False),
    )
    return ssl, rows.select("scan", F.concat(block, F.lit("\n")).alias("value"))


def csv_rows(predictions: DataFrame, log_space: bool = True) -> DataFrame:
    """Long table of TIC shares with six significant digits."""
    scaled = normalise(predictions, "tic", log_space)
    return scaled.withColumn("prediction", _six_digits(F.col("prediction")))


def _six_digits(x: Column) -> Column:
    """C's %.6g: six significant digits, trailing zeros cut, exponents for very small and large values; decimal ties go up."""
    power = F.floor(F.log10(F.abs(x))).cast("int")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    rounded = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    decimals = [F.when(power == k, F.regexp_replace(F.regexp_replace(F.format_string(f"%.{5 - k}f", x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")) for k in range(-4, 6)]
    return F.when(x == 0, "0").when(power.between(-4, 5), F.coalesce(*decimals, plain)).otherwise(rounded)


def dlib(predictions: DataFrame, peprec: DataFrame, path: str, catalogue: Catalogue | None = None, log_space: bool = True, source: str = "predictions", mode: str = "overwrite") -> None:
    """A DLIB SQLite library at a local path of the driver; retention times are required.

    Array blobs are made on the executors; rows reach the one file through an iterator, never all
    at once. Only peptide-to-protein pairs that the file lacks are added.
    """
    if "rt" not in peprec.columns:
        raise ValueError("a DLIB library needs retention times")
    catalogue = catalogue or Catalogue()
    import pyarrow as pa

    rows = _spectra(predictions, peprec, catalogue, "basepeak_10000", log_space).select(
        "prec_mz", "charge", diff_sequence(F.col("peptide"), F.col("pairs"), catalogue, 5).alias("mod_seq"), "peptide", (F.col("rt") * 60).alias("rt"),
        F.transform(F.filter("ions", lambda p: p["intensity"] > 0), lambda p: p["mz"].cast("double")).alias("mz"),
        F.transform(F.filter("ions", lambda p: p["intensity"] > 0), lambda p: p["intensity"].cast("double")).alias("it"),
        (protein_string(F.col("protein_list")) if "protein_list" in peprec.columns else F.lit("")).alias("proteins"),
    )

    def pack(batches):
        for batch in batches:
            mz, it = batch.column("mz").to_pylist(), batch.column("it").to_pylist()
            own = [batch.column(c) for c in ("prec_mz", "charge", "mod_seq", "peptide", "rt", "proteins")]
            lengths = [pa.array([8 * len(x) for x in mz], pa.int32()), pa.array([4 * len(x) for x in it], pa.int32())]
            blobs = [pa.array([encode_array(x, "d") for x in mz], pa.binary()), pa.array([encode_array(x, "f") for x in it], pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *lengths, *blobs], names=["prec_mz", "charge", "mod_seq", "peptide", "rt", "proteins", "n_mz", "n_it", "mz", "it"])

    packed = rows.mapInArrow(pack, "prec_mz double, charge int, mod_seq string, peptide string, rt double, proteins string, n_mz int, n_it int, mz binary, it binary")
    if mode == "overwrite":
        Path(path).unlink(missing_ok=True)
    db = sqlite3.connect(path)
    db.executescript(
        """CREATE TABLE IF NOT EXISTS metadata (Key TEXT NOT NULL, Value TEXT NOT NULL);
        CREATE TABLE IF NOT EXISTS entries (PrecursorMz REAL, PrecursorCharge INTEGER, PeptideModSeq TEXT, PeptideSeq TEXT, Copies INTEGER, RTInSeconds REAL, Score REAL,
        MassEncodedLength INTEGER, MassArray BLOB, IntensityEncodedLength INTEGER, IntensityArray BLOB, SourceFile TEXT);
        CREATE TABLE IF NOT EXISTS peptidetoprotein (PeptideSeq TEXT NOT NULL, isDecoy INTEGER, ProteinAccession TEXT NOT NULL);
        CREATE UNIQUE INDEX IF NOT EXISTS pair ON peptidetoprotein (PeptideSeq, ProteinAccession);"""
    )
    if not db.execute("SELECT count(*) FROM metadata WHERE Key = 'version'").fetchone()[0]:
        db.execute("INSERT INTO metadata VALUES ('version', '0.1.14')")
    for r in packed.toLocalIterator(prefetchPartitions=True):
        db.execute("INSERT INTO entries VALUES (?,?,?,?,1,?,0,?,?,?,?,?)", (r["prec_mz"], r["charge"], r["mod_seq"], r["peptide"], r["rt"], r["n_mz"], bytes(r["mz"]), r["n_it"], bytes(r["it"]), source))
        db.executemany("INSERT OR IGNORE INTO peptidetoprotein VALUES (?,0,?)", [(r["peptide"], p) for p in r["proteins"].split("/") if p])
    db.commit()
    db.close()


def _text(rows: DataFrame, path: str, order: str, mode: str, single_file: bool, head: str = "") -> None:
    ordered = rows.orderBy(order).select("value")
    if head:
        ordered = rows.sparkSession.createDataFrame([(head,)], "value string").union(ordered)
    (ordered.coalesce(1) if single_file else ordered).write.mode(mode).text(path)


def _write_msp(predictions, peprec, path, mode, single_file, **options):
    _text(msp(predictions, peprec, **options), path + ".msp", "spec_id", mode, single_file)


def _write_mgf(predictions, peprec, path, mode, single_file, **options):
    _text(mgf(predictions, peprec, **options), path + ".mgf", "spec_id", mode, single_file)


def _write_spectronaut(predictions, peprec, path, mode, single_file, **options):
    rows = spectronaut(predictions, peprec, **options)
    (rows.coalesce(1) if single_file else rows).write.mode(mode).csv(path + "_spectronaut.csv", header=mode != "append", sep=";")


def _write_csv(predictions, peprec, path, mode, single_file, log_space=True, **_):
    rows = csv_rows(predictions, log_space)
    (rows.coalesce(1) if single_file else rows).write.mode(mode).csv(path + ".csv", header=True)


def _write_bibliospec(predictions, peprec, path, mode, single_file, **options):
    spark, start = predictions.sparkSession, 0
    if mode == "append":
        held = spark.read.csv(path + ".ssl", header=True, sep="\t").agg(F.max(F.col("scan").cast("long"))).first()[0]
        start = 0 if held is None else held + 1
    ssl, ms2 = bibliospec(predictions, peprec, file_name=Path(path).name + ".ms2", start=start, **options)
    (ssl.coalesce(1) if single_file else ssl).write.mode(mode).csv(path + ".ssl", header=True, sep="\t", emptyValue="")
    _text(ms2, path + ".ms2", "scan", mode, single_file, "" if mode == "append" else "H\tExtractor\tpredictions")


def _write_parquet(predictions, peprec, path, mode, single_file, **_):
    (predictions.coalesce(1) if single_file else predictions).write.mode(mode).parquet(path + ".parquet")


def _write_dlib(predictions, peprec, path, mode, single_file, **options):
    dlib(predictions, peprec, path + ".dlib", mode=mode, **options)


SINKS: dict[str, Callable] = {
    "csv": _write_csv,
    "msp": _write_msp,
    "mgf": _write_mgf,
    "spectronaut": _write_spectronaut,
    "bibliospec": _write_bibliospec,
    "parquet": _write_parquet,
    "dlib": _write_dlib,
}


def write_results(predictions: DataFrame, peprec: DataFrame, path: str, formats: list[str], mode: str = "overwrite", single_file: bool = False, **options) -> None:
    """Write one or several formats under ``path``; unknown names and modes are errors before any work.

    With several formats the predictions are kept in memory or on disk between the writes.
    """
    unknown = set(formats) - SINKS.keys()
    if unknown:
        raise ValueError(f"unknown output formats {sorted(unknown)}; known are {sorted(SINKS)}")
    if mode not in MODES:
        raise ValueError(f"unknown write mode {mode!r}")
    held = predictions.persist() if len(formats) > 1 else predictions
    try:
        for f in formats:
            SINKS[f](held, peprec, path, mode, single_file, **options)
    finally:
        if len(formats) > 1:
            held.unpersist()


def write_peprec(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Blank-separated peptide records, spec_id first; proteins as a list literal."""
    columns = ["spec_id", *[c for c in rows.columns if c != "spec_id"]]
    out = rows.select(*columns)
    if "protein_list" in columns:
        quoted = F.transform("protein_list", lambda p: F.concat(F.lit("'"), p, F.lit("'")))
        out = out.withColumn("protein_list", F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))
    out.write.mode(mode).csv(path, sep=" ", header=True, nullValue="-")


def predictions_and_targets(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """(spec_id, charge, ion, ionnumber, mz, target, prediction): ions that have both."""
    return predictions.join(targets.select("spec_id", "ion", "ionnumber", "target"), ["spec_id", "ion", "ionnumber"]).select("spec_id", "charge", "ion", "ionnumber", "mz", "target", "prediction")


def write_table(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Correlations, predictions with targets, or matched spectra as CSV with a header."""
    rows.write.mode(mode).csv(path, header=True)


def mgf_spectra(spectra: DataFrame) -> DataFrame:
    """(title, value): observed spectra as MGF blocks; peaks without intensity are left out."""
    peak = lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c.cast("string")))
    peaks = F.array_join(F.transform(F.filter("peaks", lambda p: p["intensity"] > 0), peak), "\n")
    charge = F.when(F.col("precursor_charge").isNotNull(), F.concat(F.col("precursor_charge").cast("string"), F.lit("+")))
    return spectra.select("title", F.concat_ws("\n", F.lit("BEGIN IONS"), line("TITLE", F.col("title")), line("PEPMASS", F.col("precursor_mz")), line("CHARGE", charge), F.when(peaks != "", peaks), F.lit("END IONS\n")).alias("value"))


def write_mgf_spectra(spectra: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Selected observed spectra, such as those of a PSM list or of one side of a split, as an MGF folder."""
    mgf_spectra(spectra).select("value").write.mode(mode).text(path)


def write_split(peprec: DataFrame, spectra: DataFrame, path: str, test_fraction: float = 0.1, mode: str = "overwrite") -> None:
    """Records and their observed spectra as two pairs of files: ``<path>_train`` and ``<path>_test``, .peprec and .mgf.

    A spectrum goes with the record of its title; a record is on the same side in every run. Spectra that no
    record names are in neither.
    """
    for side, rows in zip(("train", "test"), stable_split(peprec, "spec_id", test_fraction), strict=True):
        write_peprec(rows, f"{path}_{side}.peprec", mode)
        own = rows.select(F.col("spec_id").alias("title"))
        write_mgf_spectra(spectra.join(own, "title", "left_semi").select(*spectra.columns), f"{path}_{side}.mgf", mode)
