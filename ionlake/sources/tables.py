"""Readers of search-engine tables, spectral libraries and SQLite stores."""

from __future__ import annotations

import sqlite3
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mods import Catalogue
from ..plans.storage import new_path


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header, all strings; null for empty fields."""
    return spark.read.csv(path, header=True, sep="\t")


def read_mztab(spark: SparkSession, path: str) -> DataFrame:
    """The peptide-spectrum rows of an mzTab file, named by its PSH line."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("PSH\t")).first()
    if head is None:
        raise ValueError(f"{path}: no PSH line")
    names = head[0].split("\t")[1:]
    fields = F.split("value", "\t")
    return lines.where(F.col("value").startswith("PSM\t")).select(*[F.nullif(F.get(fields, F.lit(k + 1)), F.lit("null")).alias(n) for k, n in enumerate(names)])


def read_msp(spark: SparkSession, path: str, sptxt: bool = False) -> DataFrame:
    """(name, peptide, charge, mods, parent, mw, protein, n_peaks, peaks) of an MSP or SPTXT library.

    ``mods`` is the library's own notation; peak rows are split at tabs or blanks. SPTXT names
    keep their bracketed masses out of the peptide.
    """
    blocks = spark.read.text(path, lineSep="\n\n").where(F.col("value").contains("Name:"))
    value = F.regexp_replace("value", r"\r", "")
    got = lambda p: F.nullif(F.regexp_extract("v", p, 1), F.lit(""))
    rows = blocks.select(value.alias("v")).select(
        F.trim(got(r"(?m)^Name:\s*(.*)$")).alias("name"),
        got(r"Mods=(\S+)").alias("mods"),
        got(r"Parent=([0-9.]+)").cast("double").alias("parent"),
        got(r"(?m)^MW:\s*([0-9.]+)").cast("double").alias("mw"),
        got(r'Protein="?([^"\s]+)').alias("protein"),
        got(r"(?mi)^Num\s?peaks:\s*([0-9]+)").cast("int").alias("n_peaks"),
        F.filter(F.split(F.regexp_extract("v", r"(?si)Num\s?peaks:\s*[0-9]+\s*\n(.*)$", 1), "\n"), lambda x: F.trim(x) != "").alias("lines"),
    )
    at = lambda x, k: F.get(F.split(F.trim(x), r"[\t ]+"), F.lit(k))
    peptide = F.substring_index("name", "/", 1)
    if sptxt:
        peptide = F.regexp_replace(peptide, r"\[[^\]]*\]|[a-z]|\(.*?\)", "")
    return rows.select(
        "name",
        peptide.alias("peptide"),
        F.regexp_extract("name", r"/([0-9]+)", 1).try_cast("int").alias("charge"),
        "mods",
        "parent",
        "mw",
        "protein",
        "n_peaks",
        F.transform("lines", lambda x: F.struct(at(x, 0).try_cast("float").alias("mz"), at(x, 1).try_cast("float").alias("intensity"))).alias("peaks"),
    )


def _opened(data: bytes) -> sqlite3.Connection:
    """A database file's bytes as a connection, in memory."""
    db = sqlite3.connect(":memory:")
    db.deserialize(data)
    return db


def read_sqlite(spark: SparkSession, path: str, tables: list[str], file_col: str | None = None) -> dict[str, DataFrame]:
    """Tables of SQLite files (a path or glob), typed by the first file's declarations.

    The files are read as binary and opened on the executors, in memory, one file a task, and each only
    once: the rows of all tables go to the checkpoint folder in one pass, a folder for each table, and the
    tables that come back read those. Only the declarations reach the driver. A file has to fit an
    executor's memory. A table that a file lacks has no rows there; ``file_col`` names a column for the
    file's path, which tells the rows of several files apart.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"{path}: no such file")

    def declared(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                db = _opened(data)
                rows = [(t, r[0], r[1], r[2]) for t in tables for r in db.execute(f'PRAGMA table_info("{t}")')]
                db.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["table", "k", "name", "kind"])

    found = files.where(F.col("path") == first).mapInArrow(declared, "table string, k bigint, name string, kind string").collect()
    columns = {t: [(r["name"], _kind(r["kind"])) for r in sorted(found, key=lambda r: r["k"]) if r["table"] == t] for t in tables}
    if missing := [t for t in tables if not columns[t]]:
        raise ValueError(f"{first} has no tables {missing}")
    folder = new_path(spark, "sqlite")
    structs = {t: "struct<" + ",".join(f"`{n}`:{k}" for n, k in columns[t]) + ">" for t in tables}
    kind = "`table` string, `path` string, " + ", ".join(f"`t{k}` {structs[t]}" for k, t in enumerate(tables))
    files.mapInArrow(_tables_reader(columns), kind).write.partitionBy("table").parquet(folder)
    schema = ", ".join(kind.split(", ")[1:]) + ", `table` string"
    held = spark.read.schema(schema).parquet(folder)
    path_column = [] if file_col is None else [F.col("path").alias(file_col)]
    return {t: held.where(F.col("table") == t).select(*[F.col(f"t{k}.`{n}`").alias(n) for n, _ in columns[t]], *path_column) for k, t in enumerate(tables)}


def _kind(declared: str) -> str:
    d = declared.upper()
    return "bigint" if "INT" in d or "BOOL" in d else "binary" if "BLOB" in d or not d else "double" if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "string"


def _tables_reader(columns: dict[str, list[tuple[str, str]]]):
    """Rows of all tables of each file: the table's struct is filled, the others are null."""

    def read(batches):
        kinds = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
        casts = {"bigint": int, "double": float, "string": str, "binary": bytes}
        structs = {t: pa.struct([(n, kinds[k]) for n, k in own]) for t, own in columns.items()}
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                db = _opened(data)
                there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")}
                for t, own in columns.items():
                    if t not in there:
                        continue
                    rows = db.execute("SELECT " + ", ".join(f'"{n}"' for n, _ in own) + f' FROM "{t}"')
                    while part := rows.fetchmany(20_000):
                        arrays = [pa.array([None if x is None else casts[k](x) for x in c], kinds[k]) for c, (_, k) in zip(zip(*part), own)]
                        n = len(part)
                        held = pa.StructArray.from_arrays(arrays, fields=list(structs[t]))
                        yield pa.RecordBatch.from_arrays([pa.array([t] * n), pa.array([path] * n), *(held if x == t else pa.nulls(n, structs[x]) for x in columns)], names=["table", "path", *(f"t{k}" for k in range(len(columns)))])
                db.close()

    return read


def decode_array(data: bytes | None, code: str = "d", order: str = "<") -> list[float]:
    """Numbers of a zlib-compressed array; ``code`` d (8 bytes) or f (4), ``order`` < or >."""
    if not data:
        return []
    raw = zlib.decompress(bytes(data))
    return list(struct.unpack(f"{order}{len(raw) // struct.calcsize(code)}{code}", raw))


def encode_array(values: list[float], code: str = "d", order: str = ">", level: int = 6) -> bytes:
    return zlib.compress(struct.pack(f"{order}{len(values)}{code}", *values), level)


def blib_spectra(tables: dict[str, DataFrame]) -> DataFrame:
    """(id, peptide, charge, precursor_mz, mods, peaks) of a BLIB store's three tables.

    ``mods`` is an array of (pos, mass), by position.
    """
    ref, mods, data = tables["RefSpectra"], tables["Modifications"], tables["RefSpectraPeaks"]

    def decode(batches):
        kind = pa.list_(pa.struct([("mz", pa.float32()), ("intensity", pa.float32())]))
        for batch in batches:
            peaks = []
            for m, i in zip(batch.column("peakMZ").to_pylist(), batch.column("peakIntensity").to_pylist()):
                peaks.append([{"mz": a, "intensity": b} for a, b in zip(decode_array(m, "d"), decode_array(i, "f"))])
            yield pa.RecordBatch.from_arrays([batch.column("RefSpectraID"), pa.array(peaks, kind)], names=["RefSpectraID", "peaks"])

    decoded = data.select("RefSpectraID", "peakMZ", "peakIntensity").mapInArrow(decode, "RefSpectraID bigint, peaks array<struct<mz:float,intensity:float>>")
    by_spectrum = mods.groupBy("RefSpectraID").agg(F.sort_array(F.collect_list(F.struct(F.col("position").cast("int").alias("pos"), F.col("mass").alias("mass")))).alias("mods"))
    return (
        ref.select(F.col("id"), F.col("peptideSeq").alias("peptide"), F.col("precursorCharge").cast("int").alias("charge"), F.col("precursorMZ").alias("precursor_mz"))
        .join(decoded, F.col("id") == decoded["RefSpectraID"])
        .drop("RefSpectraID")
        .join(by_spectrum.withColumnRenamed("RefSpectraID", "_id"), F.col("id") == F.col("_id"), "left")
        .drop("_id")
    )


PREDICTION_TYPES = {"spec_id": "string", "charge": "int", "ion": "string", "ionnumber": "int", "mz": "float", "prediction": "double", "target": "double", "rt": "double", "pearsonr": "double"}


def read_prediction_csv(spark: SparkSession, path: str) -> DataFrame:
    """Predictions, predictions with targets, or correlations, as the CSV sinks write them; an unnamed index column goes."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*[F.col(f"`{c}`").cast(PREDICTION_TYPES[c]).alias(c) for c in rows.columns if c in PREDICTION_TYPES])


def float_list(text: Column) -> Column:
    """The numbers of a list literal such as ``[1.0, 2.5]``; null where it is none."""
    return F.from_json(text, "array<double>")


def read_list_table(spark: SparkSession, path: str, lists: list[str]) -> DataFrame:
    """A tab-separated table whose ``lists`` columns hold list literals of numbers."""
    rows = spark.read.csv(path, header=True, sep="\t")
    return rows.select(*[float_list(F.col(c)).alias(c) if c in lists else F.col(c) for c in rows.columns])


def masses_to_mods(peptide: Column, mods: Column, catalogue: Catalogue, tolerance: float = 1e-6) -> Column:
    """A modification string for an array of (pos, mass): every catalogue entry of that mass whose site fits.

    A terminal entry fits the first or last residue and takes position 0 or -1.
    """
    n = F.char_length(peptide)

    def named(m):
        found = []
        for e in catalogue.mods:
            near = F.abs(m["mass"] - e.mass_shift) <= tolerance
            if e.site == "N-term":
                found.append(F.when(near & (m["pos"] == 1), F.lit(f"0|{e.name}")))
            elif e.site == "C-term":
                found.append(F.when(near & (m["pos"] == n), F.lit(f"-1|{e.name}")))
            else:
                found.append(F.when(near & (F.substring(peptide, m["pos"], F.lit(1)) == e.site), F.concat(m["pos"].cast("string"), F.lit(f"|{e.name}"))))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    all_named = F.array_join(F.flatten(F.transform(F.coalesce(mods, F.array().cast("array<struct<pos:int,mass:double>>")), named)), "|")
    return F.when(all_named == "", "-").otherwise(all_named)
