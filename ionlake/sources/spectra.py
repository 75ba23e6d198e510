"""Readers of observed spectra: (title, precursor_mz, precursor_charge, peaks, source_file)."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPECTRA = "title string, precursor_mz double, precursor_charge int, peaks array<struct<mz:float,intensity:float>>, source_file string"


def _field(name: str):
    return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{name}=(.*)$", 1)), F.lit(""))


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """MGF files or a glob; a block between BEGIN IONS and END IONS is one row.

    Fields may be missing (null); of PEPMASS and CHARGE the first value counts. Text that is no
    block, such as comments behind the peaks, is ignored.
    """
    blocks = spark.read.text(path, lineSep="END IONS").where(F.col("value").contains("BEGIN IONS"))
    lines = F.split(F.regexp_replace("value", r"(?s)^.*BEGIN IONS", ""), r"\r?\n")
    peak = r"^\s*[0-9.]+([eE][+-]?[0-9]+)?\s+[0-9.]+([eE][+-]?[0-9]+)?"
    number = lambda x, i: F.get(F.split(F.trim(x), r"\s+"), F.lit(i)).cast("float")
    peaks = F.transform(F.filter(lines, lambda x: x.rlike(peak)), lambda x: F.struct(number(x, 0).alias("mz"), number(x, 1).alias("intensity")))
    sign = F.when(F.col("c").contains("-"), -1).otherwise(1)
    return blocks.select(
        F.coalesce(_field("TITLE"), F.lit("")).alias("title"),
        F.get(F.split(_field("PEPMASS"), r"\s+"), F.lit(0)).try_cast("double").alias("precursor_mz"),
        F.regexp_extract(F.coalesce(_field("CHARGE"), F.lit("")), r"[0-9]+[+-]?", 0).alias("c"),
        peaks.alias("peaks"),
        F.col("_metadata.file_path").alias("source_file"),
    ).select("title", "precursor_mz", (F.regexp_extract("c", r"[0-9]+", 0).try_cast("int") * sign).alias("precursor_charge"), "peaks", "source_file")


def mgf_headers(spark: SparkSession, path: str) -> DataFrame:
    """(title, precursor_charge): column pruning leaves the peaks unparsed."""
    return read_mgf(spark, path).select("title", "precursor_charge")


def _spectrum(element, groups: dict[str, list[tuple[str, str]]]) -> tuple[str, float | None, int | None, list[dict]] | None:
    """(title, precursor m/z, charge, peaks) of a spectrum element of MS level 2, else nothing.

    A reference to a parameter group stands for the group's parameters.
    """
    level, mz, charge, arrays, own = 1, None, None, {}, None
    for node in element.iter():
        name = node.tag.rsplit("}", 1)[-1]
        if name == "referenceableParamGroupRef":
            params = groups.get(node.get("ref"), [])
        elif name == "cvParam":
            params = [(node.get("accession"), node.get("value"))]
        else:
            params = []
            if name == "binaryDataArray":
                own = set()
            elif name == "binary" and own is not None:
                raw = base64.b64decode(node.text or "")
                if "MS:1000574" in own:
                    raw = zlib.decompress(raw)
                code, width = ("d", 8) if "MS:1000523" in own else ("f", 4)
                arrays["mz" if "MS:1000514" in own else "intensity"] = struct.unpack(f"<{len(raw) // width}{code}", raw)
        for accession, value in params:
            if accession == "MS:1000511":
                level = int(value)
            elif accession == "MS:1000744" and mz is None:
                mz = float(value)
            elif accession == "MS:1000041" and charge is None:
                charge = int(float(value))
            elif own is not None:
                own.add(accession)
    if level != 2:
        return None
    return element.get("id", ""), mz, charge, [{"mz": float(a), "intensity": float(b)} for a, b in zip(arrays.get("mz", ()), arrays.get("intensity", ()))]


PARAM_GROUPS = "array<struct<id:string,params:array<struct<accession:string,value:string>>>>"
#: A file's groups are dealt so many times, so that a file of many spectra is not one key of the join.
_GROUP_COPIES = 16


def _param_groups(batches):
    """(source_file, groups) of the headers in text that ends at a group list's end."""
    for batch in batches:
        files, groups = [], []
        for text, file in zip(batch.column("value").to_pylist(), batch.column("source_file").to_pylist(), strict=True):
            held = []
            for own in re.findall(r"(?s)<referenceableParamGroup\s.*?</referenceableParamGroup>", text):
                element = ElementTree.fromstring(own)
                held.append({"id": element.get("id", ""), "params": [{"accession": p.get("accession"), "value": p.get("value")} for p in element.iter() if p.tag.endswith("cvParam")]})
            if held:
                files.append(file)
                groups.append(held)
        if files:
            param = pa.struct([("accession", pa.string()), ("value", pa.string())])
            kind = pa.list_(pa.struct([("id", pa.string()), ("params", pa.list_(param))]))
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(groups, kind)], names=["source_file", "groups"])


def mzml_param_groups(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, groups): the parameter groups of each file that has any, one row a file."""
    heads = spark.read.text(path, lineSep="</referenceableParamGroupList>").where(F.col("value").contains("<referenceableParamGroupList"))
    held = heads.select(F.concat(F.lit("<referenceableParamGroupList"), F.substring_index("value", "<referenceableParamGroupList", -1)).alias("value"), F.col("_metadata.file_path").alias("source_file"))
    return held.mapInArrow(_param_groups, f"source_file string, groups {PARAM_GROUPS}")


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """mzML files or a glob, MS level 2 only; a spectrum element is a row, so a file is as splittable as text.

    Spectra that refer to parameter groups, which stand in a file's head, get them by a join on the file;
    files without groups are not joined at all.
    """
    blocks = spark.read.text(path, lineSep="</spectrum>").where(F.col("value").rlike(r"<spectrum\s"))
    # the part from the element's start; what ended before it, or the list's own start, goes
    elements = blocks.select(F.concat(F.regexp_extract("value", r"(?s)(<spectrum\s.*)$", 1), F.lit("</spectrum>")).alias("element"), F.col("_metadata.file_path").alias("source_file"))
    refers = F.col("element").contains("<referenceableParamGroupRef")
    none = F.lit(None).cast(PARAM_GROUPS)
    groups = mzml_param_groups(spark, path)
    if groups.isEmpty():
        rows = elements.withColumn("groups", none)
    else:
        copies = groups.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(_GROUP_COPIES - 1))))
        copy = F.pmod(F.xxhash64("element"), F.lit(_GROUP_COPIES)).cast("int")
        joined = elements.where(refers).withColumn("_copy", copy).join(copies, ["source_file", "_copy"], "left").select("element", "source_file", "groups")
        rows = joined.unionByName(elements.where(~refers).withColumn("groups", none))

    def parse(batches):
        kind = pa.list_(pa.struct([("mz", pa.float32()), ("intensity", pa.float32())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                held = []
                for x, name, own_groups in zip(*(part.column(c).to_pylist() for c in ("element", "source_file", "groups")), strict=True):
                    params = {g["id"]: [(p["accession"], p["value"]) for p in g["params"]] for g in own_groups or []}
                    own = _spectrum(ElementTree.fromstring(x), params)
                    if own is not None:
                        held.append((*own, name))
                if held:
                    titles, mzs, charges, peaks, names = zip(*held)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(titles), pa.array(mzs, pa.float64()), pa.array(charges, pa.int32()), pa.array(peaks, kind), pa.array(names)],
                        names=["title", "precursor_mz", "precursor_charge", "peaks", "source_file"],
                    )

    return rows.mapInArrow(parse, SPECTRA)


READERS = {".mgf": read_mgf, ".mzml": read_mzml}


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """By the extension, in any case; other extensions are an error."""
    found = re.search(r"\.[A-Za-z]+$", path)
    reader = READERS.get(found[0].lower()) if found else None
    if reader is None:
        raise ValueError(f"{path}: spectra are read from {', '.join(sorted(READERS))} files")
    return reader(spark, path)


def spectra_in_folder(spark: SparkSession, folder: str) -> DataFrame:
    return read_mgf(spark, f"{folder.rstrip('/')}/*.mgf")
