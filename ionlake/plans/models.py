"""Model files by registry name: checked once, read once, and sent to the tasks as one node table.

A model folder holds ``models.json``, which names for each model and ion type a file and its SHA-1::

    {"HCD2021": {"B": {"file": "HCD2021_B.json", "sha1": "..."}, "Y": {"file": "HCD2021_Y.json", "sha1": "..."}}}

Files are read by Spark, so the folder may be in any store it reads; the node table is as large as the
model and travels with the scorer, which Spark broadcasts.
"""

from __future__ import annotations

import hashlib
import io
import json
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import ModelIntegrityError, UnknownModel, model
from .forest_code import parse_forest_source
from .trees import boosted_dump_nodes, boosted_json, boosted_json_nodes

MANIFEST = "models.json"


def _content(spark: SparkSession, path: str) -> bytes:
    found = spark.read.format("binaryFile").load(path).select("content").first()
    if found is None:
        raise ModelIntegrityError(f"{path} is empty or missing")
    return bytes(found[0])


def parse_nodes(content: bytes, name: str, ion: str | None, model_name: str, base_score: float = 0.5) -> pd.DataFrame:
    """The node table in a file's content, by the ending of its name.

    ``.json`` is a boosted model and ``.txt`` a text dump, each of one ion type; ``.c`` is source text and
    ``.parquet`` a node table, which name their models and ion types themselves.
    """
    ending = PurePosixPath(name).suffix
    if ending == ".parquet":
        return pd.read_parquet(io.BytesIO(content))
    if ending == ".c":
        return parse_forest_source(content.decode())
    if ion is None:
        raise ValueError(f"{name} holds one ion type: name it, as in B={name}")
    if ending == ".json":
        return boosted_json_nodes(content.decode(), ion, model_name)
    if ending == ".txt":
        return boosted_dump_nodes(content.decode(), ion, model_name, base_score)
    raise ValueError(f"{name}: model files end in .json, .txt, .c or .parquet")


def read_nodes(spark: SparkSession, files: list[str], model_name: str, ions: list[str]) -> pd.DataFrame:
    """The node tables of ``path`` or ``ion=path`` arguments, for the ion types of a model."""
    parts = []
    for f in files:
        ion, equals, path = f.partition("=")
        path, ion = (path, ion) if equals else (f, None)
        if path.endswith(".parquet"):  # a file or a folder of them
            parts.append(spark.read.parquet(path).toPandas())
        else:
            parts.append(parse_nodes(_content(spark, path), path, ion, model_name))
    held = pd.concat(parts, ignore_index=True)
    held = held[(held["model"] == model_name) & held["ion"].isin(ions)]
    if missing := set(ions) - set(held["ion"]):
        raise UnknownModel(f"no trees of {model_name} for {sorted(missing)} in {files}")
    return held


def load_model(spark: SparkSession, name: str, folder: str) -> pd.DataFrame:
    """The node table of a registry model or its alias, from a model folder.

    Every file is checked against its SHA-1 before it is parsed; a model that the manifest lacks, an ion
    type without a file and a file that differs are errors.
    """
    own = model(name)
    listed = json.loads(_content(spark, f"{folder}/{MANIFEST}")).get(own.name)
    if listed is None:
        raise UnknownModel(f"{folder}/{MANIFEST} has no model {own.name}")
    if missing := set(own.ions) - listed.keys():
        raise UnknownModel(f"{own.name} has no files for {sorted(missing)} in {folder}")
    parts = []
    for ion in own.ions:
        entry = listed[ion]
        content = _content(spark, f"{folder}/{entry['file']}")
        if (got := hashlib.sha1(content).hexdigest()) != entry["sha1"]:
            raise ModelIntegrityError(f"{entry['file']} has SHA-1 {got}, not {entry['sha1']}")
        nodes = parse_nodes(content, entry["file"], ion, own.name, entry.get("base_score", 0.5))
        parts.append(nodes[nodes["ion"] == ion])
    return pd.concat(parts, ignore_index=True)


def save_model(spark: SparkSession, nodes: pd.DataFrame, name: str, folder: str) -> None:
    """Writes a model's forests as boosted JSON beside the folder's others, and lists them with their SHA-1."""
    own = model(name)
    if missing := set(own.ions) - set(nodes["ion"]):
        raise UnknownModel(f"no trees of {own.name} for {sorted(missing)}")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = json.loads(_content(spark, f"{folder}/{MANIFEST}")) if files.exists(jvm.org.apache.hadoop.fs.Path(root, MANIFEST)) else {}

    def write(file: str, text: str) -> None:
        out = files.create(jvm.org.apache.hadoop.fs.Path(root, file), True)
        out.write(bytearray(text.encode()))
        out.close()

    listed[own.name] = {}
    for ion in own.ions:
        text = boosted_json(nodes[nodes["ion"] == ion])
        file = f"{own.name}_{ion}.json"
        write(file, text)
        listed[own.name][ion] = {"file": file, "sha1": hashlib.sha1(text.encode()).hexdigest()}
    write(MANIFEST, json.dumps(listed, indent=1))


def model_files(spark: SparkSession, folder: str):
    """(file, length, sha1) of a model folder, as Spark reads it."""
    found = spark.read.format("binaryFile").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha1("content").alias("sha1"))
