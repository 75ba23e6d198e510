"""Feature-vector tables: a column for each feature in the model's layout, targets by ion type, partitioned by charge.

Readers name the features and ion types they want, and only those columns leave the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import N_FEATURES, feature_names

ID, SITE = "psmid", "site"


class InvalidVectors(ValueError):
    """A vector table whose columns are not those of a feature version."""


def vector_columns(vectors: DataFrame, ions: list[str], version: str = "general") -> DataFrame:
    """(psmid, site, charge, a column for each feature, targets_<ion>): rows of feature_vectors, spread.

    The charge is a column of its own and not repeated among the features; an ion type that a row lacks is null.
    """
    names = feature_names(version)
    own = [F.get("features", F.lit(k)).alias(n) for k, n in enumerate(names) if n != "charge"]
    targets = [F.try_element_at("targets", F.lit(i)).cast("float").alias(f"targets_{i}") for i in ions]
    return vectors.select(ID, SITE, F.col("charge").cast("int").alias("charge"), *own, *targets)


def write_vectors(vectors: DataFrame, path: str, ions: list[str], version: str = "general", mode: str = "overwrite", file_format: str = "parquet") -> None:
    """A folder by charge; ``file_format`` parquet, csv or json. A psmid's sites lie together within a file."""
    if file_format not in ("parquet", "csv", "json"):
        raise ValueError(f"vector tables are written as parquet, csv or json, not {file_format!r}")
    rows = vector_columns(vectors, ions, version).sortWithinPartitions("charge", ID, SITE)
    writer = rows.write.mode(mode).partitionBy("charge").format(file_format)
    (writer.option("header", True) if file_format == "csv" else writer).save(path)


def _types(version: str, ions: list[str]) -> dict[str, str]:
    return {ID: "string", SITE: "int", **{n: "int" for n in feature_names(version) if n != "charge"}, **{f"targets_{i}": "float" for i in ions}, "charge": "int"}


def read_vector_columns(spark: SparkSession, path: str, version: str = "general", file_format: str = "parquet") -> DataFrame:
    """The table as it is stored, checked against the layout of ``version``."""
    reader = spark.read.format(file_format)
    rows = (reader.option("header", True) if file_format == "csv" else reader).load(path)
    names = [n for n in feature_names(version) if n != "charge"]
    if missing := [n for n in (ID, SITE, "charge", *names) if n not in rows.columns]:
        raise InvalidVectors(f"{path} lacks {missing[:5]} of version {version}")
    ions = [c.removeprefix("targets_") for c in rows.columns if c.startswith("targets_")]
    if extra := [c for c in rows.columns if c not in _types(version, ions)]:
        raise InvalidVectors(f"{path} has columns {extra[:5]} that version {version} lacks")
    return rows.select(*[F.col(c).cast(k).alias(c) for c, k in _types(version, ions).items()])


def read_vectors(spark: SparkSession, path: str, version: str = "general", ions: list[str] | None = None, charges: list[int] | None = None, only: set[int] | None = None, file_format: str = "parquet") -> DataFrame:
    """(psmid, charge, site, features, targets): what feature_vectors gives, from a table on disk.

    With ``only`` the other features are 0 and their columns are not read; ``charges`` leaves folders out. A
    table without a wanted ion type is an error; absent targets are absent from the map.
    """
    rows = read_vector_columns(spark, path, version, file_format)
    there = [c.removeprefix("targets_") for c in rows.columns if c.startswith("targets_")]
    if missing := set(ions or []) - set(there):
        raise InvalidVectors(f"{path} has no targets of {sorted(missing)}; it has {there}")
    if charges is not None:
        rows = rows.where(F.col("charge").isin(charges))
    names = feature_names(version)
    if only is not None and not only <= set(range(N_FEATURES[version])):
        raise ValueError(f"version {version} has {N_FEATURES[version]} features")

    def feature(k: int, name: str) -> Column:
        return F.col(name) if only is None or k in only else F.lit(0)

    held = F.array(*[feature(k, n) for k, n in enumerate(names)])
    entries = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"targets_{i}").alias("v")) for i in (ions or there)])
    return rows.select(ID, "charge", SITE, held.alias("features"), F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("targets"))
