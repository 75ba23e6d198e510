"""The engine's entry points: each one lazy plan from inputs to a long table."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_corr, unlog
from ..functions.mods import MOD_STRING, SEQUENCE, Catalogue, parse_mods
from ..functions.residues import PSEUDO
from ..operators.digest import digest, peptidoforms, unique_peptides, with_decoys, with_proteins
from ..operators.features import site_features
from ..operators.peptides import clean_peptides, fragment_ions, in_window, precursor_mass, precursor_mz
from ..operators.spectra import keyed_interval_max, normalise, preprocess, row_targets, spectrum_id
from ..operators.ranks import quantiles
from ..operators.windows import match_spectra as match_tables
from ..operators.windows import stable_split, top_peaks
from ..sinks.libraries import write_results
from .config import LABELS, LibraryConfig, model
from .metrics import InvalidPeptide, NoValidPeptides, RunMetrics
from .storage import stored_table
from .trees import score_peptides, score_totals

#: A retention-time predictor: records in, records with a column rt out.
RetentionPredictor = Callable[[DataFrame], DataFrame]


def _known_mods(catalogue: Catalogue) -> Column:
    names = [m.name for m in catalogue.mods]
    return F.forall(parse_mods(F.col("modifications")), lambda m: m["name"].isin(*names) if names else F.lit(False))


def _predictable(peprec: DataFrame, catalogue: Catalogue, features: str, strict: bool, metrics: RunMetrics | None) -> DataFrame:
    rows = clean_peptides(peprec if metrics is None else metrics.watch(peprec, tuple(m.name for m in catalogue.mods)))
    if strict:
        bad = F.raise_error(F.concat(F.lit("unknown modification in "), F.col("modifications"))).cast("boolean")
        rows = rows.where(F.when(_known_mods(catalogue), True).otherwise(bad))
    else:
        rows = rows.where(_known_mods(catalogue))
    if features == "ce":
        rows = rows.withColumn("ce", F.coalesce(F.col("ce"), F.lit(30)) if "ce" in rows.columns else F.lit(30))
    return rows


def predict_totals(peprec: DataFrame, nodes: pd.DataFrame, catalogue: Catalogue | None = None, features: str = "general", strict: bool = False, keep: tuple[str, ...] = ("spec_id",)) -> DataFrame:
    """(keep..., ion, n_ions, top_ion, sum_log2, intensity): what the rows of ``predict`` add up to for each record and ion type.

    Each record is scored where it lies, without m/z: nothing is stored or shuffled, and a pair of residues and
    charge that comes again is scored again.
    """
    return score_totals(_predictable(peprec, catalogue or Catalogue(), features, strict, None), nodes, keep, features)


def predict(peprec: DataFrame, nodes: pd.DataFrame, catalogue: Catalogue | None = None, version: str = "general", features: str = "general", strict: bool = False, metrics: RunMetrics | None = None) -> DataFrame:
    """(spec_id, charge, ion, ionnumber, mz, prediction) in log2 space.

    Intensities depend on the residues and the charge alone, so each distinct pair is scored once
    (I read for L) and joined back to its modified forms. Records with a modification that the
    catalogue lacks are left out, or an error if ``strict``. A missing collision energy is 30.

    The records that remain are written once, eagerly, as both branches read them; what comes out is a
    plan. With ``metrics`` that one pass also counts the records, and those left out by reason.
    """
    catalogue = catalogue or Catalogue()
    rows = _predictable(peprec, catalogue, features, strict, metrics)
    key = ["scored", "charge"] + ["ce"] * (features == "ce")
    read = [c for c in ("spec_id", "peptide", "modifications", "charge", "ce") if c in rows.columns]
    rows = stored_table(rows.select(*read).withColumn("scored", F.translate("peptide", "L", "I")), "records")
    # few bytes but much work a row: dealt to a fixed number of tasks, which small results are not merged into
    tasks = int(peprec.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = rows.select(*key).distinct().repartition(tasks, *key).withColumn("peptide", F.col("scored"))
    scored = score_peptides(distinct, nodes, tuple(key), features)
    joined = rows.join(scored, key)
    ions = {c[2:]: F.col(c) for c in scored.columns if c.startswith("p_")}
    return fragment_ions(joined, version, catalogue, values=ions)


def with_targets(
    peprec: DataFrame, spectra: DataFrame, catalogue: Catalogue | None = None, version: str = "general", tolerance: float = 0.02, pattern: str = "(.*)", label: str | None = None
) -> DataFrame:
    """(spec_id, charge, ion, ionnumber, mz, target): the best observed peak of each ion, log2 space.

    Spectra meet records by the id in their title; unmatched rows of either side go, and so do
    mutated peptides. A spectrum's charge counts before the record's. Each spectrum's ions and peaks
    stand in one row by then: the peak search shuffles nothing, and only its results are exploded.
    """
    catalogue = catalogue or Catalogue()
    rows = clean_peptides(peprec).where(~F.col("modifications").contains("mut")).where(_known_mods(catalogue))
    held = preprocess(spectra.where(F.size("peaks") > 0), label).withColumn("spec_id", spectrum_id(F.col("title"), pattern))
    met = rows.join(held.select("spec_id", "precursor_charge", "peaks"), "spec_id")
    met = met.withColumn("charge", F.coalesce("precursor_charge", "charge"))
    search = lambda mz: row_targets(mz, F.col("peaks"), tolerance)
    return fragment_ions(met, version, catalogue, use=("peaks",), found={"target": search})


def evaluate(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """(spec_id, ion, pearsonr) of predictions against targets; undefined correlations are null."""
    both = predictions.join(targets.select("spec_id", "ion", "ionnumber", "target"), ["spec_id", "ion", "ionnumber"])
    return both.groupBy("spec_id", "ion").agg(safe_corr(F.col("target").cast("double"), F.col("prediction")).alias("pearsonr"))


def median_correlations(correlations: DataFrame, by: tuple[str, ...] = ("ion",)) -> DataFrame:
    """(by..., n, median_r): the median correlation of each group, such as ion, model, charge or length, with the number behind it."""
    return quantiles(correlations, "pearsonr", list(by), [0.5]).select(*by, "n", F.get("quantiles", F.lit(0)).alias("median_r"))


def feature_vectors(peprec: DataFrame, targets: DataFrame, features: str = "general") -> DataFrame:
    """(psmid, charge, site, features, targets map by ion): rows to train on.

    Suffix ions are turned round: site i goes with ion n-1-i of their series.
    """
    rows = site_features(clean_peptides(peprec), features, ("spec_id", "charge", "peptide"))
    n = F.char_length("peptide")
    lengths = clean_peptides(peprec).select("spec_id", n.alias("n"))
    site = F.when(F.substring("ion", 1, 1).isin("B", "C", "A"), F.col("ionnumber") - 1).otherwise(F.col("n") - 1 - F.col("ionnumber"))
    placed = targets.join(lengths, "spec_id").withColumn("site", site.cast("int"))
    wide = placed.groupBy("spec_id", "site").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ion", "target")))).alias("targets"))
    return rows.join(wide, ["spec_id", "site"]).select(F.col("spec_id").alias("psmid"), "charge", "site", "features", "targets")


def train_test(vectors: DataFrame, test_fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Split by psmid, so that a spectrum is on one side."""
    return stable_split(vectors, "psmid", test_fraction)


def match_spectra(predictions: DataFrame, peprec: DataFrame, spectra: DataFrame, catalogue: Catalogue | None = None, precursor_tolerance: float = 0.02, peak_tolerance: float = 0.02, n: int = 3) -> DataFrame:
    """(spec_id, source_file, title): spectra that hold a peptide's ``n`` most intense predicted peaks."""
    rows = peprec.withColumn("prec_mz", precursor_mz(precursor_mass(F.col("peptide"), parse_mods(F.col("modifications")), catalogue or Catalogue()), F.col("charge")))
    gathered = predictions.groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct("ion", "ionnumber", "mz", "prediction"))).alias("p"))
    tops = gathered.select("spec_id", top_peaks(F.col("p.mz"), F.col("p.prediction"), n).alias("top_mzs"))
    observed = spectra.select("title", "source_file", "precursor_mz", F.sort_array(F.transform("peaks", lambda p: p["mz"].cast("double"))).alias("mzs"))
    return match_tables(observed, rows.select("spec_id", "prec_mz").join(tops, "spec_id"), precursor_tolerance, peak_tolerance)


def _digested(proteins: DataFrame, config: LibraryConfig) -> DataFrame:
    held = with_decoys(proteins) if config.add_decoys else proteins
    return digest(held, config.cleavage_rule, config.missed_cleavages, config.min_length, config.max_length, config.semi_specific)


def search_space(proteins: DataFrame, config: LibraryConfig, found: DataFrame | None = None) -> DataFrame:
    """Peptidoforms of a proteome: digestion, one row per sequence, modification versions and charges.

    Each has its peptide's number of proteins and the first of them; ``found`` is the digest, if it is at hand.
    """
    peptides = unique_peptides(_digested(proteins, config) if found is None else found)
    forms = peptidoforms(peptides, config.modifications, config.charges, config.max_variable_modifications)
    if config.min_precursor_mz is not None and config.max_precursor_mz is not None:
        mz = precursor_mz(precursor_mass(F.col("peptide"), parse_mods(F.col("modifications")), config.catalogue()), F.col("charge"))
        forms = forms.where(in_window(mz, config.min_precursor_mz, config.max_precursor_mz))
    return forms.select("spec_id", "peptide", "modifications", "charge", "n_proteins", "protein")


def build_library(proteins: DataFrame, nodes: pd.DataFrame, config: LibraryConfig, retention: RetentionPredictor | None = None, path: str | None = None, single_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, predictions) of a proteome's library, written in the configured formats if a path is given.

    One plan from proteins to ions; partitions take the place of batches.
    """
    found = stored_table(_digested(proteins, config), "digest")
    records = search_space(proteins, config, found)
    if retention is not None:
        records = retention(records)
    version = model(config.model).version
    predictions = predict(records, nodes, config.catalogue(), version)
    records = with_proteins(records, found, "protein_list")
    if path is not None:
        write_results(predictions, records, path, config.output_filetypes, single_file=single_file, catalogue=config.catalogue())
    return records, predictions


def predict_one(spark, peptide: str, modifications: str, charge: int, nodes: pd.DataFrame, catalogue: Catalogue | None = None, version: str = "general") -> DataFrame:
    """(ion annotation, mz, intensity) of one peptide, TIC shares: the same plan over one row."""
    if not re.match(SEQUENCE, peptide):
        raise InvalidPeptide(f"not a sequence of 3 to 99 residues: {peptide!r}")
    if not re.match(MOD_STRING, modifications):
        raise InvalidPeptide(f"not a modification string: {modifications!r}")
    rows = spark.createDataFrame([("one", peptide, modifications.removesuffix("|") or "-", charge)], "spec_id string, peptide string, modifications string, charge int")
    values = predict(rows, nodes, catalogue, version, strict=True)
    linear = values.withColumn("prediction", unlog(F.col("prediction"), clip=False))
    return normalise(linear, "tic").select(F.concat(F.lower("ion"), F.col("ionnumber").cast("string")).alias("annotation"), "mz", F.col("prediction").alias("intensity"))


def label_of(model_name: str) -> str | None:
    """Reporter ions to remove for a model, if any."""
    return LABELS.get(model_name)


__all__ = ["PSEUDO", "InvalidPeptide", "NoValidPeptides", "build_library", "evaluate", "feature_vectors", "keyed_interval_max", "match_spectra", "median_correlations", "predict", "predict_one", "search_space", "train_test", "with_targets"]
