"""What a run reports of itself, observed on the running plan without a further pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.mods import parse_mods
from ..operators.peptides import MAX_LENGTH, MIN_LENGTH
from ..functions.residues import INVALID_RESIDUES


class NoValidPeptides(ValueError):
    """No record is left after filtering."""


class InvalidPeptide(ValueError):
    """A single peptide or its modifications cannot be predicted."""


class EmptySpectra(ValueError):
    """No spectrum with peaks is left."""


@dataclass
class RunMetrics:
    """Counts of records and spectra, by why they were left out; known once the plan that was watched has run.

    A record counts under the first reason that holds: no peptide, residues without a mass, length,
    modifications that are not in the catalogue.
    """

    records: Observation = field(default_factory=lambda: Observation())
    spectra: Observation = field(default_factory=lambda: Observation())

    def watch(self, peprec: DataFrame, known: tuple[str, ...]) -> DataFrame:
        peptide = F.col("peptide")
        blank = F.col("modifications").isNull() | F.col("modifications").isin("", "-") if "modifications" in peprec.columns else F.lit(True)
        foreign = ~blank & F.exists(parse_mods(F.col("modifications")), lambda m: ~m["name"].isin(*known) if known else F.lit(True)) if "modifications" in peprec.columns else F.lit(False)
        reason = (
            F.when(peptide.isNull(), "no_peptide")
            .when(peptide.rlike(f"[{INVALID_RESIDUES}]"), "invalid_residue")
            .when(~F.char_length(peptide).between(MIN_LENGTH, MAX_LENGTH), "length")
            .when(foreign, "unknown_modification")
            .otherwise("kept")
        )
        counts = [F.count(F.when(reason == r, 1)).alias(r) for r in ("no_peptide", "invalid_residue", "length", "unknown_modification", "kept")]
        return peprec.observe(self.records, F.count(F.lit(1)).alias("records"), *counts)

    def watch_spectra(self, spectra: DataFrame) -> DataFrame:
        """Spectra, those without peaks, and the tasks that read them."""
        empty = F.coalesce(F.size("peaks") <= 0, F.lit(True))
        counts = [F.count(F.lit(1)).alias("spectra"), F.count(F.when(empty, 1)).alias("empty"), F.approx_count_distinct("_task").alias("tasks")]
        return spectra.withColumn("_task", F.spark_partition_id()).observe(self.spectra, *counts).drop("_task")

    def check_records(self) -> dict:
        """The counts of records; an error if none was kept."""
        got = self.records.get
        if not got["kept"]:
            raise NoValidPeptides(f"no valid peptide among {got['records']} records: {', '.join(f'{k} {v}' for k, v in got.items() if v and k != 'records') or 'the table is empty'}")
        return got

    def check_spectra(self) -> dict:
        """The counts of spectra with the mean a task has read; an error if none has peaks."""
        got = dict(self.spectra.get)
        if got["spectra"] == got["empty"]:
            raise EmptySpectra(f"none of {got['spectra']} spectra has peaks")
        return got | {"spectra_per_task": got["spectra"] / max(1, got["tasks"])}
