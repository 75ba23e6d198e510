"""Search-engine output to peptide records, library filters and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mods import add_fixed, format_mods, tagged_to_mods
from .peptides import is_tryptic, precursor_mass
from .windows import best_in_sequence, best_per_key, q_values

PAIRS = "array<struct<pos:int,name:string>>"


def maxquant_peprec(evidence: DataFrame, msms: DataFrame, tags: dict[str, str], fixed: dict[str, str] | None = None) -> DataFrame:
    """Best, unique target matches: spec_id, peptide, modifications, charge, protein_list, rt and raw file fields.

    Decoys and contaminants go; of rows with equal sequence, modified sequence and charge the
    highest score stays; two-letter tags become names by ``tags`` and ``fixed`` residues are added.
    """
    spectra = msms.select(F.col("id").alias("_id"), F.col("Scan number").alias("scan"), F.col("Scan index").alias("scan_index"))
    met = evidence.join(spectra, F.col("Best MS/MS") == F.col("_id"))
    flag = lambda c: F.coalesce(F.col(c), F.lit("")) == "+"
    own = met.where(~flag("Reverse") & ~flag("Potential contaminant")).withColumn("Score", F.col("Score").cast("double"))
    best = best_per_key(own, ["Sequence", "Modified sequence", "Charge"], [F.desc_nulls_last("Score"), F.col("_id").cast("long")])
    pairs = tagged_to_mods(F.col("Modified sequence"), tags)
    if fixed:
        pairs = add_fixed(F.col("Sequence"), pairs, fixed)
    return best.select(
        F.col("_id").alias("spec_id"),
        F.col("Sequence").alias("peptide"),
        format_mods(pairs).alias("modifications"),
        F.col("Charge").cast("int").alias("charge"),
        F.split("Proteins", ";").alias("protein_list"),
        F.col("Retention time").cast("double").alias("rt"),
        F.col("Raw file").alias("raw_file"),
        F.col("scan").cast("long").alias("scan"),
        F.col("Score").alias("score"),
        F.col("PEP").cast("double").alias("pep"),
    )


def expected_fdr(rows: DataFrame, pep: str = "pep") -> DataFrame:
    """Mean posterior error probability of the library: one row."""
    return rows.agg((F.sum(pep) / F.count(F.lit(1))).alias("fdr"))


def duplicate_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, distinct values and rows beyond the first of their value."""
    made = rows.agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(c).alias(f"d_{k}") for k, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"d_{k}").alias("n_distinct"), (F.col("n") - F.col(f"d_{k}")).alias("n_duplicates")) for k, c in enumerate(columns)])
    return made.select(F.explode(each).alias("e")).select("e.*")


def mztab_mods(mods: Column, names: dict[str, str]) -> Column:
    """``pos-MOD:nnn,...`` to (pos + 1, name) pairs; null and unknown accessions give none."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    each = F.filter(F.split(F.coalesce(mods, F.lit("")), ","), lambda m: m.contains("-"))
    pairs = F.transform(each, lambda m: F.struct((F.substring_index(m, "-", 1).cast("int") + 1).alias("pos"), F.try_element_at(table, F.regexp_extract(m, r"-(.*)$", 1)).alias("name")))
    return F.filter(pairs, lambda m: m["name"].isNotNull())


def mztab_peprec(psms: DataFrame, names: dict[str, str]) -> DataFrame:
    """Best row of each PSM id by its search-engine score."""
    score = F.col("`search_engine_score[1]`").cast("double")
    rows = psms.withColumn("_score", score)
    best = best_per_key(rows, ["PSM_ID"], [F.desc_nulls_last("_score"), "sequence", "charge"])
    return best.select(
        F.col("PSM_ID").alias("spec_id"),
        F.col("sequence").alias("peptide"),
        format_mods(mztab_mods(F.col("modifications"), names)).alias("modifications"),
        F.col("charge").cast("int").alias("charge"),
        F.col("retention_time").try_cast("double").alias("rt"),
        F.col("_score").alias("score"),
    )


def report_label(label: Column) -> Column:
    """Target/decoy flags 0 and 1 to 1 and -1."""
    return F.when(label.cast("int") == 0, 1).when(label.cast("int") == 1, -1)


def report_sequence(modified: Column) -> Column:
    """struct<peptide, pairs> of report sequences such as ``ace-M<ox>C<cmm>K-COOH``.

    Tokens are an N-terminal prefix (``ace-``, ``pyro-``, ``NH2-``), residues, and tags ``<ox>``,
    ``<cmm>``, ``<deam>``, ``<phos>`` behind the residue they change; the C-terminal suffix goes.
    """
    names = F.create_map(*[F.lit(x) for x in ("ox", "Oxidation", "cmm", "Carbamidomethyl", "deam", "Deamidated", "phos", "Phospho")])
    ends = F.create_map(*[F.lit(x) for x in ("ace", "Acetyl", "pyro", "Pyro-glu")])
    start = F.regexp_extract(modified, r"^([A-Za-z0-9]+)-", 1)
    body = F.regexp_replace(F.regexp_replace(modified, r"^[A-Za-z0-9]+-", ""), r"-[A-Za-z0-9]+$", "")
    tokens = F.regexp_extract_all(body, F.lit(r"([A-Z](?:<[^>]*>)*)"), F.lit(1))
    tagged = F.transform(
        tokens,
        lambda t, i: F.transform(
            F.regexp_extract_all(t, F.lit(r"<([^>]*)>"), F.lit(1)), lambda g: F.struct((i + 1).cast("int").alias("pos"), F.try_element_at(names, g).alias("name"))
        ),
    )
    end = F.try_element_at(ends, start)
    first = F.when(end.isNotNull(), F.array(F.struct(F.lit(0).alias("pos"), end.alias("name")))).otherwise(F.array().cast(PAIRS))
    known = F.filter(F.flatten(tagged), lambda m: m["name"].isNotNull())
    return F.struct(F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "").alias("peptide"), F.concat(first, known.cast(PAIRS)).alias("pairs"))


def msp_to_pairs(mods: Column) -> Column:
    """``n/pos,residue,name/...`` to pairs with positions from 1; an iTRAQ at position 0 is N-terminal."""
    each = F.split(F.coalesce(mods, F.lit("0")), "/")
    fields = lambda m, k: F.get(F.split(m, ","), F.lit(k))

    def pair(m):
        pos, name = fields(m, 0).cast("int"), fields(m, 2)
        return F.struct(F.when((pos == 0) & name.startswith("iTRAQ"), 0).otherwise(pos + 1).alias("pos"), name.alias("name"))

    return F.transform(F.filter(F.slice(each, F.lit(2), F.size(each)), lambda m: m.contains(",")), pair)


def mass_check(peptide: Column, shift: Column, reported: Column, tolerance: float = 0.5) -> Column:
    """Whether the computed mass is within ``tolerance`` of a reported one."""
    return F.abs(precursor_mass(peptide) + shift - reported) <= tolerance


def store_psms(peptides: DataFrame, scores: DataFrame, decoy_peptides: DataFrame, decoy_scores: DataFrame) -> DataFrame:
    """Targets and decoys of a search store with their scores, flagged."""
    join = lambda p, s: p.join(s, "PeptideID")
    return join(peptides, scores).withColumn("is_decoy", F.lit(False)).unionByName(join(decoy_peptides, decoy_scores).withColumn("is_decoy", F.lit(True)), allowMissingColumns=True)


def store_fields(values: DataFrame, fields: DataFrame, wanted: list[str]) -> DataFrame:
    """Custom fields from entity-attribute-value rows, one column each."""
    return values.join(fields, "FieldID").groupBy("PeptideID").pivot("DisplayName", wanted).agg(F.first("FieldValue"))


def store_modifications(side_chain: DataFrame, terminal: DataFrame, names: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., PeptideID, modifications): ``pos|name`` strings in order of position; a terminal one is 0."""
    by = by or []
    side = side_chain.select(*by, "PeptideID", "AminoAcidModificationID", (F.col("Position") + 1).cast("int").alias("pos"))
    ends = terminal.select(*by, "PeptideID", F.col("TerminalModificationID").alias("AminoAcidModificationID"), F.lit(0).alias("pos"))
    named = side.unionByName(ends).join(names.select(*by, "AminoAcidModificationID", F.col("ModificationName").alias("name")), [*by, "AminoAcidModificationID"])
    return named.groupBy(*by, "PeptideID").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda m: F.concat(m["pos"].cast("string"), F.lit("|"), m["name"])), "|").alias("modifications"))


def store_spectra(headers: DataFrame, mass_peaks: DataFrame, files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., SpectrumID, Charge, Mass, FirstScan, LastScan, FileName): a store's spectra with the stems of their raw files."""
    by = by or []
    named = mass_peaks.select(*by, "MassPeakID", "FileID").join(files.select(*by, "FileID", file_stem(F.col("FileName")).alias("FileName")), [*by, "FileID"])
    return headers.select(*by, "SpectrumID", "Charge", "Mass", "FirstScan", "LastScan", "MassPeakID").join(named, [*by, "MassPeakID"]).drop("MassPeakID", "FileID")


#: The tables of a search store that search_store reads.
STORE_TABLES = ["Peptides", "PeptideScores", "Peptides_Decoy", "PeptideScores_Decoy", "AminoAcidModifications", "PeptidesAminoAcidModifications", "PeptidesTerminalModifications", "SpectrumHeaders", "MassPeaks", "FileInfos"]


def search_store(tables: dict[str, DataFrame], cutoff: float = 0.01, percolator: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, spectra) of search stores: PEPREC rows of the non-redundant PSMs, and the spectra that they name.

    ``tables`` are STORE_TABLES as read_sqlite gives them with ``file_col="store"``: ids count within their file.
    The q-value is that of targets over decoys by score within each file or, with ``percolator``, the custom
    field of that name (the tables CustomDataFields and CustomDataPeptides then have to be there). A PSM without
    modifications has ``-``; of a (peptide, modifications, charge), and then of a spectrum, the best is kept.
    """
    by = ["store"]
    if percolator is None:
        join = lambda p, s: tables[p].join(tables[s].select(*by, "PeptideID", F.col("ScoreValue").alias("score")), [*by, "PeptideID"])
        targets, decoys = join("Peptides", "PeptideScores"), join("Peptides_Decoy", "PeptideScores_Decoy")
        columns = [*by, "PeptideID", "SpectrumID", "Sequence", "score"]
        both = targets.select(*columns).withColumn("is_decoy", F.lit(False)).unionByName(decoys.select(*columns).withColumn("is_decoy", F.lit(True)))
        judged = q_values(both, "score", "is_decoy", ["PeptideID"], by).where(~F.col("is_decoy")).drop("is_decoy")
    else:
        fields = tables["CustomDataPeptides"].join(tables["CustomDataFields"], [*by, "FieldID"]).where(F.col("DisplayName") == percolator)
        held = fields.groupBy(*by, "PeptideID").agg(F.first("FieldValue").cast("double").alias("q_value"))
        judged = tables["Peptides"].select(*by, "PeptideID", "SpectrumID", "Sequence").join(held, [*by, "PeptideID"]).withColumn("score", -F.col("q_value"))
    good = judged.where(F.col("q_value") <= cutoff)
    mods = store_modifications(tables["PeptidesAminoAcidModifications"], tables["PeptidesTerminalModifications"], tables["AminoAcidModifications"], by)
    spectra = store_spectra(tables["SpectrumHeaders"], tables["MassPeaks"], tables["FileInfos"], by)
    whole = good.join(mods, [*by, "PeptideID"], "left").withColumn("modifications", F.coalesce("modifications", F.lit("-"))).join(spectra, [*by, "SpectrumID"])
    order = ["q_value", F.desc("score"), "store", "PeptideID"]
    best = best_in_sequence(whole, [["Sequence", "modifications", "Charge"], ["SpectrumID", "FileName"]], order)
    # one store's ids are enough; those of several are told apart by the file's stem
    stem = F.regexp_replace(F.element_at(F.split("store", "/"), -1), r"\.[A-Za-z]+$", "")
    named = best.withColumn("spec_id", F.concat_ws("_", stem, F.col("PeptideID").cast("string")))
    records = named.select("spec_id", "modifications", F.col("Sequence").alias("peptide"), F.col("Charge").cast("int").alias("charge"), "q_value", is_tryptic(F.col("Sequence")).alias("tryptic"))
    return records, named.select("spec_id", F.col("FileName").alias("source_file"), F.col("FirstScan").alias("scan"), "LastScan", "Mass")


def spectra_of_scans(spectra: DataFrame, listed: DataFrame, pattern: str = r'scan=(\d+)') -> DataFrame:
    """The spectra that a list (spec_id, source_file, scan) names by raw file and scan number, with spec_id as their title."""
    own = spectra.withColumn("source_file", file_stem(F.col("source_file"))).withColumn("scan", F.regexp_extract("title", pattern, 1).try_cast("bigint"))
    wanted = listed.select("spec_id", "source_file", F.col("scan").cast("bigint").alias("scan"))
    return own.join(wanted, ["source_file", "scan"]).withColumn("title", F.col("spec_id")).select(*spectra.columns)


def library_psms(psms: DataFrame, cutoff: float = 0.01, score: str = "score", run: list[str] | None = None) -> DataFrame:
    """Targets under the q-value cut-off, the best of each (peptide, modifications, charge), then of each spectrum; flagged tryptic."""
    judged = q_values(psms, score, "is_decoy", ["spec_id"], run)
    good = judged.where(~F.col("is_decoy") & (F.col("q_value") <= cutoff))
    best = best_in_sequence(good, [["peptide", "modifications", "charge"], ["spec_id"]], [F.desc(score), "spec_id"])
    return best.withColumn("tryptic", is_tryptic(F.col("peptide")))


def only_common_mods(mods: Column, allowed: tuple[str, ...] = ("Carbamidomethyl", "Oxidation")) -> Column:
    """Whether every modification of a string is one of ``allowed``."""
    names = F.filter(F.transform(F.split(mods, r"\|"), lambda x, i: F.when(i % 2 == 1, x)), lambda x: x.isNotNull())
    return mods.isin("-", "") | F.forall(names, lambda x: x.isin(*allowed))


def file_stem(path: Column) -> Column:
    """``C:\\data\\run1.raw`` to ``run1``."""
    return F.regexp_replace(F.substring_index(F.substring_index(path, "\\", -1), "/", -1), r"\.(raw|mzML|mgf)$", "")


def fasta_peprec(peptides: DataFrame, charges: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Digested peptides x charges, unmodified, with readable ids."""
    rows = peptides.withColumn("charge", F.explode(F.array(*[F.lit(z) for z in charges])))
    return rows.select(F.concat_ws("_", "protein", F.col("start").cast("string"), F.col("charge").cast("string")).alias("spec_id"), F.lit("-").alias("modifications"), "peptide", "charge")


def select_spectra(spectra: DataFrame, peprec: DataFrame, file_col: str = "source_file", title_col: str = "title") -> DataFrame:
    """Spectra that some record names by file and title."""
    wanted = peprec.select(F.col(file_col).alias("_f"), F.col(title_col).alias("_t"))
    return spectra.join(wanted, (F.col(file_col) == F.col("_f")) & (F.col(title_col) == F.col("_t")), "left_semi")
