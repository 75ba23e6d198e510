"""Registered queries of trained models, model sources, clustered stores, mzML, vector tables and library files."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from .functions.metrics import is_compared
from .functions.mods import MOD_STRING, SEQUENCE
from .operators.converters import maxquant_peprec, only_common_mods, search_store
from .operators.digest import LibraryModification, digest, peptidoforms
from .operators.features import site_features
from .operators.spectra import remove_precursor, remove_reporters
from .operators.windows import renamed_values
from .plans.boosting import BoostParams, fit_leafwise, score_vectors
from .plans.forest_code import forest_sql, read_forest_source, write_forest_source
from .plans.pipeline import with_targets
from .plans.storage import new_path
from .plans.trees import NODE_COLUMNS, score_sites
from .plans.vectors import read_vectors, write_vectors
from .queries import CATALOGUE, LIBRARY, _library, _wide, query, table
from .queries_io import _residues, _spectra
from .sinks.libraries import bibliospec, msp, protein_string, write_mgf_spectra
from .sinks.spectrum_store import match_store, write_spectrum_store
from .sources.spectra import read_mzml, spectra_in_folder
from .sources.tables import blib_spectra, encode_array, read_msp, read_tsv

#: The columns of lineitem that trees are fitted to, as whole numbers.
TREE_FEATURES = {"quantity": "l_quantity", "discount": "l_discount * 100", "tax": "l_tax * 100", "line": "l_linenumber"}
LEAVES, STEP, L2, GAMMA, MIN_ROWS = 4, 0.5, 1.0, 0.1, 50


def _line_vectors(spark, sf_dir):
    features = F.array(*[F.round(F.expr(e)).cast("int") for e in TREE_FEATURES.values()])
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("psmid"), F.lit(2).alias("charge"), F.col("l_linenumber").alias("site"), features.alias("features"), F.create_map(F.lit("B"), F.col("l_extendedprice") / 1000).alias("targets")
    )


def _leafwise_sql() -> str:
    """Best gain first, a split at a time: candidates are all values of all features in all leaves."""
    values = ", ".join(f"CAST(round({e}) AS INTEGER) AS {n}" for n, e in TREE_FEATURES.items())
    parts = [f"rows0 AS (SELECT {values}, l_extendedprice / 1000 AS y, avg(l_extendedprice / 1000) OVER () AS base, 0 AS node FROM lineitem)"]
    for k in range(LEAVES - 1):
        counted = " UNION ALL ".join(f"SELECT node, {f} AS f, {n} AS v, sum(base - y) AS g, CAST(count(*) AS DOUBLE) AS h FROM rows{k} GROUP BY node, {n}" for f, n in enumerate(TREE_FEATURES))
        score = lambda g, h: f"({g}) * ({g}) / ({h} + {L2})"
        gain = f"0.5 * ({score('bg', 'bh')} + {score('tg - bg', 'th - bh')} - {score('tg', 'th')}) - {GAMMA}"
        test = "CASE f " + " ".join(f"WHEN {f} THEN {n}" for f, n in enumerate(TREE_FEATURES)) + " END"
        parts += [
            f"counted{k} AS ({counted})",
            f"sides{k} AS (SELECT node, f, v, coalesce(sum(g) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bg, coalesce(sum(h) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bh, sum(g) OVER (PARTITION BY node, f) AS tg, sum(h) OVER (PARTITION BY node, f) AS th FROM counted{k} WINDOW w AS (PARTITION BY node, f ORDER BY v))",
            f"best{k} AS (SELECT node AS own, f, v FROM sides{k} WHERE bh >= {MIN_ROWS} AND th - bh >= {MIN_ROWS} ORDER BY {gain} DESC LIMIT 1)",
            f"rows{k + 1} AS (SELECT r.* REPLACE (CASE WHEN node = own THEN CASE WHEN {test} < v THEN {2 * k + 1} ELSE {2 * k + 2} END ELSE node END AS node) FROM rows{k} r, best{k})",
        ]
    tests = " UNION ALL ".join(f"SELECT CAST(f AS BIGINT) AS feature, CAST(v AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS leaf FROM best{k}" for k in range(LEAVES - 1))
    leaves = f"SELECT CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), round(-{STEP} * sum(base - y) / (count(*) + {L2}), 6) FROM rows{LEAVES - 1} GROUP BY node"
    return f"WITH {', '.join(parts)} {tests} UNION ALL {leaves}"


@query("leafwise_tree", _leafwise_sql())
def leafwise_tree(spark, sf_dir):
    """The first tree of a boosted forest: its tests and leaves."""
    params = BoostParams(trees=1, step=STEP, max_leaves=LEAVES, min_rows=MIN_ROWS, gamma=GAMMA, l2=L2)
    nodes = fit_leafwise(_line_vectors(spark, sf_dir), "B", "lines", params).nodes
    rows = [(None if pd.isna(r.feature) else int(r.feature), None if pd.isna(r.threshold) else float(r.threshold), None if pd.isna(r.leaf) else round(float(r.leaf), 6)) for r in nodes.itertuples()]
    return spark.createDataFrame(rows, "feature long, threshold double, leaf double")


@query("leafwise_errors")
def leafwise_errors(spark, sf_dir):
    """A forest stopped on held-out orders, scored on all lines: rows and mean error of each line number."""
    vectors = _line_vectors(spark, sf_dir)
    held = F.pmod(F.xxhash64("psmid"), F.lit(5)) == 0
    fitted = fit_leafwise(vectors.where(~held), "B", "lines", BoostParams(trees=8, max_leaves=12, patience=2), {"held": vectors.where(held)})
    scored = score_vectors(vectors.withColumn("charge", F.col("site")), fitted.nodes, "B")
    return scored.groupBy(F.col("charge").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"))


def _rule_forest(trees: int = 20, depth: int = 9) -> pd.DataFrame:
    """Complete trees of over 20,000 nodes by a rule."""
    rows = []
    for t in range(trees):
        for k in range(2 ** (depth + 1) - 1):
            if k >= 2**depth - 1:
                rows.append(("rule", "B", t, k, None, None, None, None, ((k * 37 + t * 11) % 101 - 50) / 64, 0.5))
            else:
                rows.append(("rule", "B", t, k, (k * 7 + t * 13) % 64, ((k * 29 + t * 17) % 41 - 20) / 2, 2 * k + 1, 2 * k + 2, None, 0.5))
    return pd.DataFrame(rows, columns=NODE_COLUMNS)


@query("forest_source_score", f"SELECT vec_id, round(0.5 + {' + '.join(forest_sql(_rule_forest(), 'CAST(embedding[{} + 1] AS DOUBLE) * 100'))}, 6) AS score FROM embeddings")
def forest_source_score(spark, sf_dir):
    """A forest of 20,460 nodes, written as source text, parsed again and scored in batches."""
    path = new_path(spark, "forest_source")
    write_forest_source(spark, _rule_forest(), path)
    nodes = read_forest_source(spark, path)
    features = F.transform("embedding", lambda x: x.cast("double") * 100)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0).alias("site"), features.alias("features"))
    return score_sites(rows, nodes, ("vec_id",)).select("vec_id", F.round("p_B", 6).alias("score"))


@query(
    "store_islands",
    """WITH p AS (SELECT c_custkey, c_custkey % 997 + 0.5 AS mz, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 3 % 1000 END AS peak FROM customer WHERE c_custkey % 5 = 0)
SELECT CAST(c_custkey AS VARCHAR) AS spec_id, 'run' || (user_id % 4) AS source_file, CAST(user_id AS VARCHAR) AS title
FROM p JOIN (SELECT user_id, list(CAST(CAST(event_id AS FLOAT) AS DOUBLE)) AS mzs FROM events GROUP BY user_id) u ON user_id + 0.5 > mz - 0.6 AND user_id + 0.5 < mz + 0.6
WHERE peak IS NULL OR list_contains(mzs, CAST(peak AS DOUBLE))""",
)
def store_islands(spark, sf_dir):
    """Predicted precursors probe a store that is clustered by m/z; those with a peak have to hold it."""
    path = new_path(spark, "store_islands")
    write_spectrum_store(_spectra(spark, sf_dir), path, slice_spectra=100)
    peak = F.when(F.col("c_custkey") % 2 == 0, F.array((F.col("c_custkey") * 3 % 1000).cast("double"))).otherwise(F.array().cast("array<double>"))
    wanted = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("spec_id"), (F.col("c_custkey") % 997 + 0.5).cast("double").alias("prec_mz"), peak.alias("top_mzs"))
    return match_store(spark, path, wanted, 0.6)


def _mzml_lines(batches):
    """The lines of an mzML file: its head with parameter groups, an element for each spectrum, and its end."""
    import base64
    import struct
    import zlib

    head = '<mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList count="3">'
    for name, params in {"level1": [("MS:1000511", "1")], "level2": [("MS:1000511", "2")], "packed": [("MS:1000523", ""), ("MS:1000574", "")]}.items():
        head += f'<referenceableParamGroup id="{name}">' + "".join(f'<cvParam accession="{a}" value="{v}"/>' for a, v in params) + "</referenceableParamGroup>"
    lines = [head + "</referenceableParamGroupList><run><spectrumList>"]
    for batch in batches:
        for title, mz, charge, peaks in zip(*(batch.column(c).to_pylist() for c in ("title", "precursor_mz", "precursor_charge", "peaks")), strict=True):
            wide = charge != 2  # half of the arrays in double precision and packed, by the group
            arrays = ""
            for kind, values in (("MS:1000514", [p["mz"] for p in peaks]), ("MS:1000515", [p["intensity"] for p in peaks])):
                raw = struct.pack(f"<{len(values)}{'d' if wide else 'f'}", *values)
                params = '<referenceableParamGroupRef ref="packed"/>' if wide else '<cvParam accession="MS:1000521"/>'
                arrays += f'<binaryDataArray>{params}<cvParam accession="{kind}"/><binary>{base64.b64encode(zlib.compress(raw) if wide else raw).decode()}</binary></binaryDataArray>'
            ion = f'<selectedIon><cvParam accession="MS:1000744" value="{mz}"/><cvParam accession="MS:1000041" value="{charge}"/></selectedIon>'
            lines.append(f'<spectrum id="{title}"><referenceableParamGroupRef ref="level{1 if charge == 1 else 2}"/><precursorList><precursor><selectedIonList>{ion}</selectedIonList></precursor></precursorList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum>')
            if len(lines) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
                lines = []
    yield pa.RecordBatch.from_arrays([pa.array([*lines, "</spectrumList></run></mzML>"], pa.string())], names=["value"])


@query(
    "mzml_scan",
    "SELECT CAST(user_id AS VARCHAR) AS title, user_id + 0.5::DOUBLE AS precursor_mz, user_id % 3 + 1 AS precursor_charge, count(*) AS n_peaks, CAST(sum(CAST(CAST(event_id AS FLOAT) AS DOUBLE)) AS DOUBLE) AS mzs, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS intensity FROM events WHERE user_id % 3 > 0 GROUP BY user_id",
)
def mzml_scan(spark, sf_dir):
    """Written mzML files whose spectra take level, width and packing from parameter groups, read back."""
    path = new_path(spark, "mzml_scan")
    _spectra(spark, sf_dir).mapInArrow(_mzml_lines, "value string").write.text(path)
    total = lambda c: F.aggregate(F.col(f"peaks.{c}"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _wide(read_mzml(spark, path).select("title", "precursor_mz", "precursor_charge", F.size("peaks").alias("n_peaks"), total("mz").alias("mzs"), F.round(total("intensity"), 3).alias("intensity")))


@query(
    "vector_table",
    """WITH p AS (SELECT p_partkey, length(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS n, p_size % 4 + 1 AS charge FROM part)
SELECT CAST(charge AS BIGINT) AS charge, count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS lengths, CAST(sum(i + 1) AS BIGINT) AS prefixes, round(sum(i * 0.5), 3) AS target FROM (SELECT *, unnest(range(n - 1)) AS i FROM p) WHERE charge > 1 GROUP BY charge""",
)
def vector_table(spark, sf_dir):
    """Vectors written by charge and read back with three of their columns."""
    records = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("psmid"), _residues().alias("peptide"), (F.col("p_size") % 4 + 1).cast("int").alias("charge"))
    rows = site_features(records, keep=("psmid", "peptide", "charge")).withColumn("targets", F.create_map(F.lit("B"), F.col("site") * 0.5))
    path = new_path(spark, "vector_table")
    write_vectors(rows, path, ["B"])
    held = read_vectors(spark, path, ions=["B"], charges=[2, 3, 4], only={0, 27})
    return _wide(held.groupBy("charge").agg(F.count(F.lit(1)).alias("n_sites"), F.sum(F.get("features", F.lit(0))).alias("lengths"), F.sum(F.get("features", F.lit(27))).alias("prefixes"), F.round(F.sum(F.col("targets")["B"]), 3).alias("target")))


@query("msp_scan", f"WITH {LIBRARY} SELECT 'ACDMK/2' AS name, 'ACDMK' AS peptide, 2::BIGINT AS charge, '1/3,M,Oxidation' AS mods, count(*) AS n_peaks, round(sum(CAST(CAST(mz AS FLOAT) AS DOUBLE)), 3) AS mzs FROM ions GROUP BY s")
def msp_scan(spark, sf_dir):
    """A library written as MSP and read back."""
    path = new_path(spark, "msp_scan")
    msp(*_library(spark, sf_dir), CATALOGUE, log_space=False).select("value").write.text(path)
    total = F.aggregate(F.col("peaks.mz"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _wide(read_msp(spark, path).select("name", "peptide", "charge", "mods", "n_peaks", F.round(total, 3).alias("mzs")))


@query(
    "ssl_rows",
    f"WITH {LIBRARY} SELECT 'predictions.ms2' AS file, row_number() OVER (ORDER BY s) - 1 + 5 AS scan, 'ACDM[+16.0]K' AS sequence, count(*) AS n_peaks FROM ions GROUP BY s",
)
def ssl_rows(spark, sf_dir):
    """SSL rows with the MS2 blocks of the same scan numbers."""
    ssl, ms2 = bibliospec(*_library(spark, sf_dir), CATALOGUE, log_space=False, start=5)
    blocks = ms2.select("scan", F.size(F.filter(F.split("value", "\n"), lambda x: x.rlike("^[0-9]"))).alias("n_peaks"))
    return _wide(ssl.select("file", "scan", "sequence").join(blocks, "scan"))


#: Search stores made of orders: two files of PSMs; finished orders are the decoys.
STORE_SQL = """p AS (SELECT 'run' || (o_custkey % 2) || '.msf' AS store, o_orderkey AS id, o_custkey AS spectrum, CASE o_orderkey % 3 WHEN 0 THEN 'ACDMK' WHEN 1 THEN 'MNPQR' ELSE 'GGMA' END AS seq, o_totalprice AS score, o_orderstatus = 'F' AS decoy FROM orders),
judged AS (SELECT *, CAST(sum(CAST(decoy AS INT)) OVER w AS DOUBLE) / nullif(sum(CAST(NOT decoy AS INT)) OVER w, 0) AS q FROM p WINDOW w AS (PARTITION BY store ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
mods AS (SELECT l_orderkey AS id, string_agg(pos || '|' || name, '|' ORDER BY pos, name) AS mods FROM (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber END AS pos, CASE WHEN l_linenumber = 7 THEN 'Acetyl' ELSE 'Oxidation' END AS name FROM lineitem WHERE l_linenumber IN (5, 7)) GROUP BY 1),
good AS (SELECT j.*, coalesce(mods, '-') AS mods, 2 + spectrum % 2 AS charge, 'raw' || (spectrum % 5) AS file FROM judged j LEFT JOIN mods USING (id) WHERE NOT decoy AND q <= 0.9)"""


@query(
    "search_store_records",
    f"""WITH {STORE_SQL}, first AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY seq, mods, charge ORDER BY q, score DESC, store, id) = 1),
best AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY spectrum, file ORDER BY q, score DESC, store, id) = 1)
SELECT replace(store, '.msf', '') || '_' || id AS spec_id, mods AS modifications, seq AS peptide, CAST(charge AS BIGINT) AS charge, regexp_matches(seq, '[KR]$') AS tryptic, file AS source_file, CAST(spectrum + 100 AS BIGINT) AS scan FROM best""",
)
def search_store_records(spark, sf_dir):
    """The star of two search stores: q-values by store, modifications, headers, mass peaks and raw files."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    store = lambda key: F.concat(F.lit("run"), F.col(key) % 2, F.lit(".msf"))
    sequence = F.when(F.col("o_orderkey") % 3 == 0, "ACDMK").when(F.col("o_orderkey") % 3 == 1, "MNPQR").otherwise("GGMA")
    psms = orders.select(store("o_custkey").alias("store"), F.col("o_orderkey").alias("PeptideID"), F.col("o_custkey").alias("SpectrumID"), sequence.alias("Sequence"), F.col("o_totalprice").alias("ScoreValue"), "o_orderstatus")
    marked = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), store("o_custkey").alias("store")), "l_orderkey")
    stores = orders.select(store("o_custkey").alias("store"), F.col("o_custkey").alias("SpectrumID")).distinct()
    names = stores.select("store").distinct()
    tables = {
        "PeptidesAminoAcidModifications": marked.where("l_linenumber = 5").select("store", F.col("l_orderkey").alias("PeptideID"), F.lit(1).alias("AminoAcidModificationID"), (F.col("l_linenumber") - 1).alias("Position")).distinct(),
        "PeptidesTerminalModifications": marked.where("l_linenumber = 7").select("store", F.col("l_orderkey").alias("PeptideID"), F.lit(2).alias("TerminalModificationID")).distinct(),
        "AminoAcidModifications": names.select("store", F.explode(F.expr("map(1, 'Oxidation', 2, 'Acetyl')")).alias("AminoAcidModificationID", "ModificationName")),
        "SpectrumHeaders": stores.select("store", "SpectrumID", (2 + F.col("SpectrumID") % 2).alias("Charge"), F.lit(500.5).alias("Mass"), (F.col("SpectrumID") + 100).alias("FirstScan"), (F.col("SpectrumID") + 100).alias("LastScan"), (F.col("SpectrumID") + 7).alias("MassPeakID")),
        "MassPeaks": stores.select("store", (F.col("SpectrumID") + 7).alias("MassPeakID"), (F.col("SpectrumID") % 5).alias("FileID")),
        "FileInfos": names.select("store", F.explode(F.expr("sequence(0L, 4L)")).alias("FileID")).withColumn("FileName", F.concat(F.lit("D:\\data\\raw"), "FileID", F.lit(".raw"))),
    }
    for suffix, test in (("", "o_orderstatus <> 'F'"), ("_Decoy", "o_orderstatus = 'F'")):
        own = psms.where(test)
        tables["Peptides" + suffix], tables["PeptideScores" + suffix] = own.select("store", "PeptideID", "SpectrumID", "Sequence"), own.select("store", "PeptideID", "ScoreValue")
    records, listed = search_store(tables, 0.9)
    return _wide(records.join(listed, "spec_id").select("spec_id", "modifications", "peptide", "charge", "tryptic", "source_file", "scan"))


def _observed(spark, sf_dir):
    """A spectrum for every order: peaks on and beside the b and y ions of ACDMK, by the order's lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct((F.col("l_linenumber") * 72.044).cast("float").alias("mz"), F.col("l_quantity").cast("float").alias("intensity")))).alias("peaks"))
    return lines.select(F.concat(F.lit("order="), F.col("l_orderkey").cast("string")).alias("title"), F.lit(300.5).alias("precursor_mz"), F.lit(2).alias("precursor_charge"), "peaks", F.lit("run").alias("source_file"))


@query(
    "spectrum_targets",
    """WITH raw AS (SELECT l_orderkey AS k, l_linenumber AS line, CAST(CAST(l_linenumber * 72.044 AS FLOAT) AS DOUBLE) AS mz, l_quantity AS q FROM lineitem),
logged AS (SELECT *, log2(q / sum(q) OVER (PARTITION BY k) + 0.001) AS x FROM raw),
b1 AS (SELECT k, max(x) AS x FROM logged WHERE mz BETWEEN 72.04435 - 0.02 AND 72.04435 + 0.02 GROUP BY k)
SELECT CAST(o_orderkey AS VARCHAR) AS spec_id, 'B' AS ion, 1::BIGINT AS ionnumber, round(coalesce(x, log2(0.001)), 3) AS target FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN b1 ON k = o_orderkey""",
)
def spectrum_targets(spark, sf_dir):
    """Observed spectra joined to their records by the id in the title, and the peak found for the first prefix ion."""
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("spec_id"), F.lit("ACDMK").alias("peptide"), F.lit("-").alias("modifications"), F.lit(2).alias("charge"))
    found = with_targets(records, _observed(spark, sf_dir), CATALOGUE, pattern="order=(.*)")
    return _wide(found.where("ion = 'B' AND ionnumber = 1").select("spec_id", "ion", "ionnumber", F.round(F.col("target").cast("double"), 3).alias("target")))




@query(
    "evidence_records",
    """WITH e AS (SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'ACDMK' WHEN 1 THEN 'MNPQR' ELSE 'GGMA' END AS seq, CASE o_custkey % 3 WHEN 0 THEN '4|Oxidation' WHEN 1 THEN '0|Acetyl' ELSE '-' END AS own, o_custkey % 4 + 1 AS charge, o_totalprice AS score, o_orderkey * 2 AS scan FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'),
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY seq, charge ORDER BY score DESC, id) = 1)
SELECT CAST(id AS VARCHAR) AS spec_id, seq AS peptide, CASE WHEN seq = 'ACDMK' THEN '2|Carbamidomethyl|4|Oxidation' ELSE own END AS modifications, CAST(charge AS BIGINT) AS charge, 'P' || charge || '/Q' AS proteins, CAST(scan AS BIGINT) AS scan, round(score, 2) AS score FROM best""",
)
def evidence_records(spark, sf_dir):
    """Search-engine tables written as text, read back and joined: decoys and contaminants go, the best of each form stays."""
    own = table(spark, sf_dir, "orders")
    sequence = F.when(F.col("o_custkey") % 3 == 0, "ACDMK").when(F.col("o_custkey") % 3 == 1, "MNPQR").otherwise("GGMA")
    tagged = F.when(F.col("o_custkey") % 3 == 0, "_ACDM(ox)K_").when(F.col("o_custkey") % 3 == 1, "_(ac)MNPQR_").otherwise("_GGMA_")
    charge = F.col("o_custkey") % 4 + 1
    plus = lambda test: F.when(F.expr(test), "+").otherwise("")
    evidence = own.select(
        F.col("o_orderkey").alias("Best MS/MS"), sequence.alias("Sequence"), tagged.alias("Modified sequence"), charge.alias("Charge"), F.concat(F.lit("P"), charge, F.lit(";Q")).alias("Proteins"),
        F.lit(12.5).alias("Retention time"), F.lit("run").alias("Raw file"), F.col("o_totalprice").alias("Score"), F.lit(0.01).alias("PEP"), plus("o_orderstatus = 'F'").alias("Reverse"), plus("o_orderpriority = '5-LOW'").alias("Potential contaminant"),
    )
    msms = own.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 2).alias("Scan number"), F.lit(0).alias("Scan index"))
    paths = [new_path(spark, n) for n in ("evidence", "msms")]
    for rows, path in zip((evidence, msms), paths):
        rows.write.csv(path, sep="\t", header=True)
    records = maxquant_peprec(*(read_tsv(spark, p) for p in paths), {"ox": "Oxidation", "ac": "Acetyl"}, {"C": "Carbamidomethyl"})
    return _wide(records.select("spec_id", "peptide", "modifications", "charge", protein_string(F.col("protein_list")).alias("proteins"), "scan", F.round("score", 2).alias("score")))


@query(
    "spectra_of_folder",
    "SELECT CAST(user_id AS VARCHAR) AS title, user_id % 3 + 1 AS precursor_charge, count(*) AS n_peaks FROM events WHERE value > 0 GROUP BY user_id",
)
def spectra_of_folder(spark, sf_dir):
    """A folder of spectrum files, read as one table."""
    folder, spectra = new_path(spark, "folder"), _spectra(spark, sf_dir)
    for k in range(2):
        write_mgf_spectra(spectra.where(F.col("title").cast("long") % 2 == k), f"{folder}/part{k}.mgf")
    return _wide(spectra_in_folder(spark, folder).select("title", "precursor_charge", F.size("peaks").alias("n_peaks")).where("n_peaks > 0"))


@query(
    "precursor_removed",
    """WITH p AS (SELECT user_id, CAST(CAST(event_id AS FLOAT) AS DOUBLE) AS mz, CAST(value AS FLOAT) AS it FROM events)
SELECT CAST(user_id AS VARCHAR) AS title, count(*) AS n_peaks, count(*) FILTER (WHERE mz BETWEEN user_id * 3 + 0.5 - 2.0 AND user_id * 3 + 0.5 + 2.0 OR mz BETWEEN 125 AND 132) AS n_zero FROM p GROUP BY user_id""",
)
def precursor_removed(spark, sf_dir):
    """Peaks around the precursor and in the reporter range keep their place and lose their intensity."""
    spectra = _spectra(spark, sf_dir).withColumn("peaks", F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), F.lit(1.0).cast("float").alias("intensity"))))
    cleared = remove_reporters(remove_precursor(F.col("peaks"), F.col("title").cast("long") * 3 + 0.5, 2.0), "TMT")
    return _wide(spectra.select("title", F.size("peaks").alias("n_peaks"), F.size(F.filter(cleared, lambda p: p["intensity"] == 0)).alias("n_zero")))


@query(
    "library_forms",
    """WITH p AS (SELECT DISTINCT regexp_replace(upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') AS seq FROM part WHERE p_type IS NOT NULL),
n AS (SELECT seq, len(regexp_extract_all(seq, 'M')) AS m, len(regexp_extract_all(seq, 'S')) AS s, seq[1] = 'S' AS start FROM p),
v AS (SELECT *, m + s AS k FROM n)
SELECT seq AS peptide, 2 * CAST((1 + k + k * (k - 1) // 2) + (1 + k) AS BIGINT) AS n_forms FROM v""",
)
def library_forms(spark, sf_dir):
    """Modification versions and charges of each peptide: at most two variable ones among M, S and the N-terminus of the protein."""
    mods = [LibraryModification("Oxidation", 15.994915, "M"), LibraryModification("Phospho", 79.966331, "S"), LibraryModification("Acetyl", 42.010565, protein_n_term=True), LibraryModification("Carbamidomethyl", 57.021464, "C", fixed=True)]
    rows = table(spark, sf_dir, "part").select(F.regexp_replace(_residues(), "[BJOUXZ]", "").alias("peptide")).distinct().withColumns({"is_n_term": F.lit(True), "is_c_term": F.lit(False)})
    return peptidoforms(rows, mods, [2, 3], 2).groupBy("peptide").agg(F.countDistinct("spec_id").alias("n_forms"))


@query(
    "feature_variants",
    """WITH p AS (SELECT p_partkey, regexp_replace(translate(upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), 'L', 'I'), '[BJOUXZ]', '', 'g') AS seq, p_size AS ce FROM part),
c AS (SELECT *, list_transform(string_split(seq, ''), lambda a: strpos('ACDEFGHIKMNPQRSTVWY', a) - 1) AS r FROM p),
s AS (SELECT *, unnest(range(len(r) - 1)) AS i FROM c)
SELECT p_partkey, CAST(sum(ce) AS BIGINT) AS energies, CAST(sum(r[1]) AS BIGINT) AS firsts, CAST(sum(r[len(r)]) AS BIGINT) AS lasts, CAST(sum(CASE WHEN i = 0 THEN 0 ELSE r[i] END) AS BIGINT) AS befores, CAST(sum(r[i + 1]) AS BIGINT) AS ats FROM s GROUP BY p_partkey""",
)
def feature_variants(spark, sf_dir):
    """The layouts with a collision energy behind and with residue codes in front."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(_residues(), "[BJOUXZ]", "").alias("peptide"), F.lit(2).alias("charge"), F.col("p_size").alias("ce"))
    at = lambda k: F.sum(F.get("features", F.lit(k)))
    energies = site_features(rows, "ce", ("p_partkey", "peptide", "charge", "ce"), {139}).groupBy("p_partkey").agg(at(139).alias("energies"))
    coded = site_features(rows, "catboost", ("p_partkey", "peptide", "charge"), {0, 1, 2, 3}).groupBy("p_partkey").agg(at(0).alias("firsts"), at(1).alias("lasts"), at(2).alias("befores"), at(3).alias("ats"))
    return energies.join(coded, "p_partkey")


@query(
    "compared_ions",
    "SELECT CAST(l_linenumber AS BIGINT) AS charge, count(*) AS n FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4 AND l_returnflag || CASE WHEN l_linestatus = 'O' THEN '2' ELSE '' END <> 'A2' GROUP BY 1",
)
def compared_ions(spark, sf_dir):
    """The ions that published comparisons count, after labels were renamed."""
    ion = F.concat("l_returnflag", F.when(F.col("l_linestatus") == "O", "2").otherwise(""))
    rows = renamed_values(table(spark, sf_dir, "lineitem").withColumn("ion", ion), "ion", {"A2": "B2"})
    return _wide(rows.where(is_compared(F.col("l_linenumber"), F.col("ion"))).groupBy(F.col("l_linenumber").alias("charge")).agg(F.count(F.lit(1)).alias("n")))


@query(
    "valid_strings",
    """WITH p AS (SELECT p_partkey, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS seq, CASE p_size % 6 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '3|Oxidation' WHEN 3 THEN '0|Acetyl|-1|Amide|' WHEN 4 THEN '3|' ELSE '123|Oxidation' END AS mods FROM part)
SELECT p_partkey, NOT regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWY]') AND length(seq) BETWEEN 3 AND 99 AS good_sequence, p_size % 6 < 4 AS good_mods, p_size % 6 < 2 OR p_size % 6 = 2 AS only_common FROM p JOIN part USING (p_partkey)""",
)
def valid_strings(spark, sf_dir):
    """Sequences and modification strings against their grammars."""
    mods = F.when(F.col("p_size") % 6 == 0, "-").when(F.col("p_size") % 6 == 1, "").when(F.col("p_size") % 6 == 2, "3|Oxidation").when(F.col("p_size") % 6 == 3, "0|Acetyl|-1|Amide|").when(F.col("p_size") % 6 == 4, "3|").otherwise("123|Oxidation")
    common = only_common_mods(F.when(F.col("p_size") % 6 <= 3, mods).otherwise("0|Other"))
    return table(spark, sf_dir, "part").select("p_partkey", _residues().rlike(SEQUENCE).alias("good_sequence"), mods.rlike(MOD_STRING).alias("good_mods"), common.alias("only_common"))


@query(
    "packed_arrays",
    "SELECT user_id, count(*) AS n, CAST(sum(event_id) AS DOUBLE) AS mzs, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS intensity FROM events GROUP BY user_id",
)
def packed_arrays(spark, sf_dir):
    """Peak arrays packed as library stores hold them, and unpacked again."""
    def pack(batches):
        for batch in batches:
            peaks = batch.column("peaks").to_pylist()
            held = [pa.array([encode_array([float(p[c]) for p in own], code, "<") for own in peaks], pa.binary()) for c, code in (("mz", "d"), ("intensity", "f"))]
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), *held], names=["user_id", "peakMZ", "peakIntensity"])

    rows = _spectra(spark, sf_dir).select(F.col("title").cast("long").alias("user_id"), "peaks").mapInArrow(pack, "user_id long, peakMZ binary, peakIntensity binary")
    ref = rows.select(F.col("user_id").alias("id"), F.lit("ACDMK").alias("peptideSeq"), F.lit(2).alias("precursorCharge"), F.lit(500.5).alias("precursorMZ"))
    none = spark.createDataFrame([], "RefSpectraID long, position int, mass double")
    held = blib_spectra({"RefSpectra": ref, "Modifications": none, "RefSpectraPeaks": rows.withColumnRenamed("user_id", "RefSpectraID")})
    total = lambda c: F.aggregate(F.col(f"peaks.{c}"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _wide(held.select(F.col("id").alias("user_id"), F.size("peaks").alias("n"), total("mz").alias("mzs"), F.round(total("intensity"), 3).alias("intensity")))


@query(
    "digest_semi",
    """WITH p AS (SELECT p_partkey AS protein, upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')) AS seq FROM part),
c AS (SELECT *, string_split(regexp_replace(regexp_replace(seq, '(E)([^,])', '\\1,\\2', 'g'), '(E)([^,])', '\\1,\\2', 'g'), ',') AS cut FROM p),
piece AS (SELECT protein, seq, unnest(cut) AS piece, generate_subscripts(cut, 1) AS i FROM c),
placed AS (SELECT *, lead(piece) OVER w AS next, CAST(coalesce(sum(length(piece)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM piece WINDOW w AS (PARTITION BY protein ORDER BY i)),
spans AS (SELECT protein, seq, a, a + length(piece) AS b FROM placed UNION ALL SELECT protein, seq, a, a + length(piece) + length(next) FROM placed WHERE next IS NOT NULL),
ends AS (SELECT protein, seq, a AS s, a + k AS e FROM spans, range(5, 9) AS r(k) WHERE a + k <= b UNION SELECT protein, seq, b - k, b FROM spans, range(5, 9) AS r(k) WHERE b - k >= a)
SELECT protein, s AS start, substr(seq, s + 1, e - s) AS peptide, s = 0 AS is_n_term, e = length(seq) AS is_c_term FROM ends WHERE NOT regexp_matches(substr(seq, s + 1, e - s), '[BJOUXZ]')""",
)
def digest_semi(spark, sf_dir):
    """Every prefix and suffix of the peptides of another enzyme, each place once."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("protein"), _residues().alias("sequence"))
    return _wide(digest(rows, "gluc", missed_cleavages=1, min_length=5, max_length=8, semi_specific=True))
