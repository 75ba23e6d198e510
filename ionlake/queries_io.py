"""Registered queries of sources and sinks: the driver's rows go out in a format and come back; SQL reads the table itself.

Files lie in the session's checkpoint folder, so every executor reads what another has written.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.metrics import share_log_corr
from .plans.pipeline import median_correlations
from .plans.storage import new_path
from .plans.trees import boosted_json, forest_expression, read_boosted_json, toy_nodes
from .queries import CATALOGUE, R_SQL, _predictions, _wide, query, table
from .sinks.libraries import csv_rows, predictions_and_targets, write_mgf_spectra, write_peprec, write_table
from .sinks.spectrum_store import read_spectrum_store, write_spectrum_store
from .sources.peptides import any_case, count_fasta, read_calibration, read_fasta, read_peprec, with_spectrum_charges
from .sources.spectra import mgf_headers, read_spectra
from .sources.tables import masses_to_mods, read_list_table, read_mztab, read_prediction_csv, read_tsv

RESIDUE_SQL = "upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g'))"


def _residues():
    return F.upper(F.regexp_replace("p_type", "[^A-Za-z]", ""))


def _fasta(spark, sf_dir, name: str) -> str:
    """Part types as wrapped sequences; the descriptions hold the character that begins a record."""
    path = new_path(spark, name)
    sequence = F.regexp_replace(_residues(), "(.{6})", "$1\n")
    table(spark, sf_dir, "part").select(F.concat(F.lit(">"), F.col("p_partkey"), F.lit(" "), "p_name", F.lit(" 5->3\n"), sequence).alias("value")).write.text(path)
    return path


@query("fasta_scan", f"SELECT CAST(p_partkey AS VARCHAR) AS protein, p_partkey || ' ' || p_name || ' 5->3' AS description, {RESIDUE_SQL} AS sequence FROM part")
def fasta_scan(spark, sf_dir):
    return read_fasta(spark, _fasta(spark, sf_dir, "fasta_scan"))


@query("fasta_count", "SELECT count(*) AS n FROM part")
def fasta_count(spark, sf_dir):
    return spark.createDataFrame([(count_fasta(spark, _fasta(spark, sf_dir, "fasta_count")),)], "n long")


PEPREC_SQL = f"SELECT CAST(p_partkey AS VARCHAR) AS spec_id, CASE WHEN p_size % 3 = 0 THEN '1|Oxidation' ELSE '-' END AS modifications, {RESIDUE_SQL} AS peptide, CAST(p_size % 4 + 1 AS BIGINT) AS charge FROM part"


def _peprec(spark, sf_dir):
    mods = F.when(F.col("p_size") % 3 == 0, "1|Oxidation").otherwise("-")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("spec_id"), mods.alias("modifications"), _residues().alias("peptide"), (F.col("p_size") % 4 + 1).alias("charge"))


@query("peprec_scan", PEPREC_SQL)
def peprec_scan(spark, sf_dir):
    path = new_path(spark, "peprec_scan")
    write_peprec(_peprec(spark, sf_dir), path)
    return _wide(read_peprec(spark, path))


@query("peprec_any_case", PEPREC_SQL)
def peprec_any_case(spark, sf_dir):
    path = new_path(spark, "peprec_any_case")
    write_peprec(_peprec(spark, sf_dir), f"{path}/records.PepRec")
    return _wide(read_peprec(spark, any_case(f"{path}/*.peprec")))


def _spectra(spark, sf_dir):
    """One spectrum a user: values by event number."""
    peaks = F.sort_array(F.collect_list(F.struct(F.col("event_id").cast("float").alias("mz"), F.col("value").cast("float").alias("intensity"))))
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(peaks.alias("peaks"))
    return grouped.select(F.col("user_id").cast("string").alias("title"), (F.col("user_id") + 0.5).alias("precursor_mz"), (F.col("user_id") % 3 + 1).cast("int").alias("precursor_charge"), "peaks", F.concat(F.lit("run"), F.col("user_id") % 4).alias("source_file"))


@query(
    "mgf_scan",
    "SELECT CAST(user_id AS VARCHAR) AS title, user_id + 0.5::DOUBLE AS precursor_mz, user_id % 3 + 1 AS precursor_charge, count(*) AS n_peaks, CAST(sum(event_id) AS DOUBLE) AS mzs, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 3) AS intensity FROM events WHERE value > 0 GROUP BY user_id",
)
def mgf_scan(spark, sf_dir):
    path = new_path(spark, "mgf_scan") + ".mgf"
    write_mgf_spectra(_spectra(spark, sf_dir), path)
    total = lambda c: F.aggregate(F.col(f"peaks.{c}"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _wide(read_spectra(spark, path).select("title", "precursor_mz", "precursor_charge", F.size("peaks").alias("n_peaks"), total("mz").alias("mzs"), F.round(total("intensity"), 3).alias("intensity")).where("n_peaks > 0"))


@query("mgf_header_scan", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS title, user_id % 3 + 1 AS precursor_charge FROM events WHERE user_id % 2 = 0")
def mgf_header_scan(spark, sf_dir):
    """Headers of the written spectra that a list of titles selects."""
    path = new_path(spark, "mgf_header_scan") + ".mgf"
    spectra = _spectra(spark, sf_dir)
    wanted = table(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("title"), F.concat(F.lit("run"), F.col("user_id") % 4).alias("source_file")).distinct()
    write_mgf_spectra(spectra.join(wanted, ["title", "source_file"], "left_semi"), path)
    return _wide(mgf_headers(spark, path))


@query("spectrum_charges", "SELECT CAST(c_custkey AS VARCHAR) AS spec_id, CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN c_custkey % 3 + 1 END AS charge FROM customer")
def spectrum_charges(spark, sf_dir):
    records = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("spec_id"))
    return _wide(with_spectrum_charges(records, _spectra(spark, sf_dir)))


@query("spectrum_store", "SELECT CAST(user_id AS VARCHAR) AS title, 'run' || (user_id % 4) AS source_file, user_id + 0.5::DOUBLE AS precursor_mz, count(*) AS n FROM events WHERE user_id + 0.5 BETWEEN 10 AND 40 GROUP BY user_id")
def spectrum_store(spark, sf_dir):
    path = new_path(spark, "spectrum_store")
    write_spectrum_store(_spectra(spark, sf_dir), path)
    return _wide(read_spectrum_store(spark, path, 10.0, 40.0).select("title", "source_file", "precursor_mz", F.size("mzs").alias("n")))


def _orders(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("spec_id"), F.lit(2).alias("charge"), F.col("o_orderstatus").alias("ion"), F.lit(1).alias("ionnumber"), F.col("o_totalprice").cast("float").alias("mz"),
        (F.col("o_totalprice") / 1000).alias("prediction"), F.col("o_custkey").cast("double").alias("target"),
    )
    return own.drop("target"), own.drop("prediction")


@query(
    "prediction_csv",
    "SELECT CAST(o_orderkey AS VARCHAR) AS spec_id, 2::BIGINT AS charge, o_orderstatus AS ion, 1::BIGINT AS ionnumber, round(CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE), 3) AS mz, CAST(o_custkey AS DOUBLE) AS target, round(o_totalprice / 1000, 9) AS prediction FROM orders",
)
def prediction_csv(spark, sf_dir):
    """Predictions and targets, joined, written and read."""
    path = new_path(spark, "prediction_csv")
    write_table(predictions_and_targets(*_orders(spark, sf_dir)), path)
    return _wide(read_prediction_csv(spark, path).withColumn("mz", F.round(F.col("mz").cast("double"), 3)).withColumn("prediction", F.round("prediction", 9)))


@query(
    "tic_csv_rows",
    "SELECT spec_id, count(*) AS n, round(sum(share), 3) AS share, CAST(max_by(k, share * 1000000 - k) AS BIGINT) AS largest FROM (SELECT l_orderkey AS spec_id, l_partkey * 10 + l_linenumber AS k, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS share FROM lineitem) GROUP BY 1",
)
def tic_csv_rows(spark, sf_dir):
    """TIC shares as the CSV sink writes them, six digits, added up again; the largest one keeps its place."""
    path = new_path(spark, "tic_csv_rows")
    own = _predictions(spark, sf_dir).withColumn("ionnumber", F.col("l_partkey") * 10 + F.col("l_linenumber"))
    write_table(csv_rows(own, log_space=False).select("spec_id", "ionnumber", "prediction"), path)
    rows = read_prediction_csv(spark, path)
    return _wide(
        rows.groupBy(F.col("spec_id").cast("long").alias("spec_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prediction"), 3).alias("share"), F.max_by("ionnumber", F.col("prediction") * 1000000 - F.col("ionnumber")).alias("largest"))
    )


SHARES = "SELECT l_returnflag AS ion, log2(l_extendedprice / sum(l_extendedprice) OVER w + 0.001) AS y, log2(l_quantity / sum(l_quantity) OVER w + 0.001) AS x FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)"


@query("share_log_corr", f"SELECT ion, round(corr(x, y), 6) AS pearsonr FROM ({SHARES}) GROUP BY ion")
def share_log_corr_query(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ion"), "l_quantity", "l_extendedprice")
    return share_log_corr(rows, ["ion"], "l_quantity", "l_extendedprice").select("ion", F.round("pearsonr", 6).alias("pearsonr"))


@query(
    "median_corr_by_charge",
    f"SELECT ion, charge, count(r) AS n, round(median(r), 6) AS median_r FROM (SELECT l_orderkey, l_linestatus AS ion, l_orderkey % 3 + 2 AS charge, {R_SQL} AS r FROM lineitem GROUP BY 1, 2) GROUP BY ion, charge",
)
def median_corr_by_charge(spark, sf_dir):
    from .functions.metrics import safe_corr

    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linestatus").alias("ion")).agg(safe_corr(F.col("l_quantity") * F.col("l_discount"), F.col("l_extendedprice")).alias("pearsonr"))
    got = median_correlations(each.withColumn("charge", F.col("l_orderkey") % 3 + 2), ("ion", "charge"))
    return got.select("ion", "charge", "n", F.round("median_r", 6).alias("median_r"))


@query("correlation_csv", "SELECT l_orderkey AS spec_id, l_returnflag AS ion, round(avg(l_discount), 6) AS pearsonr FROM lineitem GROUP BY 1, 2")
def correlation_csv(spark, sf_dir):
    path = new_path(spark, "correlation_csv")
    write_table(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("spec_id"), F.col("l_returnflag").alias("ion")).agg(F.avg("l_discount").alias("pearsonr")), path)
    return read_prediction_csv(spark, path).select(F.col("spec_id").cast("long").alias("spec_id"), "ion", F.round("pearsonr", 6).alias("pearsonr"))


@query("list_table", "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS DOUBLE) AS first, p_retailprice AS last, 3::BIGINT AS n FROM part")
def list_table(spark, sf_dir):
    path = new_path(spark, "list_table")
    literal = F.concat(F.lit("["), F.concat_ws(", ", F.col("p_size").cast("string"), F.lit("0.5"), F.col("p_retailprice").cast("string")), F.lit("]"))
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), literal.alias("values")).write.csv(path, header=True, sep="\t")
    return _wide(read_list_table(spark, path, ["values"]).select("id", F.get("values", F.lit(0)).alias("first"), F.element_at("values", -1).alias("last"), F.size("values").alias("n")))


@query("calibration_csv", f"SELECT {RESIDUE_SQL} AS peptide, '-' AS modifications, p_retailprice AS rt FROM part")
def calibration_csv(spark, sf_dir):
    path = new_path(spark, "calibration_csv")
    table(spark, sf_dir, "part").select(_residues().alias("seq"), F.lit(None).cast("string").alias("modifications"), F.col("p_retailprice").alias("tr")).write.csv(path, header=True)
    return read_calibration(spark, path)


@query("report_tsv", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status FROM orders")
def report_tsv(spark, sf_dir):
    path = new_path(spark, "report_tsv")
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status")).write.csv(path, header=True, sep="\t")
    return read_tsv(spark, path)


@query("mztab_scan", 'SELECT CAST(o_orderkey AS VARCHAR) AS "PSM_ID", o_orderpriority AS sequence, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS charge FROM orders')
def mztab_scan(spark, sf_dir):
    path = new_path(spark, "mztab_scan")
    rows = table(spark, sf_dir, "orders").select(F.concat_ws("\t", F.lit("PSM"), F.col("o_orderkey").cast("string"), "o_orderpriority", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("null")).alias("value"))
    spark.createDataFrame([("MTD\tmzTab-version\t1.0.0",), ("PSH\tPSM_ID\tsequence\tcharge",)], "value string").unionByName(rows).write.text(path)
    return read_mztab(spark, path)


@query(
    "mass_to_mods",
    """SELECT p_partkey, CASE WHEN p_size % 5 + 1 = 2 AND p_partkey % 2 = 0 THEN '2|Carbamidomethyl' WHEN p_size % 5 + 1 = 4 AND p_partkey % 2 = 1 THEN '4|Oxidation' ELSE '-' END AS modifications FROM part""",
)
def mass_to_mods(spark, sf_dir):
    """Masses at positions of one peptide, named by the catalogue."""
    mass = F.when(F.col("p_partkey") % 2 == 0, 57.021464).otherwise(15.994915)
    mods = F.array(F.struct((F.col("p_size") % 5 + 1).alias("pos"), mass.alias("mass")))
    return table(spark, sf_dir, "part").select("p_partkey", masses_to_mods(F.lit("ACDMK"), mods, CATALOGUE).alias("modifications"))


@query(
    "boosted_model",
    "SELECT vec_id, round(-5.0 + " + " + ".join(f"CASE WHEN embedding[{f + 1}] * 100 < {t} THEN {low} ELSE {high} END" for f, t, low, high in ((27, 3.0, -2.5, -0.5), (28, 4.0, -1.5, 0.25), (1, 3.0, 0.3, -0.6))) + " + 0.7, 6) AS score FROM embeddings",
)
def boosted_model(spark, sf_dir):
    """A saved boosted model, read back and scored; a feature beyond the vector is missing and goes to ``no``."""
    path = new_path(spark, "boosted_model")
    nodes = toy_nodes(("B",))
    spark.createDataFrame([(boosted_json(nodes),)], "value string").coalesce(1).write.text(path)
    held = read_boosted_json(spark, path, "B", "toy")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(forest_expression(held, F.transform("embedding", lambda x: x * 100)), 6).alias("score"))

