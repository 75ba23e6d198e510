"""Plans end to end: prediction, evaluation, libraries, sinks, converters, configuration, streams."""

import json
import sqlite3
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake import cli
from ionlake.functions.mods import Catalogue, format_mods
from ionlake.functions.residues import FRAGMENT_MASS
from ionlake.operators import converters
from ionlake.operators.digest import LibraryModification
from ionlake.operators.features import site_features
from ionlake.plans import training
from ionlake.plans.config import LibraryConfig, PredictionConfig, UnknownModel, UnsupportedConfig, check_sha1, load_config, model, write_toml
from ionlake.plans.pipeline import InvalidPeptide, build_library, evaluate, feature_vectors, match_spectra, median_correlations, predict, predict_one, train_test, with_targets
from ionlake.plans.trees import Forest, forest_expression, importance, score_sites, toy_nodes
from ionlake.sinks.libraries import SINKS, bibliospec, mgf, msp, spectronaut, write_peprec, write_results
from ionlake.sinks.spectrum_store import read_spectrum_store, write_spectrum_store
from ionlake.sources.peptides import count_fasta, irt_peptides, read_fasta, read_peprec
from ionlake.sources.tables import blib_spectra, decode_array, encode_array, read_msp, read_mztab, read_sqlite, read_tsv

MODS = Catalogue.parse(["Oxidation,15.994915,opt,M", "Carbamidomethyl,57.021464,opt,C"])
SCHEMA = "spec_id string, peptide string, modifications string, charge int, rt double, protein_list array<string>"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([("p1", "ACDEK", "2|Carbamidomethyl", 2, 1.5, ["P1", "P2"]), ("p2", "LMNPQR", "-", 3, 2.0, ["P1"]), ("p3", "IMNPQR", "2|Oxidation", 3, None, [])], SCHEMA)


@pytest.fixture(scope="module")
def predictions(records):
    return predict(records, toy_nodes(), MODS).cache()


def test_predictions(predictions):
    got = {(r.spec_id, r.ion, r.ionnumber): r for r in predictions.collect()}
    assert len(got) == 2 * (4 + 5 + 5)
    # L and I, and modifications, do not change intensities; modifications change m/z
    assert got["p2", "B", 1].prediction == got["p3", "B", 1].prediction and got["p3", "B", 2].mz - got["p2", "B", 2].mz == pytest.approx(15.994915)
    assert got["p1", "B", 1].mz == pytest.approx(FRAGMENT_MASS["A"] + 1.007236)


def test_unknown_modifications(spark):
    rows = spark.createDataFrame([("a", "ACDEK", "1|Nothing", 2)], "spec_id string, peptide string, modifications string, charge int")
    assert predict(rows, toy_nodes(), MODS).count() == 0
    with pytest.raises(Exception, match="unknown modification"):
        predict(rows, toy_nodes(), MODS, strict=True).collect()


def test_evaluation(spark, records, predictions):
    peaks = predictions.where("spec_id <> 'p3'").groupBy("spec_id").agg(F.sort_array(F.collect_list(F.struct(F.col("mz").cast("float").alias("mz"), (F.pow(F.lit(2.0), "prediction") * 1000).cast("float").alias("intensity")))).alias("peaks"))
    spectra = peaks.select(F.concat(F.lit("id="), "spec_id").alias("title"), F.lit(None).cast("double").alias("precursor_mz"), F.lit(None).cast("int").alias("precursor_charge"), "peaks", F.lit("f").alias("source_file"))
    targets = with_targets(records, spectra, MODS, pattern="id=(.*)")
    got = evaluate(predictions, targets)
    assert {r.spec_id for r in got.collect()} == {"p1", "p2"} and all(r.pearsonr is None or r.pearsonr > 0.99 for r in got.collect())
    assert median_correlations(got).count() == 2
    vectors = feature_vectors(records, targets)
    rows = vectors.collect()
    assert len(rows) == 4 + 5 and all(set(r.targets) == {"B", "Y"} and len(r.features) == 139 for r in rows)
    y = {(r.spec_id, r.ionnumber): r.target for r in targets.where("ion = 'Y'").collect()}
    assert all(r.targets["Y"] == y[r.psmid, (5 if r.psmid == "p1" else 6) - 1 - r.site] for r in rows)
    a, b = train_test(vectors)
    assert a.count() + b.count() == 9


def test_matching(spark, records, predictions):
    from ionlake.operators.peptides import precursor_mass, precursor_mz

    peaks = predictions.where("spec_id = 'p2'").agg(F.collect_list(F.struct(F.col("mz").cast("float").alias("mz"), F.lit(1.0).cast("float").alias("intensity"))).alias("peaks"))
    spectra = peaks.select(F.lit("t").alias("title"), precursor_mz(precursor_mass(F.lit("LMNPQR")), F.lit(3)).alias("precursor_mz"), "peaks", F.lit("f").alias("source_file"))
    assert [tuple(r) for r in match_spectra(predictions, records, spectra, MODS).collect()] == [("p2", "f", "t")]


def test_single_peptide(spark):
    got = predict_one(spark, "ACDEK", "", 2, toy_nodes(), MODS).collect()
    assert {r.annotation for r in got} == {f"{i}{k}" for i in "by" for k in range(1, 5)} and sum(r.intensity for r in got) == pytest.approx(1)
    for peptide, mods in (("AXK", ""), ("ACDEK", "9|")):
        with pytest.raises(InvalidPeptide):
            predict_one(spark, peptide, mods, 2, toy_nodes(), MODS)


def test_trees(spark):
    nodes, rows = toy_nodes(), site_features(spark.createDataFrame([("ACDEK", 2)], "peptide string, charge int"))
    batch = {r.site: r.p_B for r in score_sites(rows, nodes, ("peptide",)).collect()}
    assert batch == {r.site: r.x for r in rows.select("site", forest_expression(nodes[nodes["ion"] == "B"], F.col("features")).alias("x")).collect()}
    assert Forest.from_nodes(nodes[nodes["ion"] == "B"]).score(np.zeros((1, 139)))[0] == pytest.approx(-5 - 2.5 - 1.5 + 0.3 - 0.2)
    assert importance(spark.createDataFrame(nodes)).agg(F.sum("n_tests")).first()[0] == 8


def test_training_exports_what_it_fits(spark):
    rng = np.random.default_rng(0)
    made = [(f"p{i}", 2, i % 3, [int(v) for v in rng.integers(0, 9, 6)]) for i in range(120)]
    rows = spark.createDataFrame([(p, z, s, f, {"B": float(f[0] > 4) + 0.1 * f[1]}) for p, z, s, f in made], "psmid string, charge int, site int, features array<int>, targets map<string,double>")
    fitted, nodes = training.train_ion(rows, "B", "m", trees=3, depth=2)
    want = [r.prediction for r in fitted.transform(training._assembled(rows, "B")).collect()]
    got = Forest.from_nodes(nodes).score(np.array([f for *_, f in made]))
    assert np.allclose(sorted(got), sorted(want))
    results = training.cross_validate(rows, "B", training.grid({"depth": [1, 2]}), folds=2, trees=2)
    assert results.count() == 2 and training.best_params(results).first().params == "{'depth': 2}"
    scored = spark.createDataFrame([("g", p, float(k), float(k * k)) for p in "ab" for k in range(4)], "g string, psmid string, target double, prediction double")
    assert len(training.psm_percentiles(scored, ["g"]).first().percentiles) == 5


PROTEINS = ">sp|P1|ONE first protein\nMACDEFGHIK\nLMNPQR\n>sp|P2|TWO second\nMACDEFGHIKWWWK\n"


def test_library(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(PROTEINS)
    path = str(tmp_path / "a.fasta")
    proteins = read_fasta(spark, path)
    assert {(r.protein, r.sequence) for r in proteins.collect()} == {("sp|P1|ONE", "MACDEFGHIKLMNPQR"), ("sp|P2|TWO", "MACDEFGHIKWWWK")}
    assert count_fasta(spark, path) == 2 and read_fasta(spark, path, decoys=True).count() == 4 and irt_peptides(spark).count() == 11
    config = LibraryConfig(min_length=5, missed_cleavages=0, charges=[2, 3], output_filetypes=["msp", "csv"])
    retention = lambda rows: rows.withColumn("rt", F.char_length("peptide") * 1.0)
    rows, ions = build_library(proteins, toy_nodes(), config, retention, str(tmp_path / "lib"))
    got = {(r.peptide, r.modifications, r.charge): r for r in rows.collect()}
    assert set(got) == {(p, m, z) for z in (2, 3) for p, m in (("MACDEFGHIK", "3|Carbamidomethyl"), ("MACDEFGHIK", "1|Oxidation|3|Carbamidomethyl"), ("LMNPQR", "-"), ("LMNPQR", "2|Oxidation"))}
    assert got["MACDEFGHIK", "3|Carbamidomethyl", 2].protein_list == ["sp|P1|ONE", "sp|P2|TWO"] and len({r.spec_id for r in got.values()}) == 8
    assert ions.count() == 2 * 2 * 2 * (9 + 5)
    library = read_msp(spark, str(tmp_path / "lib.msp"))
    assert library.count() == 8 and {(r.peptide, r.charge) for r in library.collect()} == {(p, z) for p in ("MACDEFGHIK", "LMNPQR") for z in (2, 3)}
    narrow = LibraryConfig(min_length=5, missed_cleavages=0, min_precursor_mz=0.0, max_precursor_mz=300.0)
    from ionlake.plans.pipeline import search_space

    assert {r.peptide for r in search_space(proteins, narrow).collect()} == {"LMNPQR"}


def test_text_sinks(spark, records, predictions):
    entry = msp(predictions, records, MODS).where("spec_id = 'p1'").first().value.split("\n")
    assert entry[0] == "Name: ACDEK/2" and entry[1].startswith("MW: ") and entry[3] == "Num peaks: 8"
    assert entry[2].startswith("Comment: Mods=1/1,C,Carbamidomethyl Parent=") and 'Protein="P1/P2" RetentionTime=90.0 Spec_ID="p1"' in entry[2]
    peaks = [x.split("\t") for x in entry[4:] if x]
    assert [float(p[0]) for p in peaks] == sorted(float(p[0]) for p in peaks) and max(int(p[1]) for p in peaks) == 10000 and peaks[0][2].endswith('/0.0"')
    block = mgf(predictions, records, MODS).where("spec_id = 'p2'").first().value
    assert block.startswith("BEGIN IONS\nTITLE=p2 LMNPQR/3 0 P1\nPEPMASS=") and "CHARGE=3+\nRTINSECONDS=120.0\n" in block and block.endswith("END IONS\n")
    rows = spectronaut(predictions, records, MODS)
    assert rows.groupBy("ModifiedPeptide").agg(F.round(F.sum("RelativeIntensity"), 6).alias("s")).where("s <> 1").count() == 0
    assert {r.ModifiedPeptide for r in rows.collect()} == {"_AC[+57.0]DEK_", "_LMNPQR_", "_IM[+16.0]NPQR_"}
    ssl, ms2 = bibliospec(predictions, records, MODS, start=4)
    assert sorted((r.scan, r.sequence) for r in ssl.collect()) == [(4, "AC[+57.0]DEK"), (5, "LMNPQR"), (6, "IM[+16.0]NPQR")]
    assert ms2.where("scan = 5").first().value.startswith("S\t5\t")


def test_written_files(spark, records, predictions, tmp_path):
    out = str(tmp_path / "x")
    write_results(predictions, records, out, sorted(SINKS), catalogue=MODS, single_file=True)
    assert spark.read.csv(out + ".csv", header=True).count() == 28 and spark.read.parquet(out + ".parquet").count() == 28
    write_results(predictions, records, out, ["bibliospec"], mode="append", catalogue=MODS)
    scans = sorted(int(r.scan) for r in spark.read.csv(out + ".ssl", header=True, sep="\t").collect())
    assert scans == list(range(6))
    db = sqlite3.connect(out + ".dlib")
    entries = db.execute("SELECT PeptideModSeq, MassEncodedLength, MassArray, IntensityArray, RTInSeconds FROM entries ORDER BY PrecursorMz").fetchall()
    assert len(entries) == 3 and {e[0] for e in entries} == {"AC[+57.02146]DEK", "LMNPQR", "IM[+15.99492]NPQR"}
    masses = decode_array(entries[0][2], "d", ">")
    assert len(masses) * 8 == entries[0][1] and masses == sorted(masses)
    assert db.execute("SELECT count(*) FROM peptidetoprotein").fetchone()[0] == 3
    for bad in (["nope"],):
        with pytest.raises(ValueError):
            write_results(predictions, records, out, bad)
    with pytest.raises(ValueError):
        write_results(predictions, records, out, ["csv"], mode="wild")


def test_six_digits(spark):
    from ionlake.sinks.libraries import _six_digits

    values = [0.0, 1.0, 0.25, 123456.7, 1234567.0, 0.00012345678, 0.000012345678, 1e-9, 0.1234567, 99999.4]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(_six_digits(F.col("v"))).collect()]
    assert got == ["%.6g" % v for v in values]


def test_peprec_files(spark, records, tmp_path):
    path = str(tmp_path / "a.peprec")
    write_peprec(records.drop("rt"), path)
    got = {r.spec_id: r for r in read_peprec(spark, path).collect()}
    assert got["p1"].protein_list == ["P1", "P2"] and got["p2"].modifications == "-" and got["p2"].charge == 3
    (tmp_path / "b.peprec").write_text("spec_id,modifications,peptide,charge\nx,,ACDE,2\n")
    assert read_peprec(spark, str(tmp_path / "b.peprec"), 1).first().modifications == "-"
    (tmp_path / "c.peprec").write_text("id modifications\n")
    with pytest.raises(ValueError):
        read_peprec(spark, str(tmp_path / "c.peprec"))


def test_spectrum_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", 500.0, 2, [(2.0, 1.0), (1.0, 1.0)], "f"), ("b", None, 2, [], "f"), ("c", 900.0, 2, [], "g")], "title string, precursor_mz double, precursor_charge int, peaks array<struct<mz:float,intensity:float>>, source_file string")
    write_spectrum_store(rows, str(tmp_path / "s"))
    assert [(r.title, r.source_file, r.mzs) for r in read_spectrum_store(spark, str(tmp_path / "s"), 400.0, 600.0).collect()] == [("a", "f", [1.0, 2.0])]
    assert read_spectrum_store(spark, str(tmp_path / "s")).count() == 2


def test_search_tables(spark, tmp_path):
    (tmp_path / "e.txt").write_text(
        "Best MS/MS\tSequence\tModified sequence\tModifications\tCharge\tProteins\tRetention time\tScore\tDelta score\tPEP\tReverse\tPotential contaminant\tRaw file\n"
        "1\tAMCK\t_AM(ox)CK_\tx\t2\tP1;P2\t1.0\t10\t1\t0.01\t\t\tr\n2\tAMCK\t_AM(ox)CK_\tx\t2\tP1\t1.0\t20\t1\t0.02\t\t\tr\n3\tAAAK\t_AAAK_\tx\t2\tP1\t1.0\t20\t1\t0.03\t+\t\tr\n"
    )
    (tmp_path / "m.txt").write_text("id\tScan number\tScan index\n1\t11\t1\n2\t12\t2\n3\t13\t3\n")
    got = converters.maxquant_peprec(read_tsv(spark, str(tmp_path / "e.txt")), read_tsv(spark, str(tmp_path / "m.txt")), {"ox": "Oxidation"}, {"C": "Carbamidomethyl"}).collect()
    assert [(r.spec_id, r.modifications, r.scan) for r in got] == [("2", "2|Oxidation|3|Carbamidomethyl", 12)]
    (tmp_path / "a.mztab").write_text("MTD\tx\nPSH\tPSM_ID\tsequence\tmodifications\tcharge\tretention_time\tcalc_mass_to_charge\tsearch_engine_score[1]\nPSM\t1\tAMK\t1-MOD:35\t2\tnull\t1\t5\nPSM\t1\tAMK\tnull\t2\tnull\t1\t9\n")
    rows = converters.mztab_peprec(read_mztab(spark, str(tmp_path / "a.mztab")), {"MOD:35": "Oxidation"}).collect()
    assert [(r.spec_id, r.modifications, r.score) for r in rows] == [("1", "-", 9.0)]
    one = spark.range(1)
    report = one.select(converters.report_sequence(F.lit("ace-AM<ox>C<cmm>K-COOH")).alias("r")).select("r.peptide", format_mods(F.col("r.pairs")).alias("m")).first()
    assert tuple(report) == ("AMCK", "0|Acetyl|2|Oxidation|3|Carbamidomethyl")
    assert one.select(format_mods(converters.msp_to_pairs(F.lit("2/0,A,iTRAQ/3,M,Oxidation")))).first()[0] == "0|iTRAQ|4|Oxidation"
    assert one.select(converters.file_stem(F.lit("C:\\data\\run1.raw"))).first()[0] == "run1"
    assert one.select(converters.only_common_mods(F.lit("2|Oxidation|3|Acetyl")), converters.only_common_mods(F.lit("-"))).first()[:] == (False, True)
    assert [r[0] for r in one.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("x")).select(converters.report_label(F.col("x"))).collect()] == [1, -1]


def test_store_converters(spark):
    peptides = spark.createDataFrame([(1, "AMK"), (2, "AAK")], "PeptideID int, peptide string")
    scores = spark.createDataFrame([(1, 9.0), (2, 5.0)], "PeptideID int, score double")
    decoys = spark.createDataFrame([(3, "KKK")], "PeptideID int, peptide string")
    decoy_scores = spark.createDataFrame([(3, 7.0)], "PeptideID int, score double")
    psms = converters.store_psms(peptides, scores, decoys, decoy_scores).withColumns({"spec_id": F.col("PeptideID"), "modifications": F.lit("-"), "charge": F.lit(2)})
    assert [r.spec_id for r in converters.library_psms(psms, 0.1).collect()] == [1]
    side = spark.createDataFrame([(1, 7, 1)], "PeptideID int, AminoAcidModificationID int, Position int")
    ends = spark.createDataFrame([(1, 8)], "PeptideID int, TerminalModificationID int")
    names = spark.createDataFrame([(7, "Oxidation"), (8, "Acetyl")], "AminoAcidModificationID int, ModificationName string")
    assert converters.store_modifications(side, ends, names).first().modifications == "0|Acetyl|2|Oxidation"
    values = spark.createDataFrame([(1, 5, "0.1"), (1, 6, "0.2")], "PeptideID int, FieldID int, FieldValue string")
    fields = spark.createDataFrame([(5, "q"), (6, "pep")], "FieldID int, DisplayName string")
    assert converters.store_fields(values, fields, ["q", "pep"]).first()[:] == (1, "0.1", "0.2")


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.blib")
    db.executescript("CREATE TABLE RefSpectra (id INTEGER, peptideSeq TEXT, precursorCharge INTEGER, precursorMZ REAL); CREATE TABLE Modifications (RefSpectraID INTEGER, position INTEGER, mass REAL); CREATE TABLE RefSpectraPeaks (RefSpectraID INTEGER, peakMZ BLOB, peakIntensity BLOB);")
    db.execute("INSERT INTO RefSpectra VALUES (1, 'AMK', 2, 300.5)")
    db.execute("INSERT INTO Modifications VALUES (1, 2, 15.99)")
    db.execute("INSERT INTO RefSpectraPeaks VALUES (1, ?, ?)", (encode_array([100.0, 200.0], "d", "<", 3), encode_array([1.0, 2.0], "f", "<", 3)))
    db.commit()
    tables = read_sqlite(spark, str(tmp_path / "a.blib"), ["RefSpectra", "Modifications", "RefSpectraPeaks"])
    got = blib_spectra(tables).first()
    assert (got.peptide, got.charge, [tuple(m) for m in got.mods], [tuple(p) for p in got.peaks]) == ("AMK", 2, [(2, 15.99)], [(100.0, 1.0), (200.0, 2.0)])


def test_configuration(tmp_path):
    text = "# comment\nmodel=HCD\nfrag_error=0.02\nout=csv, msp\nptm=Oxidation,15.994915,opt,M\nptm=Acetyl,42.010565,opt,N-term\n"
    (tmp_path / "a.txt").write_text(text)
    config = load_config(str(tmp_path / "a.txt"))
    assert config.out == ["csv", "msp"] and len(config.catalogue().mods) == 2
    write_toml(config, str(tmp_path / "b.toml"))
    assert load_config(str(tmp_path / "b.toml")) == config
    (tmp_path / "c.toml").write_text('[section]\nfrag_method = "TMT"\nout = "csv"\n')
    assert load_config(str(tmp_path / "c.toml")) == PredictionConfig("TMT")
    (tmp_path / "d.json").write_text(json.dumps({"wrong": 1}))
    for bad in ("d.json", "a.xml"):
        (tmp_path / "a.xml").write_text("")
        with pytest.raises(UnsupportedConfig):
            load_config(str(tmp_path / bad))
    assert model("HCD").number == 9 and model("timsTOF").name == "timsTOF2024" and model("HCDch2").ions == ["B", "Y", "B2", "Y2"]
    with pytest.raises(UnknownModel):
        model("none")
    (tmp_path / "lib.json").write_text(json.dumps({"charges": [2], "modifications": [{"name": "Oxidation", "mass_shift": 15.99, "amino_acid": "M"}]}))
    assert LibraryConfig.load(str(tmp_path / "lib.json")).modifications == [LibraryModification("Oxidation", 15.99, "M")]
    with pytest.raises(ValueError):
        check_sha1(str(tmp_path / "a.txt"), "0" * 40)


def test_command_line(spark, tmp_path):
    (tmp_path / "a.peprec").write_text("spec_id modifications peptide charge\np1 - ACDEK 2\n")
    assert cli.main(["predict", str(tmp_path / "a.peprec"), "-o", str(tmp_path / "out"), "-f", "csv"], spark) == 0
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).count() == 8
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=p1\nCHARGE=2+\n72.0444 10\n90 5\nEND IONS\n")
    assert cli.main(["predict", str(tmp_path / "a.peprec"), "-s", str(tmp_path / "a.mgf"), "-x", "-o", str(tmp_path / "cmp")], spark) == 0
    assert spark.read.csv(str(tmp_path / "cmp_pred_and_emp.csv"), header=True).count() == 8
    assert cli.main(["single", "ACDEK", "-", "2"], spark) == 0
    assert cli.main(["single", "AXDEK", "-", "2"], spark) == 1


def test_stream(spark, tmp_path):
    from ionlake.streaming.spectra import processed, stream_spectra, windowed_tic, write_batches

    rows = spark.createDataFrame([("a", 500.0, 2, [(2.0, 1.0), (1.0, 3.0)], "f")], "title string, precursor_mz double, precursor_charge int, peaks array<struct<mz:float,intensity:float>>, source_file string")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    q = write_batches(processed(stream_spectra(spark, str(tmp_path / "in"))), lambda df, _: seen.extend(df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 1 and seen[0].tic == 4.0
    timed = stream_spectra(spark, str(tmp_path / "in")).withColumn("ts", F.lit("2020-01-01 00:10:00").cast("timestamp"))
    q = windowed_tic(timed, "ts").writeStream.outputMode("complete").format("memory").queryName("tics").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tics").first().tic == 4.0
    assert zlib.crc32(b"") == 0


def test_boosted_models_are_read(spark, tmp_path):
    """A text dump and a JSON model of one tree give the same forest."""
    from ionlake.plans.trees import read_boosted_dump, read_boosted_json

    (tmp_path / "m.txt").write_text("booster[0]:\n0:[f2<1.5] yes=1,no=2,missing=1\n\t1:leaf=0.25\n\t2:[f0<3] yes=3,no=4,missing=3\n\t\t3:leaf=-1\n\t\t4:leaf=2\n")
    tree = '{"left_children":[1,-1,3,-1,-1],"right_children":[2,-1,4,-1,-1],"split_indices":[2,0,0,0,0],"split_conditions":[1.5,0.25,3,-1,2]}'
    (tmp_path / "m.json").write_text('{"learner":{"learner_model_param":{"base_score":"[5E-1]"},"gradient_booster":{"model":{"trees":[' + tree + "]}}}}")
    x = np.array([[0, 0, 1.0], [2, 0, 2.0], [3, 0, 1.5]])
    for nodes in (read_boosted_dump(spark, str(tmp_path / "m.txt"), "B", "m"), read_boosted_json(spark, str(tmp_path / "m.json"), "B", "m")):
        assert Forest.from_nodes(nodes).score(x).tolist() == [0.75, -0.5, 2.5]


def test_fasta_records_begin_at_lines(spark, tmp_path):
    from ionlake.sources.peptides import count_fasta, read_fasta

    (tmp_path / "a.fasta").write_text(">P1 kinase 5->3 and <x> y\nACDE\nFGH\n>P2\r\nKLM\r\n\n>P3 >odd\nM")
    path = str(tmp_path / "a.fasta")
    assert sorted((r.protein, r.description, r.sequence) for r in read_fasta(spark, path).collect()) == [("P1", "P1 kinase 5->3 and <x> y", "ACDEFGH"), ("P2", "P2", "KLM"), ("P3", "P3 >odd", "M")]
    assert count_fasta(spark, path) == 3


def test_scored_peptides(spark):
    """A peptide's sites are scored in one row, in small batches and of several lengths; suffix ions run backwards."""
    from ionlake.operators.features import site_features
    from ionlake.plans.trees import score_peptides

    rows = spark.createDataFrame([(f"{'ACDEFGHIKLMNPQRSTVWY' * 2}{'AG' * (k % 9)}K", 2) for k in range(40)], "peptide string, charge int").coalesce(1)
    nodes = toy_nodes()
    sites = site_features(rows, keep=("peptide", "charge"))
    want = {}
    for r in score_sites(sites, nodes, ("peptide", "charge")).collect():
        want.setdefault(r.peptide, {})[r.site] = (r.p_B, r.p_Y)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = score_peptides(rows, nodes, ("peptide", "charge")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40
    for r in got:
        own = [want[r.peptide][k] for k in range(len(r.peptide) - 1)]
        assert r.p_B == [b for b, _ in own] and r.p_Y == [y for _, y in own][::-1]
