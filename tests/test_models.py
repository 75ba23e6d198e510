"""Boosting, forests as source, models by registry, run metrics, and the command line."""

import json
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionlake import cli
from ionlake.functions.mods import Catalogue
from ionlake.operators import converters
from ionlake.plans import boosting
from ionlake.plans.boosting import BoostParams, best_combination, bin_edges, cross_validated, fit_leafwise, leaf_grid, score_vectors
from ionlake.plans.config import ModelIntegrityError, UnknownModel
from ionlake.plans.forest_code import InvalidForestSource, forest_source, forest_sql, parse_forest_source, score_by_columns
from ionlake.plans.metrics import EmptySpectra, NoValidPeptides, RunMetrics
from ionlake.plans.models import load_model, read_nodes, save_model
from ionlake.plans.pipeline import predict
from ionlake.plans.trees import Forest, boosted_dump_nodes, boosted_json, boosted_json_nodes, forest_expression, toy_nodes
from ionlake.sinks.spectrum_store import match_store, read_spectrum_store, scan_ranges, write_spectrum_store
from ionlake.sources.peptides import count_fasta, read_fasta, read_peprec
from ionlake.sources.spectra import read_mzml
from ionlake.sources.tables import read_sqlite

MODS = Catalogue.parse(["Oxidation,15.994915,opt,M", "Carbamidomethyl,57.021464,opt,C"])


def made(n=900, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 40, n), rng.integers(0, 9, n), rng.integers(0, 300, n), rng.integers(0, 2, n)], 1)
    y = np.where(x[:, 0] < 17, 1.0, -1.0) + 0.3 * x[:, 1] + (x[:, 2] % 7 == 0) + 0.05 * rng.normal(size=n) + np.where((x[:, 2] > 120) & (x[:, 3] == 1), 2.0, 0.0)
    return x, y


@pytest.fixture(scope="module")
def vectors(spark):
    x, y = made()
    rows = [(f"p{k // 6}", 2 + k // 6 % 3, k % 6, [int(v) for v in x[k]], {"B": float(y[k])} if k % 50 else {"Y": 1.0}) for k in range(len(x))]
    return spark.createDataFrame(rows, "psmid string, charge int, site int, features array<int>, targets map<string,double>").repartition(4).cache()


def own_rows(vectors):
    rows = [(r.features, r.targets["B"]) for r in vectors.collect() if "B" in r.targets]
    return np.array([x for x, _ in rows], float), np.array([y for _, y in rows])


def brute_tree(x, g, edges, p, train=None):
    """Best gain first, one split at a time, over the same edges; the values of all rows, learned from those of ``train``."""
    train = np.ones(len(x), bool) if train is None else train
    leaves, splits = [(np.ones(len(x), bool), 0)], []

    def best(rows, depth):
        found = (0.0, None)
        total, n = g[rows & train].sum(), (rows & train).sum()
        for f in range(x.shape[1]) if depth < p.max_depth else ():
            for e in edges[f]:
                low = rows & train & (x[:, f] < e)
                a, h = g[low].sum(), low.sum()
                if h < p.min_rows or n - h < p.min_rows:
                    continue
                gain = 0.5 * (a * a / (h + p.l2) + (total - a) ** 2 / (n - h + p.l2) - total**2 / (n + p.l2)) - p.gamma
                if gain > found[0] + 1e-9:
                    found = (gain, (f, e))
        return found

    while len(leaves) < p.max_leaves:
        gains = [best(*leaf) for leaf in leaves]
        k = max(range(len(leaves)), key=lambda k: gains[k][0])
        if gains[k][1] is None:
            break
        rows, depth = leaves.pop(k)
        f, e = gains[k][1]
        splits.append((f, e))
        leaves += [(rows & (x[:, f] < e), depth + 1), (rows & ~(x[:, f] < e), depth + 1)]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = -p.step * g[rows & train].sum() / ((rows & train).sum() + p.l2)
    return out, splits


@pytest.mark.parametrize("leaves,depth", [(9, 20), (30, 3), (2, 9)])
def test_leafwise_trees_against_brute_force(vectors, leaves, depth):
    params = BoostParams(trees=3, max_leaves=leaves, max_depth=depth, min_rows=20, bins=16)
    fitted = fit_leafwise(vectors, "B", "m", params)
    x, y = own_rows(vectors)
    edges = bin_edges(vectors.select(F.col("features").cast("array<double>").alias("x"), "targets").where("targets['B'] is not null"), 16)
    margin = np.full(len(y), y.mean())
    for tree in range(3):
        step, splits = brute_tree(x, margin - y, edges, params)
        margin = margin + step
        own = fitted.nodes[(fitted.nodes["tree"] == tree) & fitted.nodes["leaf"].isna()]
        assert sorted(zip(own["feature"].astype(int), own["threshold"])) == sorted(splits)
    assert np.allclose(Forest.from_nodes(fitted.nodes).score(x), margin)
    assert fitted.history["mae"].iloc[-1] == pytest.approx(np.abs(margin - y).mean()) and len(fitted.history) == 4


def test_bin_edges_keep_few_values_exactly(spark, vectors, monkeypatch):
    rows = vectors.select(F.col("features").cast("array<double>").alias("x"))
    edges = bin_edges(rows, 64)
    x = np.array([r.x for r in rows.collect()])
    for k in (0, 1, 3):
        assert edges[k].tolist() == sorted(set(x[:, k]))[1:]
    assert 55 < len(edges[2]) <= 63
    share = np.histogram(x[:, 2], [-1, *edges[2], 999])[0] / len(x)
    assert share.max() < 3 / 64
    monkeypatch.setattr(boosting, "KEPT_VALUES", 50)  # a summary of many values stays close
    assert bin_edges(spark.createDataFrame([([float(v)],) for v in range(5000)], "x array<double>").repartition(3), 4)[0] == pytest.approx([1250, 2500, 3750], abs=150)


def test_early_stopping_keeps_the_best_round(vectors):
    train, held = vectors.where("pmod(hash(psmid), 3) > 0"), vectors.where("pmod(hash(psmid), 3) = 0")
    params = BoostParams(trees=40, step=0.9, max_leaves=60, min_rows=1, gamma=0.0, patience=3, bins=32)
    fitted = fit_leafwise(train, "B", "m", params, {"held": held, "again": train})
    own = fitted.history[fitted.history["set"] == "held"].set_index("round")["mae"]
    assert fitted.best_round == own[own.index > 0].idxmin() < 40 and own.index.max() == fitted.best_round + 3
    assert fitted.nodes["tree"].nunique() == fitted.best_round
    scored = score_vectors(held, fitted.nodes, "B").toPandas()
    assert (scored["prediction"] - scored["target"]).abs().mean() == pytest.approx(own[fitted.best_round])
    again = fitted.history[fitted.history["set"] == "again"]["mae"].to_numpy()
    assert np.allclose(again, fitted.history[fitted.history["set"] == "train"]["mae"].to_numpy())


def test_stored_margins_change_nothing(vectors, monkeypatch):
    params = BoostParams(trees=5, max_leaves=4, min_rows=20, bins=8)
    want = fit_leafwise(vectors, "B", "m", params).nodes
    monkeypatch.setattr(boosting, "STORED_TREES", 2)
    monkeypatch.setattr(boosting, "MERGED_TASKS", 1)
    got = fit_leafwise(vectors, "B", "m", params).nodes
    assert got["feature"].fillna(-1).tolist() == want["feature"].fillna(-1).tolist() and np.allclose(got["leaf"].fillna(0), want["leaf"].fillna(0))


def test_boosting_of_few_rows(spark, vectors):
    none = fit_leafwise(vectors.limit(0), "B", "m")
    assert Forest.from_nodes(none.nodes).score(np.zeros((2, 4))).tolist() == [0.0, 0.0]
    one = fit_leafwise(vectors.where("targets['B'] is not null").limit(3), "B", "m", BoostParams(trees=2))
    assert one.nodes["leaf"].notna().all() and one.nodes["tree"].nunique() == 2
    with pytest.raises(ValueError):
        BoostParams(bins=1)


def test_grid_by_charge_and_set(vectors):
    extra = vectors.where("charge = 3")
    rows = leaf_grid(vectors, "B", [2, 4], [3, 8], BoostParams(trees=2, min_rows=10, bins=16), {"extra": extra}).collect()
    assert {(r.max_depth, r.max_leaves, r.set, r.charge) for r in rows} == {(d, n, s, c) for d in (2, 4) for n in (3, 8) for s, c in (("test", 2), ("test", 3), ("test", 4), ("extra", 3))}
    assert all(r.percentiles == sorted(r.percentiles) and len(r.percentiles) == 5 and r.mae > 0 for r in rows)


def test_cross_validation_by_round(vectors):
    found = cross_validated(vectors, "B", [{"max_depth": 1}, {"max_depth": 4}], BoostParams(trees=3, min_rows=10, bins=16), folds=3, patience=None)
    assert len(found) == 6 and set(found.columns) >= {"round", "test_mean", "test_std", "train_mean", "train_std", "max_depth"}
    assert best_combination(found, ["max_depth"]) == {"max_depth": 4}


def deep_nodes(depth, trees, features, seed=1):
    rng, rows = np.random.default_rng(seed), []
    for t in range(trees):
        for k in range(2 ** (depth + 1) - 1):
            if k >= 2**depth - 1:
                rows.append(("m", "B", t, k, None, None, None, None, float(rng.normal()), 0.5))
            else:
                rows.append(("m", "B", t, k, int(rng.integers(features)), float(rng.integers(-9, 10)) / 2, 2 * k + 1, 2 * k + 2, None, 0.5))
    return pd.DataFrame(rows, columns=["model", "ion", "tree", "node", "feature", "threshold", "yes", "no", "leaf", "base_score"])


def test_source_round_trip(vectors):
    fitted = fit_leafwise(vectors, "B", "Immuno-HCD", BoostParams(trees=4, max_leaves=12, min_rows=10)).nodes
    both = pd.concat([fitted, toy_nodes(("Y", "B"), "toy")], ignore_index=True)
    text = forest_source(both)
    assert "static float score_Immuno_HCD_B(unsigned int* v){" in text and "if (v[27]<3.0){" in text
    back = parse_forest_source(text)
    x = np.concatenate([made()[0], np.zeros((900, 100))], 1)
    for (model, ion), own in both.groupby(["model", "ion"]):
        got = back[(back["model"] == model) & (back["ion"] == ion)]
        assert (Forest.from_nodes(got).score(x) == Forest.from_nodes(own).score(x)).all() and len(got) == len(own)
    assert forest_source(back) == text
    plain = parse_forest_source("static float score_m_Y(unsigned int* v){\nfloat s = 0.;\n\tif (v[2]<7){\n\t\ts = s + 1e-3;\n\t}else{\n\t\ts = s -2;\n\t}\nreturn s + 0.5;}")
    assert Forest.from_nodes(plain).score(np.array([[0, 0, 6.0], [0, 0, 7.0]])).tolist() == [0.501, -1.5] and set(plain["ion"]) == {"Y"} and set(plain["model"]) == {"m"}
    for bad in ("static float f(){ float s = 1; if (v[1]<2){ s = s + 1; } return s;}", "int x;", "static float f(){ float s = ?; return s;}"):
        with pytest.raises(InvalidForestSource):
            parse_forest_source(bad)


def test_sql_of_a_large_forest(spark):
    """Trees beyond the limit are cut; every part fits it, and the values are those of the batch scorer."""
    nodes = deep_nodes(8, 3, 6)
    rng = np.random.default_rng(0)
    x = rng.integers(-8, 8, (60, 6)) / 2
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k int, features array<double>")
    parts = forest_sql(nodes, "get(features, {})", 100)
    assert all(p.count("CASE") + p.count("e0") <= 220 for p in parts) and len(parts) > 10
    got = [r.prediction for r in score_by_columns(rows, nodes).orderBy("k").collect()]
    assert np.allclose(got, Forest.from_nodes(nodes).score(x))
    small = nodes[nodes["tree"] == 0].head(0)
    assert score_by_columns(rows, small).first().prediction == 0.0


def test_missing_values_follow_their_branch(spark):
    tree = {"left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [0, 0, 1, 0, 0], "split_conditions": [5.0, 0.25, 2.5, -1.0, 2.0], "default_left": [1, 0, 0, 0, 0]}
    nodes = boosted_json_nodes(json.dumps({"learner": {"learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": [tree]}}}}), "B", "m")
    dump = boosted_dump_nodes("booster[0]:\n0:[f0<5] yes=1,no=2,missing=1\n\t1:leaf=0.25\n\t2:[f1<2.5] yes=3,no=4,missing=4\n\t\t3:leaf=-1\n\t\t4:leaf=2\n", "B", "m")
    x = np.array([[np.nan, 0], [7, np.nan], [7, 1], [1, 1]])
    want = [0.75, 2.5, -0.5, 0.75]
    rows = spark.createDataFrame([(k, [None if np.isnan(v) else float(v) for v in r]) for k, r in enumerate(x)] + [(4, [float("nan"), 0.0])], "k int, features array<double>").orderBy("k")
    for held in (nodes, dump, boosted_json_nodes(boosted_json(nodes), "B", "m")):
        assert Forest.from_nodes(held).score(x).tolist() == want
        assert [r.v for r in rows.select(forest_expression(held, F.col("features")).alias("v")).collect()] == [*want, 0.75]
        assert [r.prediction for r in score_by_columns(rows, held).orderBy("k").collect()][:4] == want
    with pytest.raises(InvalidForestSource):
        forest_source(nodes)


def test_models_by_registry(spark, tmp_path):
    folder = str(tmp_path / "models")
    nodes = toy_nodes(("B", "Y"), "HCD2021")
    save_model(spark, nodes, "HCD", folder)
    save_model(spark, toy_nodes(("B", "Y", "B2", "Y2"), "CIDch2"), "CIDch2", folder)
    got = load_model(spark, "HCD", folder)
    x = np.random.default_rng(1).integers(0, 9, (50, 139))
    for ion in "BY":
        assert (Forest.from_nodes(got[got["ion"] == ion]).score(x) == Forest.from_nodes(nodes[nodes["ion"] == ion]).score(x)).all()
    assert set(load_model(spark, "CIDch2", folder)["ion"]) == {"B", "Y", "B2", "Y2"}
    with pytest.raises(UnknownModel):
        load_model(spark, "TMT", folder)
    with pytest.raises(UnknownModel):
        save_model(spark, nodes, "CIDch2", folder)
    assert len(read_nodes(spark, [f"B={folder}/HCD2021_B.json", f"Y={folder}/HCD2021_Y.json"], "HCD2021", ["B", "Y"])) == len(nodes)
    (tmp_path / "f.c").write_text(forest_source(nodes))
    assert len(read_nodes(spark, [str(tmp_path / "f.c")], "HCD2021", ["B", "Y"])) == len(nodes)
    with pytest.raises(UnknownModel):
        read_nodes(spark, [f"B={folder}/HCD2021_B.json"], "HCD2021", ["B", "Y"])
    with pytest.raises(ValueError, match="one ion type"):
        read_nodes(spark, [f"{folder}/HCD2021_B.json"], "HCD2021", ["B", "Y"])
    (tmp_path / "models" / "HCD2021_Y.json").write_text((tmp_path / "models" / "HCD2021_Y.json").read_text() + " ")
    (tmp_path / "models" / ".HCD2021_Y.json.crc").unlink(missing_ok=True)
    with pytest.raises(ModelIntegrityError):
        load_model(spark, "HCD2021", folder)


def test_run_metrics(spark):
    rows = [("a", "ACDEK", "-", 2), ("b", "ACXEK", "-", 2), ("c", "AC", "", 2), ("d", "ACDEK", "1|Nothing", 2), ("e", None, None, 2), ("f", "MCDEK", "1|Oxidation", 2), ("g", "A" * 100, "-", 2)]
    schema = "spec_id string, peptide string, modifications string, charge int"
    watched = RunMetrics()
    assert predict(spark.createDataFrame(rows, schema), toy_nodes(), MODS, metrics=watched).select("spec_id").distinct().count() == 2
    assert watched.check_records() == {"records": 7, "no_peptide": 1, "invalid_residue": 1, "length": 2, "unknown_modification": 1, "kept": 2}
    for held in (rows[1:3], []):
        none = RunMetrics()
        predict(spark.createDataFrame(held, schema), toy_nodes(), MODS, metrics=none)
        with pytest.raises(NoValidPeptides):
            none.check_records()
    peak = "struct<mz:float,intensity:float>"
    spectra = spark.createDataFrame([("x", [(1.0, 2.0)]), ("y", []), ("z", None)], f"title string, peaks array<{peak}>").repartition(2)
    seen = RunMetrics()
    seen.watch_spectra(spectra).count()
    got = seen.check_spectra()
    assert (got["spectra"], got["empty"]) == (3, 2) and got["spectra_per_task"] == 3 / got["tasks"]
    empty = RunMetrics()
    empty.watch_spectra(spectra.where("title = 'y'")).count()
    with pytest.raises(EmptySpectra):
        empty.check_spectra()


def test_command_line_removes_reporter_ions(spark, tmp_path):
    """A labelled model's targets lack the reporter range; another model's keep it."""
    (tmp_path / "p.peprec").write_text("spec_id modifications peptide charge\nid1 - GGDEK 2\n")
    (tmp_path / "s.mgf").write_text("BEGIN IONS\nTITLE=id1\nPEPMASS=400\n58.029 1000\n115.05 5000\n129.06 7000\n147.113 900\nEND IONS\n")
    found = {}
    for name in ("TMT", "HCD", "iTRAQ"):
        (tmp_path / f"{name}.txt").write_text(f"model={name}\nfrag_error=0.02\n")
        out = str(tmp_path / f"out_{name}")
        assert cli.main(["predict", str(tmp_path / "p.peprec"), "-c", str(tmp_path / f"{name}.txt"), "-s", str(tmp_path / "s.mgf"), "-o", out], spark) == 0
        rows = spark.read.csv(out + "_pred_and_emp.csv", header=True, inferSchema=True).collect()
        found[name] = {(r.ion, r.ionnumber): r.target for r in rows}
    low = np.log2(0.001)
    assert found["HCD"]["B", 2] > low + 3 and found["iTRAQ"]["B", 2] == pytest.approx(low, abs=1e-4) and found["TMT"]["B", 2] == pytest.approx(found["HCD"]["B", 2])
    assert all(found[m]["Y", 1] > low + 3 for m in found)


def test_command_line_models_and_errors(spark, tmp_path, capsys):
    folder = tmp_path / "models"
    save_model(spark, toy_nodes(("B", "Y"), "HCD2021").assign(base_score=3.0), "HCD", str(folder))
    (tmp_path / "p.peprec").write_text("spec_id modifications peptide charge\nid1 - ACDEK 2\n")
    (tmp_path / "none.peprec").write_text("spec_id modifications peptide charge\nid1 - AXDEK 2\n")
    (tmp_path / "c.txt").write_text(f"model=HCD\nmodel_dir={folder}\n")
    held = {}
    for name, extra in (("registry", []), ("files", ["-n", f"B={folder}/HCD2021_B.json", f"Y={folder}/HCD2021_Y.json"])):
        out = str(tmp_path / name)
        assert cli.main(["predict", str(tmp_path / "p.peprec"), "-c", str(tmp_path / "c.txt"), "-o", out, "-f", "parquet", *extra], spark) == 0
        held[name] = sorted(map(tuple, spark.read.parquet(out + ".parquet").select("ion", "ionnumber", "prediction").collect()))
    assert held["registry"] == held["files"] and len(held["files"]) == 8
    assert cli.main(["predict", str(tmp_path / "none.peprec"), "-c", str(tmp_path / "c.txt"), "-o", str(tmp_path / "x")], spark) == 1
    assert "no valid peptide" in capsys.readouterr().err
    (tmp_path / "bad.txt").write_text(f"model=TMT\nmodel_dir={folder}\n")
    assert cli.main(["predict", str(tmp_path / "p.peprec"), "-c", str(tmp_path / "bad.txt"), "-o", str(tmp_path / "x")], spark) == 1
    assert "TMT" in capsys.readouterr().err


def test_fasta_before_the_first_header(spark, tmp_path):
    cases = {"a": "; a comment\n; more\n>P1 one\nACD\n>P2\nEF\n", "b": "\n\n>P1 >odd\nAC\n", "c": "no header at all\nACD\n", "d": ">P1\nA\n>>P2 twice\nC\n"}
    for name, text in cases.items():
        (tmp_path / f"{name}.fasta").write_text(text)
        assert read_fasta(spark, str(tmp_path / f"{name}.fasta")).count() == count_fasta(spark, str(tmp_path / f"{name}.fasta"))
    rows = read_fasta(spark, str(tmp_path / "*.fasta")).collect()
    assert sorted((r.protein, r.description, r.sequence) for r in rows) == [(">P2", ">P2 twice", "C"), ("P1", "P1", "A"), ("P1", "P1 >odd", "AC"), ("P1", "P1 one", "ACD"), ("P2", "P2", "EF")]


def test_records_whose_energy_is_no_number_go(spark, tmp_path):
    (tmp_path / "p.peprec").write_text("spec_id modifications peptide charge ce\na - ACDEK 2 30\nb - ACDEK 2 high\nc - ACDEK 2 27.5\n")
    assert {r.spec_id: r.ce for r in read_peprec(spark, str(tmp_path / "p.peprec")).collect()} == {"a": 30, "c": 27}


def test_spectrum_store_is_clustered_and_probed(spark, tmp_path):
    rng = np.random.default_rng(5)
    mz = np.concatenate([rng.uniform(300, 1200, 3000), np.full(500, 640.25)])
    rows = [(f"t{k}", float(m), [(100.0 + k % 50, 1.0), (200.0, 2.0), (300.5, 0.5)], "f.mgf" if k % 2 else "g.mgf") for k, m in enumerate(mz)] + [("none", None, [], "f.mgf")]
    spectra = spark.createDataFrame(rows, "title string, precursor_mz double, peaks array<struct<mz:float,intensity:float>>, source_file string")
    path = str(tmp_path / "store")
    write_spectrum_store(spectra, path, slice_spectra=200)
    slices = spark.read.parquet(f"{path}/slices").collect()
    assert len(slices) >= 15 and max(r.n for r in slices) <= 500 and sum(r.n for r in slices) == 3500
    peptides = spark.createDataFrame([("p1", 640.25, [200.0]), ("p2", 640.255, [200.0, 300.5]), ("p3", 900.0, [100.0]), ("p4", None, [200.0]), ("p5", 350.0, [999.0])], "spec_id string, prec_mz double, top_mzs array<double>")
    got = sorted(map(tuple, match_store(spark, path, peptides, 0.5).collect()))
    want = sorted(
        (s, r[3], r[0])
        for s, m, tops in (("p1", 640.25, [200.0]), ("p2", 640.255, [200.0, 300.5]), ("p3", 900.0, [100.0]), ("p5", 350.0, [999.0]))
        for r in rows[:-1]
        if m - 0.5 < r[1] < m + 0.5 and all(any(abs(p[0] - t) < 0.02 for p in r[2]) for t in tops)
    )
    assert got == want and len(got) >= 1000
    assert scan_ranges(peptides, 0.5, 2) == [(349.5, 350.5), (pytest.approx(639.75), 900.5)] or len(scan_ranges(peptides, 0.5, 2)) == 2
    assert scan_ranges(peptides.limit(0), 0.5) == [] and match_store(spark, path, peptides.limit(0), 0.5).count() == 0
    narrow = read_spectrum_store(spark, path, ranges=scan_ranges(peptides, 0.5))
    scan = next(x for x in narrow._jdf.queryExecution().executedPlan().toString().splitlines() if "pepmass" in x and "PartitionFilters" in x)
    assert "slice" in scan.split("PartitionFilters")[1] and "GreaterThanOrEqual(pepmass" in scan
    narrow.count()
    wanted = {r.slice for r in slices if any(a <= r.high and b >= r.low for a, b in scan_ranges(peptides, 0.5))}
    assert len(wanted) < len(slices) / 2
    write_spectrum_store(spectra.limit(10), path, mode="append")
    assert read_spectrum_store(spark, path, 0.0, 5000.0).count() == 3510


def mzml_text(groups, spectra):
    head = f"<referenceableParamGroupList count=\"{len(groups)}\">" + "".join(f'<referenceableParamGroup id="{i}">' + "".join(f'<cvParam accession="{a}" value="{v}"/>' for a, v in own) + "</referenceableParamGroup>" for i, own in groups.items()) + "</referenceableParamGroupList>"
    return f'<?xml version="1.0"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml">{head if groups else ""}<run><spectrumList>{"".join(spectra)}</spectrumList></run></mzML>'


def mzml_spectrum(name, mz, it, level=None, refs=(), array_refs=(), zipped=False, wide=True):
    import base64
    import struct
    import zlib

    def binary(values, kind):
        raw = struct.pack(f"<{len(values)}{'d' if wide else 'f'}", *values)
        raw = zlib.compress(raw) if zipped else raw
        params = "".join(f'<referenceableParamGroupRef ref="{r}"/>' for r in array_refs) or f'<cvParam accession="MS:100052{3 if wide else 1}"/>' + ('<cvParam accession="MS:1000574"/>' if zipped else "")
        return f'<binaryDataArray>{params}<cvParam accession="{kind}"/><binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'

    params = "".join(f'<referenceableParamGroupRef ref="{r}"/>' for r in refs) + (f'<cvParam accession="MS:1000511" value="{level}"/>' if level else "")
    ion = '<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="500.25"/><cvParam accession="MS:1000041" value="2"/></selectedIon></selectedIonList></precursor></precursorList>'
    return f'<spectrum id="{name}" index="0">{params}{ion}<binaryDataArrayList>{binary(mz, "MS:1000514")}{binary(it, "MS:1000515")}</binaryDataArrayList></spectrum>'


def test_mzml_parameter_groups(spark, tmp_path):
    groups = {"common": [("MS:1000511", "2")], "first": [("MS:1000511", "1")], "packed": [("MS:1000523", ""), ("MS:1000574", "")]}
    (tmp_path / "a.mzML").write_text(mzml_text(groups, [
        mzml_spectrum("g1", [100.5, 200.25], [1.0, 2.0], refs=["common"], array_refs=["packed"], zipped=True),
        mzml_spectrum("ms1", [1.0], [2.0], refs=["first"]),
        mzml_spectrum("plain", [150.5], [3.0], level=2, wide=False),
    ]))
    (tmp_path / "b.mzML").write_text(mzml_text({"common": [("MS:1000511", "1")]}, [mzml_spectrum("other", [1.0], [2.0], refs=["common"]), mzml_spectrum("own", [7.0], [8.0], level=2)]))
    (tmp_path / "c.mzML").write_text(mzml_text({}, [mzml_spectrum("none", [9.0], [1.0], level=2), mzml_spectrum("lost", [9.0], [1.0], refs=["nowhere"])]))
    got = {r.title: [(p.mz, p.intensity) for p in r.peaks] for r in read_mzml(spark, str(tmp_path / "*.mzML")).collect()}
    assert got == {"g1": [(100.5, 1.0), (200.25, 2.0)], "plain": [(150.5, 3.0)], "own": [(7.0, 8.0)], "none": [(9.0, 1.0)]}
    assert read_mzml(spark, str(tmp_path / "c.mzML")).count() == 1


def store_file(path, shift, decoys=True):
    db = sqlite3.connect(path)
    db.executescript("""CREATE TABLE Peptides (PeptideID INTEGER, SpectrumID INTEGER, Sequence TEXT); CREATE TABLE PeptideScores (PeptideID INTEGER, ScoreValue REAL);
CREATE TABLE Peptides_Decoy (PeptideID INTEGER, SpectrumID INTEGER, Sequence TEXT); CREATE TABLE PeptideScores_Decoy (PeptideID INTEGER, ScoreValue REAL);
CREATE TABLE AminoAcidModifications (AminoAcidModificationID INTEGER, ModificationName TEXT); CREATE TABLE PeptidesAminoAcidModifications (PeptideID INTEGER, AminoAcidModificationID INTEGER, Position INTEGER);
CREATE TABLE PeptidesTerminalModifications (PeptideID INTEGER, TerminalModificationID INTEGER); CREATE TABLE SpectrumHeaders (SpectrumID INTEGER, Charge INTEGER, Mass REAL, FirstScan INTEGER, LastScan INTEGER, MassPeakID INTEGER);
CREATE TABLE MassPeaks (MassPeakID INTEGER, FileID INTEGER); CREATE TABLE FileInfos (FileID INTEGER, FileName TEXT); CREATE TABLE CustomDataFields (FieldID INTEGER, DisplayName TEXT); CREATE TABLE CustomDataPeptides (PeptideID INTEGER, FieldID INTEGER, FieldValue TEXT);""")
    rows = [(1, 11, "ACDEK", 9.0), (2, 12, "ACDEK", 8.0), (3, 13, "MNPQR", 7.0), (4, 13, "LNPQR", 6.5), (5, 14, "GGGGG", 1.0)]
    db.executemany("INSERT INTO Peptides VALUES (?,?,?)", [r[:3] for r in rows])
    db.executemany("INSERT INTO PeptideScores VALUES (?,?)", [(r[0], r[3]) for r in rows])
    if decoys:
        db.executemany("INSERT INTO Peptides_Decoy VALUES (?,?,?)", [(1, 15, "KEDCA")])
        db.executemany("INSERT INTO PeptideScores_Decoy VALUES (?,?)", [(1, 2.0)])
    db.executemany("INSERT INTO AminoAcidModifications VALUES (?,?)", [(1, "Oxidation"), (2, "Acetyl")])
    db.execute("INSERT INTO PeptidesAminoAcidModifications VALUES (3,1,0)")
    db.execute("INSERT INTO PeptidesTerminalModifications VALUES (3,2)")
    db.executemany("INSERT INTO SpectrumHeaders VALUES (?,?,?,?,?,?)", [(s, 2, 500.5, 100 + s + shift, 101 + s, 50 + s) for s in range(11, 16)])
    db.executemany("INSERT INTO MassPeaks VALUES (?,?)", [(50 + s, 1) for s in range(11, 16)])
    db.execute("INSERT INTO FileInfos VALUES (1, ?)", (f"C:\\data\\run{shift}.raw",))
    db.execute("INSERT INTO CustomDataFields VALUES (7, 'q-Value')")
    db.executemany("INSERT INTO CustomDataPeptides VALUES (?,?,?)", [(1, 7, "0.001"), (3, 7, "0.002"), (5, 7, "0.5")])
    db.commit()
    db.close()


def test_search_store_to_records(spark, tmp_path):
    store_file(str(tmp_path / "a.msf"), 0)
    store_file(str(tmp_path / "b.msf"), 1000)
    names = [*converters.STORE_TABLES, "CustomDataFields", "CustomDataPeptides"]
    tables = read_sqlite(spark, str(tmp_path / "*.msf"), names, file_col="store")
    assert tables["Peptides"].count() == 10
    records, listed = converters.search_store(tables, 0.1)
    got = {r.spec_id: (r.modifications, r.peptide, r.charge, r.tryptic) for r in records.collect()}
    # one of each (peptide, modifications, charge) over both files, then one of each spectrum
    assert got == {"a_1": ("-", "ACDEK", 2, True), "a_3": ("0|Acetyl|1|Oxidation", "MNPQR", 2, True)}
    assert {r.spec_id: (r.source_file, r.scan) for r in listed.collect()} == {"a_1": ("run0", 111), "a_3": ("run0", 113)}
    alone, _ = converters.search_store(read_sqlite(spark, str(tmp_path / "b.msf"), names, file_col="store"), 0.1, percolator="q-Value")
    assert {r.spec_id for r in alone.collect()} == {"b_1", "b_3"}
    spectra = spark.createDataFrame([("x scan=111", "/d/run0.mgf"), ("x scan=113", "/d/run1000.mgf"), ("y scan=113", "/d/run0.mgf")], "title string, source_file string")
    assert {r.title: r.source_file for r in converters.spectra_of_scans(spectra, listed).collect()} == {"a_1": "run0", "a_3": "run0"}
    with pytest.raises(ValueError):
        read_sqlite(spark, str(tmp_path / "a.msf"), ["Nothing"])


@pytest.mark.parametrize("file_format", ["parquet", "csv", "json"])
def test_vector_tables(spark, tmp_path, file_format):
    from ionlake.operators.features import feature_names, site_features
    from ionlake.plans.vectors import InvalidVectors, read_vectors, write_vectors

    peptides = spark.createDataFrame([("a", "ACDEK", 2), ("b", "MNPQRST", 3), ("c", "GGK", 3)], "psmid string, peptide string, charge int")
    targets = F.when(F.col("psmid") == "c", F.create_map(F.lit("B"), F.lit(0.5))).otherwise(F.create_map(F.lit("B"), F.col("site") * 1.0, F.lit("Y"), F.col("site") + 0.25))
    vectors = site_features(peptides, keep=("psmid", "peptide", "charge")).withColumn("targets", targets).select("psmid", "charge", "site", "features", "targets")
    path = str(tmp_path / "v")
    write_vectors(vectors, path, ["B", "Y"], file_format=file_format)
    rows = lambda df: sorted((r.psmid, r.charge, r.site, tuple(r.features), tuple(sorted(r.targets.items()))) for r in df.collect())
    assert rows(read_vectors(spark, path, file_format=file_format)) == rows(vectors)
    three = read_vectors(spark, path, ions=["Y"], charges=[3], only={0, 27}, file_format=file_format)
    want = [(p, c, s, tuple(v if k in (0, 27) else 0 for k, v in enumerate(f)), tuple((i, y) for i, y in t if i == "Y")) for p, c, s, f, t in rows(vectors) if c == 3]
    assert rows(three) == want
    if file_format == "parquet":
        scan = next(x for x in three._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
        schema = scan.split("ReadSchema: struct<")[1]
        assert feature_names()[27] in schema and feature_names()[30] not in schema and "targets_B" not in schema and "charge" in scan.split("PartitionFilters")[1].split("]")[0]
    with pytest.raises(InvalidVectors):
        read_vectors(spark, path, ions=["Z"], file_format=file_format)
    with pytest.raises(InvalidVectors):
        read_vectors(spark, path, version="ce", file_format=file_format)
    with pytest.raises(ValueError):
        write_vectors(vectors, path, ["B"], file_format="xlsx")


def test_small_operators(spark, tmp_path):
    from ionlake.functions.mods import named_count, parse_mods
    from ionlake.operators.digest import LibraryModification, modified_residues
    from ionlake.operators.peptides import counted_mass, precursor_mass
    from ionlake.operators.windows import renamed_values
    from ionlake.sinks.libraries import write_split
    from ionlake.sources.spectra import read_mgf

    rows = spark.createDataFrame([("a", "CCMK", "1|CAM|2|CAM|3|Oxidation", "HCD"), ("b", "GGK", "-", "old"), ("c", "GMK", "-", None)], "spec_id string, peptide string, modifications string, label string")
    count = named_count(parse_mods(F.col("modifications")), "CAM")
    got = {r.spec_id: r for r in rows.select("spec_id", count.alias("n"), counted_mass(F.col("peptide"), count).alias("m"), precursor_mass(F.col("peptide")).alias("p"), modified_residues(F.col("peptide"), [LibraryModification("Oxidation", 1.0, "M"), LibraryModification("CAM", 1.0, "C"), LibraryModification("Ac", 1.0, peptide_n_term=True)]).alias("r")).collect()}
    assert [got[k].n for k in "abc"] == [2, 0, 0] and got["a"].m == pytest.approx(got["a"].p + 2 * 57.02146, abs=1e-3) and sorted(got["a"].r) == ["C", "M"] and got["b"].r == []
    assert [r.label for r in renamed_values(rows, "label", {"old": "new", "HCD": "x"}, F.col("spec_id") != "a").orderBy("spec_id").collect()] == ["HCD", "new", None]
    assert [r.label for r in renamed_values(rows, "label", {}).orderBy("spec_id").collect()] == ["HCD", "old", None]
    records = spark.createDataFrame([(f"s{k}", "-", "ACDEK", 2) for k in range(60)], "spec_id string, modifications string, peptide string, charge int")
    peaks = F.array(F.struct(F.lit(100.0).cast("float").alias("mz"), F.lit(5.0).cast("float").alias("intensity")))
    spectra = spark.range(70).select(F.concat(F.lit("s"), F.col("id")).alias("title"), F.lit(400.5).alias("precursor_mz"), F.lit(2).alias("precursor_charge"), peaks.alias("peaks"), F.lit("f").alias("source_file"))
    write_split(records, spectra, str(tmp_path / "x"), 0.3)
    sides = {s: ({r.spec_id for r in read_peprec(spark, str(tmp_path / f"x_{s}.peprec")).collect()}, {r.title for r in read_mgf(spark, str(tmp_path / f"x_{s}.mgf")).collect()}) for s in ("train", "test")}
    assert all(a == b and a for a, b in sides.values()) and sides["train"][0].isdisjoint(sides["test"][0]) and len(sides["train"][0] | sides["test"][0]) == 60


def test_command_line_from_spectra_to_a_trained_model(spark, tmp_path, capsys):
    """Vectors of observed spectra, forests trained on them, saved by registry name and used for prediction."""
    from ionlake.operators.peptides import fragment_ions
    from ionlake.plans.vectors import read_vectors

    rng = np.random.default_rng(3)
    rows = [(f"s{k}", "-", "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), rng.integers(6, 12))) + "K", 2 + k % 2) for k in range(80)]
    (tmp_path / "p.peprec").write_text("spec_id modifications peptide charge\n" + "".join(" ".join(map(str, r)) + "\n" for r in rows))
    records = spark.createDataFrame(rows, "spec_id string, modifications string, peptide string, charge int")
    peaks = {}
    for r in fragment_ions(records).collect():
        peaks.setdefault(r.spec_id, []).append((r.mz, 2000.0 if r.ion == "Y" else 100.0 * (1 + r.ionnumber)))
    (tmp_path / "s.mgf").write_text("".join(f"BEGIN IONS\nTITLE={k}\nPEPMASS=400\n" + "".join(f"{m:.4f} {i}\n" for m, i in sorted(own)) + "END IONS\n" for k, own in peaks.items()))
    vectors, out, folder = str(tmp_path / "v"), str(tmp_path / "t"), str(tmp_path / "models")
    assert cli.main(["vectors", str(tmp_path / "p.peprec"), str(tmp_path / "s.mgf"), "-o", vectors], spark) == 0
    held = read_vectors(spark, vectors)
    assert held.count() == sum(len(r[2]) - 1 for r in rows) and set(held.first().targets) == {"B", "Y"}
    assert cli.main(["train", vectors, "HCD", "-t", "3", "--min-rows", "5", "-e", f"again={vectors}", "--model-dir", folder, "-o", out], spark) == 0
    history = spark.read.csv(out + "_history.csv", header=True, inferSchema=True).toPandas()
    first, last = (history[(history["ion"] == "B") & (history["set"] == "test") & (history["round"] == k)]["mae"].item() for k in (0, history[history["ion"] == "B"]["best_round"].iloc[0]))
    assert last < first and set(history["set"]) == {"train", "test", "again"}
    scored = spark.read.csv(out + "_predictions.csv", header=True, inferSchema=True)
    assert {tuple(r) for r in scored.select("ion", "set").distinct().collect()} == {(i, s) for i in "BY" for s in ("test", "again")}
    assert spark.read.csv(out + "_importance.csv", header=True).where("name = 'prefix_length'").count() >= 1
    assert "score_HCD2021_B" in spark.read.text(out + ".c", wholetext=True).first()[0]
    assert cli.main(["predict", str(tmp_path / "p.peprec"), "-o", str(tmp_path / "pred"), "-f", "parquet", "-n", f"B={folder}/HCD2021_B.json", f"Y={folder}/HCD2021_Y.json"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "pred.parquet")).count() == 2 * held.count()
    assert cli.main(["train", vectors, "HCDch2", "-o", out], spark) == 1 and "no targets of ion type B2" in capsys.readouterr().err


def test_search_picks_the_better_combination(vectors):
    from ionlake.plans.training import train_model

    (found,) = train_model(vectors, ["B"], "m", BoostParams(trees=3, min_rows=10, bins=16), search={"max_depth": [1, 4]}, folds=2)
    assert found.params.max_depth == 4 and set(found.searched["max_depth"]) == {1, 4} and found.fitted.nodes["leaf"].notna().any()


def test_query_of_held_out_errors_against_brute_force(spark, sf_dir):
    from ionlake import queries

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("held", F.pmod(F.xxhash64(F.col("l_orderkey").cast("string")), F.lit(5)) == 0).toPandas()
    x = np.stack([lines["l_quantity"], (lines["l_discount"] * 100).round(), (lines["l_tax"] * 100).round(), lines["l_linenumber"]], 1).astype(int)
    y, train = lines["l_extendedprice"].to_numpy() / 1000, ~lines["held"].to_numpy()
    params = BoostParams(trees=8, max_leaves=12, patience=2)
    edges = [sorted(set(x[train, k]))[1:] for k in range(4)]
    margins, errors = [np.full(len(y), y[train].mean())], []
    for _ in range(params.trees):
        margins.append(margins[-1] + brute_tree(x, margins[-1] - y, edges, params, train)[0])
        errors.append(np.abs(margins[-1] - y)[~train].mean())
        if len(errors) - 1 - int(np.argmin(errors)) >= params.patience:
            break
    best = np.abs(margins[int(np.argmin(errors)) + 1] - y)
    want = {line: (len(own), own.mean()) for line, own in ((k, best[x[:, 3] == k]) for k in sorted(set(x[:, 3])))}
    got = {r.line: (r.n, r.mae) for r in queries.QUERIES["leafwise_errors"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-9) for k in want)
