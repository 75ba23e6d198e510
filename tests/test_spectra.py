"""Spectra: readers, pre-processing, targets, metrics, windows, matching."""

import base64
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionlake.functions import metrics
from ionlake.operators import windows
from ionlake.operators.spectra import interval_max, normalise, preprocess, remove_precursor, row_targets, spectrum_id, tic
from ionlake.sources.spectra import mgf_headers, read_mgf, read_mzml, read_spectra, spectra_in_folder

MGF = """BEGIN IONS
TITLE=first one
PEPMASS=475.137295 1000.0
CHARGE=2+
72.04444 101 # b1
148.06048 302.5
1e2 3
END IONS

BEGIN IONS
TITLE=second
36.5 103
END IONS

# text behind the blocks
"""


@pytest.fixture()
def mgf_file(tmp_path):
    (tmp_path / "a.mgf").write_text(MGF)
    return str(tmp_path / "a.mgf")


def test_mgf(spark, mgf_file):
    got = {r.title: r for r in read_spectra(spark, mgf_file).collect()}
    one, two = got["first one"], got["second"]
    assert (one.precursor_mz, one.precursor_charge) == (475.137295, 2) and [(round(p.mz, 4), p.intensity) for p in one.peaks] == [(72.0444, 101.0), (148.0605, 302.5), (100.0, 3.0)]
    assert (two.precursor_mz, two.precursor_charge, len(two.peaks)) == (None, None, 1)
    assert spectra_in_folder(spark, mgf_file.rsplit("/", 1)[0]).count() == 2
    assert "peaks" not in mgf_headers(spark, mgf_file)._jdf.queryExecution().optimizedPlan().output().toString()
    with pytest.raises(ValueError):
        read_spectra(spark, "x.raw")


def mzml(level, mz, it, compress):
    pack = lambda v, c: base64.b64encode((zlib.compress if compress else bytes)(struct.pack(f"<{len(v)}{c}", *v))).decode()
    array = lambda v, c, kind, width: f'<binaryDataArray><cvParam accession="{width}" value=""/><cvParam accession="{kind}" value=""/>{"<cvParam accession=%r value=%r/>" % ("MS:1000574", "") if compress else ""}<binary>{pack(v, c)}</binary></binaryDataArray>'
    chosen = '<precursorList><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="500.25"/><cvParam accession="MS:1000041" value="3"/></selectedIon></selectedIonList></precursor></precursorList>'
    return f'<spectrum id="scan={level}"><cvParam accession="MS:1000511" value="{level}"/>{chosen}<binaryDataArrayList>{array(mz, "d", "MS:1000514", "MS:1000523")}{array(it, "f", "MS:1000515", "MS:1000521")}</binaryDataArrayList></spectrum>'


@pytest.mark.parametrize("compress", [True, False])
def test_mzml(spark, tmp_path, compress):
    body = mzml(1, [1.0], [2.0], compress) + mzml(2, [100.5, 200.25], [7.0, 8.0], compress)
    (tmp_path / "a.mzML").write_text(f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>{body}</spectrumList></run></mzML>')
    (got,) = read_mzml(spark, str(tmp_path / "a.mzML")).collect()
    assert (got.title, got.precursor_mz, got.precursor_charge) == ("scan=2", 500.25, 3) and [(p.mz, p.intensity) for p in got.peaks] == [(100.5, 7.0), (200.25, 8.0)]


def test_preprocessing(spark):
    peaks = "array<struct<mz:float,intensity:float>>"
    rows = spark.createDataFrame([([(114.0, 50.0), (126.0, 25.0), (300.0, 25.0)],)], f"peaks {peaks}")
    got = preprocess(rows, "iTRAQ").first()
    assert got.tic == 100.0 and [round(p.intensity, 4) for p in got.peaks] == [round(math.log2(x + 0.001), 4) for x in (0, 0.25, 0.25)]
    kept = rows.select(remove_precursor(F.col("peaks"), F.lit(126.01)).alias("p"), tic(F.col("peaks")).alias("t")).first()
    assert [p.intensity for p in kept.p] == [50.0, 0.0, 25.0]


def test_targets_agree(spark):
    rng = np.random.default_rng(0)
    mz, peaks = np.sort(rng.uniform(100, 120, 60)), [(float(a), float(b)) for a, b in zip(rng.uniform(100, 120, 200), rng.uniform(1, 9, 200))]
    rows = spark.createDataFrame([(mz.tolist(), peaks)], "ions array<double>, peaks array<struct<mz:double,intensity:double>>")
    got = rows.select(row_targets(F.col("ions"), F.col("peaks"), 0.05)).first()[0]
    want = [max((b for a, b in peaks if m - 0.05 <= a <= m + 0.05), default=math.log2(0.001)) for m in mz]
    assert np.allclose(got, want, atol=1e-5)
    left = spark.createDataFrame([(1, float(m)) for m in mz], "k int, m double")
    right = spark.createDataFrame([(1, a, b) for a, b in peaks] + [(2, float(mz[0]), 99.0)], "k int, x double, v double")
    joined = {r.m: r.target for r in interval_max(left, right, "k", "m", "x", "v", 0.05).collect()}
    assert np.allclose([math.log2(0.001) if joined[m] is None else joined[m] for m in mz], want, atol=1e-5)


def test_spectrum_ids(spark):
    rows = spark.createDataFrame([("scan 12 of a.raw",)], "title string")
    assert rows.select(spectrum_id(F.col("title"), r"scan ([0-9]+)")).first()[0] == "12" and rows.select(spectrum_id(F.col("title"))).first()[0] == "scan 12 of a.raw"
    with pytest.raises(Exception, match="no spectrum id"):
        rows.select(spectrum_id(F.col("title"), r"cycle ([0-9]+)")).collect()
    with pytest.raises(ValueError):
        spectrum_id(F.col("title"), "scan")


def test_metrics(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=20), rng.normal(size=20)
    rows = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)] + [("one", 1.0, 2.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in rows.groupBy("k").agg(metrics.safe_corr(F.col("x"), F.col("y")).alias("r"), metrics.corr_or_zero(F.col("x"), F.col("y")).alias("z"), metrics.spectral_angle(F.abs("x"), F.abs("y")).alias("s")).collect()}
    assert abs(got["a"].r - np.corrcoef(x, y)[0, 1]) < 1e-12 and got["one"].r is None and got["flat"].r is None and got["flat"].z == 0
    cosine = np.abs(x) @ np.abs(y) / np.linalg.norm(x) / np.linalg.norm(y)
    assert abs(got["a"].s - (1 - 2 * math.acos(cosine) / math.pi)) < 1e-9


def test_normalisation(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0)], "spec_id string, prediction double")
    values = lambda method, **o: sorted((r.spec_id, None if r.prediction is None else round(r.prediction, 6)) for r in normalise(rows, method, **o).collect() if r.spec_id == "a")
    assert values("tic") == [("a", 0.25), ("a", 0.75)] and values("basepeak_10000") == [("a", 3333.333333), ("a", 10000.0)]
    assert values("basepeak_1", log_space=True) == [("a", round((2 - 0.001) / (8 - 0.001), 6)), ("a", 1.0)]
    assert normalise(rows, "tic").where("spec_id = 'b'").first().prediction is None
    with pytest.raises(ValueError):
        normalise(rows, "none")


MZS = [72.04435, 143.08147, 214.11859, 559.345, 630.3821]


def test_top_peaks_and_containment(spark):
    row = spark.createDataFrame([(MZS, [0.1, 0.9, 0.2, 0.9, 0.5])], "mz array<double>, it array<double>")
    top = lambda n: row.select(windows.top_peaks(F.col("mz"), F.col("it"), n)).first()[0]
    assert top(2) == [143.08147, 559.345] and top(9) == MZS and top(0) == []
    inside = lambda o, p, e=0.02: row.select(windows.contains_all(F.array(*map(F.lit, o)).cast("array<double>"), F.array(*map(F.lit, p)).cast("array<double>"), e)).first()[0]
    assert inside(MZS, []) and not inside([], []) and not inside([], [3.0]) and inside(MZS, MZS[1:4])
    assert not inside(MZS, [MZS[0] + 0.021]) and inside(MZS, [MZS[0] + 0.021], 0.05)


def test_range_match(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 5, 100), rng.uniform(0, 5, 80)
    left = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "i int, x double")
    right = spark.createDataFrame([(j, float(y)) for j, y in enumerate(b)], "j int, y double")
    got = {(r.i, r.j) for r in windows.range_match(left, right, "x", "y", 0.1).collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if y - 0.1 < x < y + 0.1}


@pytest.mark.parametrize("limits", [{"cell_rows": 7, "cell_pairs": 50}, {"cell_rows": 300, "cell_pairs": 2000}, {}])
def test_range_match_of_one_frequent_value(spark, limits):
    """Half of all rows at one m/z: its cells stay small, and every pair comes once, nulls and equal bounds included."""
    a = [2.5] * 150 + [k * 0.02 for k in range(150)] + [None]
    b = [2.5] * 60 + [k * 0.05 for k in range(60)] + [2.6, None]
    left = spark.createDataFrame([(i, x, [f"t{i}"]) for i, x in enumerate(a)], "i int, x double, tags array<string>").repartition(3)
    right = spark.createDataFrame([(j, y) for j, y in enumerate(b)], "j int, y double").repartition(2)
    met = windows.range_match(left, right, "x", "y", 0.1, **limits)
    plan = met._jdf.queryExecution().executedPlan().toString()
    got = [(r.i, r.j) for r in met.collect()]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and x > y - 0.1 and x < y + 0.1}
    assert len(got) == len(want) and set(got) == want
    assert plan.count("Exchange hashpartitioning(_cell") == 2 and "Join" not in plan
    assert windows.range_match(left.limit(0), right, "x", "y", 0.1).count() == 0


def test_q_values_agree(spark):
    rng = np.random.default_rng(1)
    made = [(i, float(rng.integers(0, 40)), bool(rng.random() < 0.3)) for i in range(500)]
    rows = spark.createDataFrame(made, "i int, score double, decoy boolean")
    want, bad, good = {}, 0, 0
    for i, _, d in sorted(made, key=lambda r: (-r[1], r[0])):
        bad, good = bad + d, good + (not d)
        want[i] = bad / good if good else None
    for got in (windows.q_values(rows, "score", "decoy", ["i"]), windows.q_values(rows.withColumn("run", F.lit(1)), "score", "decoy", ["i"], ["run"])):
        assert {r.i: r.q_value for r in got.collect()} == want


def test_splits_numbers_and_bins(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 100).repartition(5)
    train, test = windows.stable_split(rows, "k", 0.2)
    assert not {r.k for r in train.collect()} & {r.k for r in test.collect()} and train.count() + test.count() == 1000
    got = windows.global_numbers(rows, ["id"], 5).collect()
    assert sorted((r.id, r.scan) for r in got) == [(i, i + 5) for i in range(1000)]
    bins = windows.quantile_bins(rows, "id", 4).groupBy("bin").count().collect()
    assert sorted((r.bin, r["count"]) for r in bins) == [(0, 250), (1, 250), (2, 250), (3, 250)]
    islands = windows.gap_islands(spark.createDataFrame([(1, v) for v in (1.0, 1.5, 4.0, 4.2, 9.0)], "g int, v double"), "v", 2.0, ["g"], [])
    assert [r.island for r in islands.orderBy("v").collect()] == [0, 0, 1, 1, 2]


def test_ranks_by_ranges(spark):
    """Against plain loops: ties, nulls, a null group and a group that holds most rows."""
    import statistics

    from ionlake.operators import ranks

    rows = [("a", float(k * 7 % 50)) for k in range(300)] + [("b", 3.0)] * 40 + [("b", 1.0), (None, 5.0), (None, 2.0), ("c", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    held = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("a", "b", None)}
    got = {r.g: (r.n, r.quantiles) for r in ranks.quantiles(table, "v", ["g"], [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got.keys() == held.keys()
    for g, own in held.items():
        at = [q * (len(own) - 1) for q in (0.0, 0.25, 0.5, 1.0)]
        want = [own[int(x)] + (own[min(int(x) + 1, len(own) - 1)] - own[int(x)]) * (x - int(x)) for x in at]
        assert got[g][0] == len(own) and all(abs(x - y) < 1e-12 for x, y in zip(got[g][1], want))
    assert {r.g: r.upper_median for r in ranks.upper_medians(table, "v", ["g"]).collect()} == {g: statistics.median_high(own) for g, own in held.items()}
    everything = [v for _, v in rows if v is not None]
    assert abs(ranks.quantiles(table, "v", [], [0.5]).first().quantiles[0] - statistics.median(everything)) < 1e-12
    totals = ranks.running_totals(table.where("v is not null"), ["v"], {"n": F.lit(1).cast("long")}, ["g"])
    assert sorted(r.n for r in totals.where("g = 'a'").collect()) == list(range(1, 301))


def test_global_islands(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 1.5, 4.0, 4.2, 9.0)], "v double")
    assert [r.island for r in windows.gap_islands(rows, "v", 2.0, [], []).orderBy("v").collect()] == [0, 0, 1, 1, 2]
