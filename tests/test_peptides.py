"""Peptides: filters, masses, ladders, modifications, digestion, features."""

import re

import pytest
from pyspark.sql import functions as F

from ionlake.functions.mods import (
    MOD_STRING,
    SEQUENCE,
    Catalogue,
    InvalidModification,
    Modification,
    add_fixed,
    bracket_ids,
    diff_sequence,
    format_mods,
    msp_mods,
    parse_mods,
    residue_suffix,
    tagged_to_mods,
)
from ionlake.functions.residues import PROPERTIES, RESIDUES
from ionlake.operators.digest import LibraryModification, digest, modification_versions, unique_peptides, with_decoys, with_proteins
from ionlake.operators.features import N_FEATURES, feature_names, site_features
from ionlake.operators.peptides import clean_peptides, fragment_ions, precursor_mass, precursor_mz

MODS = Catalogue.parse(["Oxidation,15.994915,opt,M", "Carbamidomethyl,57.021464,opt,C", "Acetyl,42.010565,opt,N-term", "Amide,-0.984016,opt,C-term"])


def peprec(spark, *rows):
    return spark.createDataFrame(list(rows), "spec_id string, peptide string, modifications string, charge int")


def test_filters(spark):
    rows = peprec(spark, ("a", "ACDE", None, 2), ("b", "AC", "-", 2), ("c", "ACXDE", "", 2), ("d", "A" * 100, "-", 2), ("e", "A" * 99, "", 2))
    got = {r.spec_id: r.modifications for r in clean_peptides(rows).collect()}
    assert got == {"a": "-", "e": "-"}


@pytest.mark.parametrize(
    "text, good",
    [("", True), ("-", True), ("17|Cmm", True), ("3|Cmm|11|Cmm", True), ("7|Cm-:?M", True), ("10|Cmm|", True), ("-1|Oxidation", True), ("|10|Cmm", False), ("1|Pyro_glu ", False), ("6|Cmm |25|Cmm", False), ("221|Cmm", False), ("-4|Oxidation", False)],
)
def test_modification_grammar(text, good):
    assert bool(re.match(MOD_STRING, text)) == good


@pytest.mark.parametrize("text, good", [("HKA", True), ("SETAPLAPTIPAPAEK", True), ("LASYAVBYR", False), ("-KAVASVAK-", False), ("VM(ox)SAF", False), ("HK", False), ("A" * 99, True), ("A" * 100, False)])
def test_sequence_grammar(text, good):
    assert bool(re.match(SEQUENCE, text)) == good


def test_modification_definitions():
    assert Modification.parse("Oxidation,15.994915,opt,M") == Modification("Oxidation", 15.994915, "M")
    for bad in ("Oxidation,15.9,M", "Oxidation,15.9,opt,X", "Oxidation,15.9,opt,"):
        with pytest.raises(InvalidModification):
            Modification.parse(bad)


def test_precursor(spark):
    row = peprec(spark, ("a", "LYKMAVGFMLAHPYGFTRVMSSYR", "-", 2)).select(precursor_mass(F.col("peptide")).alias("m"), precursor_mz(precursor_mass(F.col("peptide")), F.col("charge")).alias("z")).first()
    assert abs(row.m - 2824.401514683699) < 1e-9 and abs(row.z - 1413.2085823739) < 1e-9


def ions(rows, **options):
    return {(r.ion, r.ionnumber): r.mz for r in fragment_ions(rows, **options).collect()}


def test_ladders(spark):
    # public b, y, b++, y++ and c ions of ACDE
    want = {("B", 1): 72.04444, ("B", 2): 175.05362, ("B", 3): 290.08056, ("Y", 1): 148.06048, ("Y", 2): 263.08742, ("Y", 3): 366.09661}
    want |= {("B2", 1): 36.52588, ("B2", 3): 145.54394, ("Y2", 1): 74.53390, ("Y2", 3): 183.55196}
    rows = peprec(spark, ("a", "ACDE", "-", 2))
    got = ions(rows, version="ch2")
    assert len(got) == 12 and all(abs(got[k] - v) < 2e-4 for k, v in want.items())
    got = ions(rows, version="etd")
    assert all(abs(got["C", k] - v) < 2e-3 for k, v in ((1, 89.07098), (2, 192.08017), (3, 307.10711)))
    everything = ions(rows, version="all")
    assert len(everything) == 18 * 3 and abs(everything["B-H2O", 2] - (got["B", 2] - 18.010565)) < 1e-9 and abs(everything["X2", 1] - (ions(rows, version="ch2")["Y2", 1] + 25.97926 / 2)) < 1e-9


def test_modified_ladder(spark):
    plain, got = (ions(peprec(spark, ("a", "MCDE", m, 2)), catalogue=MODS) for m in ("-", "0|Acetyl|1|Oxidation|2|Carbamidomethyl|-1|Amide"))
    assert abs(got["B", 1] - plain["B", 1] - 42.010565 - 15.994915) < 1e-9
    assert abs(got["B", 2] - plain["B", 2] - 42.010565 - 15.994915 - 57.021464) < 1e-9
    assert abs(got["Y", 1] - plain["Y", 1] + 0.984016) < 1e-9


def test_modification_strings(spark):
    row = peprec(spark, ("a", "MACMK", "0|Acetyl|4|Oxidation|-1|Amide", 2)).withColumn("p", parse_mods(F.col("modifications")))
    none = F.array().cast("array<struct<pos:int,name:string>>")
    got = row.select(
        format_mods(F.reverse("p")).alias("same"),
        msp_mods(F.col("peptide"), F.col("p")).alias("msp"),
        diff_sequence(F.col("peptide"), F.col("p"), MODS).alias("diff"),
        bracket_ids(F.col("peptide"), F.col("p"), {"Acetyl": 1, "Oxidation": 35, "Amide": 2}).alias("ids"),
        format_mods(add_fixed(F.col("peptide"), none, {"C": "Carbamidomethyl"}, "Acetyl")).alias("fixed"),
        format_mods(residue_suffix(F.lit("ASTY"), parse_mods(F.lit("2|Phospho|4|Phospho")), "Phospho")).alias("suffix"),
        format_mods(tagged_to_mods(F.lit("_(ac)AM(ox)CM(ox)K_"), {"ac": "Acetyl", "ox": "Oxidation"})).alias("tags"),
    ).first()
    assert got.same == "0|Acetyl|4|Oxidation|-1|Amide"
    assert got.msp == "3/0,M,Acetyl/3,M,Oxidation/4,K,Amide"
    assert got["diff"] == "M[+42.0]ACM[+16.0]K[-1.0]"
    assert got.ids == "[unimod:1]MAC[unimod:35]M[unimod:2]K"
    assert got.fixed == "0|Acetyl|3|Carbamidomethyl" and got.suffix == "2|PhosphoS|4|PhosphoY"
    assert got.tags == "0|Acetyl|2|Oxidation|4|Oxidation"


def test_odd_modification_string_is_an_error(spark):
    with pytest.raises(Exception, match="odd number"):
        peprec(spark, ("a", "ACDE", "1|Acetyl|2", 2)).select(parse_mods(F.col("modifications"))).collect()


def test_digest(spark):
    seq = "MYSSCSLLQRLVWFPFLALVATQLLFIRNVSSLNLTNEYLHHKCLVSEGKYKPGSKYEYI"
    rows = spark.createDataFrame([("P1", seq), ("P2", ""), ("P3", None)], "protein string, sequence string")
    got = digest(rows).collect()
    want = {"MYSSCSLLQR", "MYSSCSLLQRLVWFPFLALVATQLLFIR", "LVWFPFLALVATQLLFIR", "NVSSLNLTNEYLHHK", "NVSSLNLTNEYLHHKCLVSEGK", "NVSSLNLTNEYLHHKCLVSEGKYKPGSK", "CLVSEGKYKPGSK", "CLVSEGKYKPGSKYEYI", "YKPGSKYEYI"}
    assert {r.peptide for r in got} == want and len(got) == 9
    assert all(seq[r.start :].startswith(r.peptide) and r.is_n_term == (r.start == 0) and r.is_c_term == (r.start + len(r.peptide) == len(seq)) for r in got)
    whole = digest(rows, "unspecific", min_length=3, max_length=5).collect()
    assert sorted((r.start, r.peptide) for r in whole) == sorted((i, seq[i : i + k]) for k in (3, 4, 5) for i in range(len(seq) - k + 1))
    semi = {(r.start, r.peptide) for r in digest(rows, missed_cleavages=0, min_length=5, max_length=30, semi_specific=True).collect()}
    full = [(0, 10), (10, 28), (28, 43), (43, 50), (50, 56), (56, 60)]
    assert semi == {(i, seq[i:j]) for a, b in full for i, j in [(a, k) for k in range(a + 1, b + 1)] + [(k, b) for k in range(a, b)] if 5 <= j - i <= 30}


def test_trypsin_exceptions(spark):
    rows = spark.createDataFrame([("P", "AKPWKPMRPRPKA")], "protein string, sequence string")
    assert [r.peptide for r in digest(rows, missed_cleavages=0, min_length=1).orderBy("start").collect()] == ["AKPWK", "PMR", "PRPK", "A"]


def test_long_protein(spark):
    rows = spark.createDataFrame([("P", "ACDEFGHIKLMNPQRSTVWY" * 2000)], "protein string, sequence string")
    got = digest(rows, missed_cleavages=0, min_length=1, max_length=99)
    assert got.count() == 4001 and got.agg(F.max("start")).first()[0] == 39995


def test_decoys_and_redundancy(spark):
    rows = spark.createDataFrame([("P1", "MAAK"), ("P2", "CKMAAK")], "protein string, sequence string")
    assert {(r.protein, r.sequence) for r in with_decoys(rows).where("is_decoy").collect()} == {("DECOY_P1", "MKAA"), ("DECOY_P2", "CKAAMK")}
    found = digest(rows, missed_cleavages=0, min_length=2)
    got = {r.peptide: r for r in with_proteins(unique_peptides(found), found).collect()}
    assert got["MAAK"].proteins == ["P1", "P2"] and got["MAAK"].n_proteins == 2 and got["MAAK"].protein == "P1" and got["MAAK"].is_n_term and got["MAAK"].is_c_term


def test_a_peptide_of_all_proteins_is_counted_without_a_list(spark):
    rows = spark.range(3000).select(F.col("id").alias("protein"), F.concat(F.lit("MAAAK"), F.translate(F.col("id").cast("string"), "0123456789", "ACDEFGHILM"), F.lit("CCK")).alias("sequence"))
    unique = unique_peptides(digest(rows, missed_cleavages=0, min_length=4))
    assert unique.where("peptide = 'MAAAK'").select("n_proteins", "protein", "is_n_term", "is_c_term").first()[:] == (3000, 0, True, False)
    assert "collect" not in unique._jdf.queryExecution().toString() and unique.count() == 3001


def brute_digest(seq, rule, missed, low, high, semi):
    cuts = [0, *(i for i in range(1, len(seq)) if re.match(rule, seq[i:]) or any(m.start() == i for m in re.finditer(rule, seq))), len(seq)]
    out = []
    for a in range(len(cuts) - 1):
        for b in range(a + 1, min(a + 2 + missed, len(cuts))):
            spans = [(cuts[a], cuts[b])] if not semi else [(cuts[a], e) for e in range(cuts[a] + 1, cuts[b] + 1)] + [(s, cuts[b]) for s in range(cuts[a], cuts[b])]
            out += [(s, seq[s:e]) for s, e in spans if low <= e - s <= high and not re.search("[BJOUXZ]", seq[s:e])]
    return sorted(set(out) if semi else out)


@pytest.mark.parametrize("semi", [False, True])
def test_digestion_against_brute_force(spark, monkeypatch, semi):
    """Parts of a long sequence repeat nothing, whatever the size of a part."""
    import random

    from ionlake.operators import digest as module

    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWYX") for _ in range(n)) for n in (0, 1, 30, 400)] + [None, "KKKKRRR", "ÄKCDEFÖR"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "protein int, sequence string")
    rule = module.CLEAVAGE_RULES["trypsin"]
    got = digest(rows, missed_cleavages=2, min_length=2, max_length=9, semi_specific=semi).collect()
    for k, s in enumerate(seqs):
        assert sorted((r.start, r.peptide) for r in got if r.protein == k) == (brute_digest(s, rule, 2, 2, 9, semi) if s else [])
    long = seqs[3]
    for size in (1, 50, 200_000):
        monkeypatch.setattr(module, "_CUT_ROWS", size)
        spans = [x for a, b in module._spans(long, "trypsin", 2, 2, 9, semi) for x in zip(a.tolist(), b.tolist())]
        assert len(spans) == len(set(spans)) and sorted((a, long[a:b]) for a, b in spans if "X" not in long[a:b]) == brute_digest(long, rule, 2, 2, 9, semi)


MOD_CASES = [
    ("ADEF", {"-"}),
    ("ACCDE", {"2|Carbamidomethyl|3|Carbamidomethyl"}),
    ("ADMME", {"-", "3|Oxidation", "4|Oxidation", "3|Oxidation|4|Oxidation"}),
    ("ADMMME", {"-", "3|Oxidation", "4|Oxidation", "5|Oxidation", "3|Oxidation|4|Oxidation", "4|Oxidation|5|Oxidation", "3|Oxidation|5|Oxidation"}),
    ("EDEF", {"-", "0|Glu->pyro-Glu"}),
]


def test_modification_versions(spark):
    mods = [LibraryModification("Oxidation", 15.9994, "M"), LibraryModification("Carbamidomethyl", 57.0513, "C", fixed=True), LibraryModification("Glu->pyro-Glu", -18.010565, "E", protein_n_term=True)]
    rows = spark.createDataFrame([(p, True, False) for p, _ in MOD_CASES], "peptide string, n boolean, c boolean")
    got = {r.peptide: r.v for r in rows.select("peptide", modification_versions(F.col("peptide"), F.col("n"), F.col("c"), mods, 2).alias("v")).collect()}
    assert all(set(got[p]) == want and len(got[p]) == len(want) for p, want in MOD_CASES)
    with pytest.raises(ValueError):
        LibraryModification("Nowhere", 1.0)


def restated(peptide, charge):
    """The layout of the feature vectors, as a plain loop."""
    r = [0] + [RESIDUES.index(c) for c in peptide.replace("L", "I")]
    n, rows = len(peptide), []
    for i in range(n - 1):
        v = [n, charge, *(int(charge == k) for k in (1, 2, 3, 4)), int(charge >= 5)]
        for t in PROPERTIES.values():
            own = sorted(t[k] for k in r[1:])
            v += [own[int(q * (n - 1))] for q in (0, 0.25, 0.5, 0.75, 1)]
        v += [i + 1, n - i]
        for a in range(19):
            v += [r[1 : i + 2].count(a), r[1 : n - i].count(a)]
        for t in PROPERTIES.values():
            v += [t[r[1]], t[r[n]], 0 if i == 0 else t[r[i - 1]], t[r[i]], t[r[i + 1]], t[r[i + 2]]]
            own = sorted(t[k] for k in r[1 : i + 2])
            v += [sum(own), *(own[int(q * i)] for q in (0, 0.25, 0.5, 0.75, 1))]
            own, m = sorted(t[k] for k in r[i + 2 :]), n - 1 - i
            v += [sum(own), own[0], own[int(0.25 * m)], own[int(0.5 * m)], own[int(0.75 * m)], own[m - 1]]
        rows.append(v)
    return rows


def test_features(spark):
    peptides = [("ACDE", 2), ("ACDEFGHI", 3), ("LYKMAVGFMLAHPYGFTRVMSSYR", 6), ("WWK", 1)]
    rows = spark.createDataFrame(peptides, "peptide string, charge int")
    got = {(r.peptide, r.site): list(r.features) for r in site_features(rows).collect()}
    assert all(got[p, i] == v for p, z in peptides for i, v in enumerate(restated(p, z))) and len(got) == 3 + 7 + 23 + 2
    first = got["ACDE", 1]
    assert first[:7] == [4, 2, 0, 1, 0, 0, 0] and first[7:12] == [35, 35, 37, 59, 129] and first[69] == 37
    for version, n in N_FEATURES.items():
        assert len(feature_names(version)) == n == len(site_features(rows.withColumn("ce", F.lit(30)), version).first().features)
