"""Work that stays where the rows lie: the same results as the plain plans, without their shuffles."""

import random

import pytest
from pyspark.sql import functions as F

from ionlake.functions.mods import add_fixed, fixed_mods, format_mods
from ionlake.operators.digest import CLEAVAGE_RULES, CLEAVAGE_SITES, digest, peptide_counts
from ionlake.operators.features import N_FEATURES, site_features, site_sums
from ionlake.operators.peptides import fragment_ions, ladder_totals
from ionlake.plans.pipeline import predict_totals
from ionlake.plans.trees import toy_nodes
from ionlake.queries import CATALOGUE, QUERIES, _folded, _grouped_features, _grouped_predictions, peptides


def shuffles_by_key(df):
    return "hashpartitioning" in df._jdf.queryExecution().executedPlan().toString()


def test_peptide_counts(spark, sf_dir):
    """Counted where the sequence lies as if peptides were grouped, also for ids that several rows or none have."""
    texts = ["ACDEFGHIKACDEFGHIK" * 3, "AAAAAAAAAAAA", "ACDKAXCDRPEWKPM", "ACDEFGH", "", None, "ÄÖACDEFGÄÖACDEFG", "ACDKACDKACDEFGHIKACDK"]
    ids = ["a", "b", "c", "d", "e", "f", None, "g", "a", None, "g"]
    for own in (ids[:8], ids):
        rows = spark.createDataFrame([(i, texts[k % 8]) for k, i in enumerate(own)], "protein string, sequence string").repartition(3)
        for options in ({"rule": "unspecific", "min_length": 3, "max_length": 14}, {"missed_cleavages": 1, "min_length": 2}, {"min_length": 2, "max_length": 20, "semi_specific": True}):
            found = digest(rows, **options).groupBy("protein").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("peptide").alias("n_distinct"), F.sum("start").alias("sum_start"))
            got = sorted(peptide_counts(rows, **options).collect(), key=str)
            assert got == sorted(found.collect(), key=str) and len(got) >= 5
    assert not shuffles_by_key(QUERIES["digest_unspecific"](spark, sf_dir))  # no peptide is written to disk


def test_fixed_modification_strings(spark):
    fixed = {"C": "Carbamidomethyl", "M": "Oxidation"}
    rows = spark.createDataFrame([("ACDMMC",), ("ADEK",), ("",), (None,), ("ÄCöM" * 30,), ("C" * 120,)], "peptide string").repartition(2)
    none = F.array().cast("array<struct<pos:int,name:string>>")
    got = rows.select(fixed_mods(F.col("peptide"), fixed).alias("got"), format_mods(add_fixed(F.col("peptide"), none, fixed)).alias("want")).collect()
    assert len(got) == 6 and all(r.got == r.want for r in got) and {r.got for r in got} >= {"2|Carbamidomethyl|4|Oxidation|5|Oxidation|6|Carbamidomethyl", "-", None}


def test_ladder_totals(spark, sf_dir):
    """A ladder summed up where it is made is the sum over its ions' rows."""
    records = [("a", "ACDEK", "2|Carbamidomethyl", 2), ("b", "MMAC", "-1|Oxidation|1|Oxidation", 2), ("c", "A", "-", 2), ("d", "AXBK", "2|Nothing", 3), ("e", "ACXK", None, 3), ("f", None, "-", 2), ("g", "BBB", "-", 2)]
    rows = spark.createDataFrame(records, "spec_id string, peptide string, modifications string, charge int").repartition(2)
    for version in ("general", "etd", "ch2", "all"):
        own = sorted(ladder_totals(rows, version, CATALOGUE).collect(), key=str)
        assert own == sorted(_folded(fragment_ions(rows, version, CATALOGUE)).collect(), key=str) and len(own) >= 10
    assert ladder_totals(rows.drop("modifications"), "ch2").count() == 4 * 5
    with pytest.raises(Exception, match="odd number"):
        ladder_totals(rows.withColumn("modifications", F.lit("1|Oxidation|2")), "general", CATALOGUE).collect()
    for name in ("fragment_ladder_by", "neutral_loss_series"):
        assert not shuffles_by_key(QUERIES[name](spark, sf_dir))  # no ion is a row that is written to disk


@pytest.fixture
def repeating(spark, tmp_path):
    """Documents of which two share an id and two have none."""
    texts = ["A peptide MKACDEFGHIKLLCMM", "Some other text, RACDEFGHICKLM that ends", "A peptide MKACDEFGHIKLLCMM", "null id PEPTIDEKACDEFGH", "none either KACDEFGHIKPEPTIDE", "alone WKPEPTIDECMSTRAAAAAAAAK"]
    spark.createDataFrame(list(zip([1, 1, 2, None, None, 3], texts, strict=True)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_ladders_of_repeated_ids(spark, repeating):
    """One row for each spec_id and ion type, whatever documents the ions come from."""
    got = sorted(QUERIES["fragment_ladder_by"](spark, repeating).collect(), key=str)
    want = sorted(_folded(fragment_ions(peptides(spark, repeating), "general", CATALOGUE)).select("spec_id", "ion", "n_ions").collect(), key=str)
    assert sorted([(r.spec_id, r.ion, r.n_ions) for r in got], key=str) == sorted(map(tuple, want), key=str)
    assert len({(r.spec_id, r.ion) for r in got}) == len(got) >= 8 and any(r.spec_id is None for r in got)


def test_predict_totals(spark, sf_dir, repeating):
    """Predictions added up where they are made are the sums over the ions' rows; unknown modifications are left out."""
    records = [("a", "ACDEK", "2|Carbamidomethyl", 2), ("b", "MMACLL", "1|Oxidation", 3), ("c", "AC", "-", 2), ("d", "ACDK", "2|Nothing", 3), ("e", "AIXK", None, 3), ("f", None, "-", 2), ("g", "PEPTIDE" * 14, None, 5)]
    rows = spark.createDataFrame(records, "spec_id string, peptide string, modifications string, charge int").repartition(2)
    got = sorted(map(tuple, predict_totals(rows, toy_nodes(), CATALOGUE).collect()))
    assert got == sorted(map(tuple, _grouped_predictions(rows).collect())) and [r[:3] for r in got[:2]] == [("a", "B", 4), ("a", "Y", 4)] and len(got) == 6
    with pytest.raises(Exception, match="unknown modification"):
        predict_totals(rows, toy_nodes(), CATALOGUE, strict=True).collect()
    assert not shuffles_by_key(QUERIES["predict_spectra"](spark, sf_dir))  # no value is a row
    # records that share an id make one row for each ion type
    got = sorted(map(tuple, QUERIES["predict_spectra"](spark, repeating).collect()), key=str)
    assert got == sorted(map(tuple, _grouped_predictions(peptides(spark, repeating)).collect()), key=str)


@pytest.mark.parametrize("rule", sorted(CLEAVAGE_SITES))
def test_short_sequences_are_cut_together(spark, rule):
    """Sequences cut together give the pieces that the rule's pattern gives one by one, and no piece crosses two of them."""
    draw = random.Random(rule)
    texts = ["".join(draw.choices("KRPWMDEFYAX", k=draw.randint(0, 60))) for _ in range(300)] + ["", "K", "P", "KP", "WK", "PKP", "WKPMRP", "ÄKRPDEF", "AK\n"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "protein long, sequence string").repartition(3)
    for missed, low in ((0, 1), (2, 3)):
        got = sorted(map(tuple, digest(rows, rule, missed, low, 30).collect()))
        assert got == sorted(map(tuple, digest(rows, f"(?:{CLEAVAGE_RULES[rule]})", missed, low, 30).collect())) and len(got) > 300


def test_site_sums(spark, sf_dir, repeating):
    """Features added up where they are made are the sums over their sites' rows."""
    made = ["ACDE", "LYKMAVGFMLAHPYGFTRVMSSYR", "WWK", "AK", "K", "", None, "AXBK", "PEPTIDE" * 13]
    rows = spark.createDataFrame([(p, 1 + k % 6, 25 + k) for k, p in enumerate(made * 3)], "peptide string, charge int, ce int").repartition(2)
    for version, n in N_FEATURES.items():
        weights = {"all": list(range(1, n + 1)), "some": [k % 7 == 3 for k in range(n)]}
        own = [F.aggregate(F.zip_with("features", F.array(*[F.lit(int(x)) for x in w]), lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) for w in weights.values()]
        want = site_features(rows, version, ("peptide", "charge", "ce")).groupBy("peptide", "charge", "ce").agg(F.count(F.lit(1)).alias("n_sites"), *[F.sum(x) for x in own])
        got = sorted(map(tuple, site_sums(rows, weights, version, ("peptide", "charge", "ce")).collect()))
        assert got == sorted(map(tuple, want.collect())) and len(got) == 18
    assert not shuffles_by_key(QUERIES["site_features"](spark, sf_dir))  # no site is a row
    assert sorted(QUERIES["site_features"](spark, repeating).collect(), key=str) == sorted(_grouped_features(peptides(spark, repeating)).collect(), key=str)
