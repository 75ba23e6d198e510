"""The pipeline against the composition of its brute-force stages."""

import zlib
from collections import defaultdict

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from ionlake.llm.secret_scan import synthetic_secrets


def expected(rows):
    """(id, text) of the documents that reach the secret stage; rows: (id, text, source), ids unique."""
    verdicts = brute.host_verdicts([(t, s) for _, t, s in rows])
    held = [(i, t) for (i, t, _), (kept, _) in zip(rows, verdicts) if kept]
    exact = brute.exact_groups(held)
    held = [(i, t) for i, t in held if exact[i][2]]
    near = brute.near_classes(held)
    return [(i, t) for i, t in held if near[i] == i]


def masked(text, spans):
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_pipeline(spark, sf_dir):
    """Every piece of the result: the documents that stay, their masked texts' tokens, and sequences without gaps."""
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = expected(rows)
    spans = brute.markov_spans([t for _, t in kept], [x.decode() for x in synthetic_secrets()])
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for (i, t), own in zip(kept, spans):
        ids = np.array(tok.encode(masked(t, own), add_special_tokens=False).ids + [1], "<u4")
        want |= {(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096


def test_clashing_columns_come_back(spark, docs):
    """Columns named as those that the stages make inside keep their values."""
    table = docs.select("doc_id", "text", "lang", "source", "n_chars", F.lit(77).alias("_hash"), F.lit(5).alias("row"), F.lit(6).alias("text_hash"), F.lit("k").alias("kept"), F.lit(9).alias("Row_id"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, table, "")
        assert kept.columns == table.columns and kept.select("_hash", "row", "text_hash", "kept", "Row_id").distinct().collect() == [(77, 5, 6, "k", 9)]


def test_stages_keep_the_columns_and_mask_secrets(spark, docs):
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns
    secret = 'one two three four five six seven eight nine ten token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    table = spark.createDataFrame([(1, secret, "x", "s", 1), (2, None, "x", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.STAGES[3][1](spark, table, "").collect()}
    assert "04dbebab" not in got[1].text and got[1].text.endswith("[secret]\" end") and got[1].n_chars == len(got[1].text)
    assert got[2].text is None


def test_repeated_rows_become_one(spark):
    text = " ".join(f"word{k}" for k in range(40))
    table = spark.createDataFrame([(1, text, "x", "s", 1)] * 3 + [(1, text + " more", "x", "s", 1), (None, text + " other words that are new here", "x", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.STAGES[1][1](spark, table, "")
    assert kept.count() == 3
    assert corpus_pipeline.STAGES[2][1](spark, kept, "").where(F.col("text").isNotNull()).count() >= 1


def test_empty(spark, empty):
    kept = empty
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
    assert kept.count() == 0
