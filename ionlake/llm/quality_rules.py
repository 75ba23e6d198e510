"""Text quality rules with verdicts on whole hosts.

Every document is measured by built-in column functions in one pass without a shuffle; its rule
failures are added up by host (partial sums first, so a host with a third of all rows is no
hotter than any other); each host's failure rate is shrunk towards a beta prior fitted to all
hosts by moments; and hosts whose shrunken rate is surely too high, measured by the corpus' own,
reject their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected when its shrunken failure rate, less DEVIATIONS posterior deviations, is above so many times
#: the corpus' rate; a host of at most HOST_FLOOR never is, one above HOST_RATE always.
HOST_MULTIPLE = 4.0
HOST_FLOOR = 0.2
HOST_RATE = 0.6
DEVIATIONS = 2.0
#: Weight of the beta prior, in documents.
MIN_PRIOR, MAX_PRIOR = 2.0, 1e4
SPACE = r"[\x20\x09-\x0D]+"


def _windows(words: Column) -> Column:
    """Every five-word window as one string; words hold no space, so the join is unambiguous."""
    last = F.size(words) - WINDOW
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))
    )


def _covered(pairs: Column) -> Column:
    """Words inside windows that occur twice or more; ``pairs`` is sorted (window, place)."""
    n = F.size(pairs)
    places = F.filter(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.when(
                F.coalesce(F.get(pairs, i)["w"] == F.get(pairs, i - 1)["w"], F.lit(False))
                | F.coalesce(F.get(pairs, i - 2)["w"] == F.get(pairs, i - 1)["w"], F.lit(False)),
                F.get(pairs, i - 1)["i"],
            ),
        ),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        F.sort_array(places),
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )


def rule_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Measures of each document; null text has no words, and a null host is a host of its own."""
    base = docs.select(docs[id_col].alias("id"), docs[host_col].alias("host"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    split = base.select(
        "id",
        "host",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, SPACE, ""))) > 0).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("words")).alias("windows"),
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform(F.col("windows"), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    listed = counted.withColumn("pairs", F.when(repeats, pairs)).drop("windows")
    return listed.withColumn("n_repeat_words", F.when(F.col("pairs").isNotNull(), _covered(F.col("pairs"))).otherwise(F.lit(0).cast("long"))).drop("pairs")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    A document fails by itself when it has under ``MIN_WORDS`` words or when repeated five-word
    windows cover more than ``MAX_REPEAT_PERCENT`` % of them. ``host_rate`` is the host's failure
    rate under the beta prior; a lone host, or hosts that do not differ, get the weakest prior. A host is
    rejected when that rate is surely above HOST_MULTIPLE times the corpus' rate, which HOST_FLOOR and
    HOST_RATE bound. A document is kept when it passes by itself and its host is not rejected. Null texts fail, null
    hosts are judged together, a text of any length is measured whole, repeated rows are judged each,
    other columns are ignored, an empty table gives no rows.
    """
    metrics = rule_metrics(docs, id_col, text_col, host_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = shared_checkpoint(metrics.withColumn("base_failed", failed))
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("base_failed").cast("int")).cast("double").alias("bad"))
    # moments over hosts: one row
    moments = hosts.agg(
        (F.sum("bad") / F.sum("n")).alias("mean"),
        F.coalesce(F.var_pop(F.col("bad") / F.col("n")), F.lit(0.0)).alias("var"),
    ).first()
    mean, var = moments["mean"] or 0.0, moments["var"]
    limit = min(HOST_RATE, max(HOST_FLOOR, HOST_MULTIPLE * mean))
    strength = min(MAX_PRIOR, max(MIN_PRIOR, mean * (1 - mean) / var - 1)) if var > 0 else MIN_PRIOR
    verdicts = (
        hosts.select("host", ((F.col("bad") + mean * strength) / (F.col("n") + strength)).alias("host_rate"), (F.col("n") + strength + 1).alias("weight"))
        .withColumn("rejected", F.col("host_rate") - DEVIATIONS * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / F.col("weight")) > limit)
        .withColumnRenamed("host", "its_host")
    )
    return judged.join(verdicts, F.col("host").eqNullSafe(F.col("its_host"))).select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.col("rejected")).alias("kept"),
        "host_rate",
    )
