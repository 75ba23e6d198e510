"""Exact duplicates by sorting the content itself.

Texts are normalised (A-Z lower-cased, nothing else) and dealt to ranges by sampled splitters on
the order (first bytes of the text, hash of the text, hash of the row's id and position); the sample
that reaches the driver holds such short keys, never texts. Each range is sorted by Spark's external sorter, so
equal texts lie side by side, and every row is compared in full with the row before it: where two
neighbours differ in a byte a new run begins. A text that many rows share fills several ranges,
and becomes a run in each.

Runs inside a range are whole groups. Only runs at a range's ends can go on in the next range; they
are joined as a chain of edges, the last text of a range compared in full with the first of the
next, with one row for each end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, shared_checkpoint, shared_table, text_or_empty

#: Bytes of text a range holds on average, and sampled keys behind a splitter.
RANGE_BYTES = 64 << 20
SAMPLED = 40
PREFIX = 24


def _binary(number: Column) -> Column:
    """Eight bytes whose order is that of the signed number."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def _order_keys(norm: Column, row_hash: Column) -> tuple[Column, Column]:
    """(key, place): the key is equal for equal texts; the place orders rows of a key by their hash, which rows that repeat each other do not share."""
    key = F.concat(F.rpad(F.substring(norm, 1, PREFIX), PREFIX, b"\0"), _binary(F.xxhash64(norm)))
    return key, F.concat(key, _binary(row_hash))


def splitters(rows: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 sorted places that cut the rows' bytes evenly, from a sample of SAMPLED rows a range."""
    count = rows.count()
    if ranges < 2 or not count:
        return []
    share = min(1.0, SAMPLED * ranges / count)
    sample = rows if share == 1.0 else rows.sample(share, seed=7)
    _, place = _order_keys(F.col("norm"), F.col("row_hash"))
    got = sorted((bytes(r["place"]), r["size"]) for r in sample.select(place.alias("place"), (F.octet_length("norm") + 64).alias("size")).collect())
    total, held, out = sum(n for _, n in got), 0, []
    for own, n in got:
        if held * ranges >= total * (len(out) + 1) and len(out) < ranges - 1:
            out.append(own)
        held += n
    return sorted(set(out))


def _range_of(place: Column, cuts: list[bytes]) -> Column:
    """How many cuts are at or below the place: a binary search over the literal list."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    array = F.lit([bytearray(c) for c in cuts])
    move = lambda at, step: F.when(F.coalesce(F.get(array, at + step - 1) <= place, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(F.lit(steps), F.lit(0), move)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text, so all null and empty rows are one group. ``keep`` names
    the identifier that stays (``smallest`` or ``largest``); a null id loses to any other, and of
    rows that repeat both text and id exactly one is kept. Texts of any length are compared whole;
    a task holds about ``range_bytes`` of them, also of a row that repeats without end, and spills beyond its memory. An empty table gives
    an empty result. Other columns of ``docs`` are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    best = F.max if keep == "largest" else F.min
    ranked = (lambda c: F.col(c).desc_nulls_last()) if keep == "largest" else (lambda c: F.col(c).asc_nulls_last())
    spark = docs.sparkSession

    norm = ascii_lower(text_or_empty(docs[text_col])).cast("binary")
    rows = docs.select(docs[id_col].alias("id"), norm.alias("norm"), F.xxhash64(docs[id_col], F.monotonically_increasing_id()).alias("row_hash"))
    size = docs.agg(F.sum(F.octet_length(text_or_empty(docs[text_col])).cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    cuts = splitters(rows, ranges)
    key, place = _order_keys(F.col("norm"), F.col("row_hash"))
    dealt = rows.withColumn("key", key).withColumn("range", _range_of(place, cuts)).drop("row_hash").repartitionById(len(cuts) + 1, "range")

    order = Window.partitionBy("range").orderBy("key", "norm", ranked("id"))
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run = Window.partitionBy("range", "run")
    runs = (
        dealt.withColumn("same", F.lag("norm").over(order) == F.col("norm"))
        .withColumn("edge", (F.col("key") == F.first("key").over(whole)) | (F.col("key") == F.last("key").over(whole)))
        .withColumn("starts", F.coalesce(~F.col("same"), F.lit(True)))
        .withColumn("run", F.sum(F.col("starts").cast("int")).over(before))
        # only the first text of a run at an end travels on
        .select("id", "range", "run", "starts", "edge", F.sha2("norm", 256).alias("digest"), F.when(F.col("edge") & F.col("starts"), F.col("norm")).alias("end_text"))
        .withColumn("run_keep", best("id").over(run))
        .withColumn("run_size", F.count(F.lit(1)).over(run))
        # the window's order put the run's best id on its first row
        .select("id", "range", "run", "starts", "edge", "digest", "end_text", "run_keep", "run_size")
    )
    light = shared_table(runs, "runs")
    ends = shared_checkpoint(_joined_ends(light.where("edge and starts"), best, ranked))
    return light.join(ends, ["range", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("run_keep")).otherwise(F.col("group_keep")).alias("keep_id"),
        F.coalesce("group_size", "run_size").alias("group_size"),
        (F.col("starts") & F.coalesce("wins", F.lit(True))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _joined_ends(ends: DataFrame, best, ranked) -> DataFrame:
    """(range, run, group_keep, group_size, wins) of the runs at the ranges' ends.

    ``ends`` has a row for each of those runs: about two a range, however many rows there are.
    """
    span = Window.partitionBy("range")
    marked = ends.withColumn("first", F.col("run") == F.min("run").over(span)).withColumn("last", F.col("run") == F.max("run").over(span))
    # the ranges that have rows, in order: numbers only
    previous = marked.where("first").select("range", F.lag("range").over(Window.orderBy("range")).alias("previous"))
    firsts = marked.where("first").select("range", F.col("end_text").alias("text")).join(previous, "range")
    lasts = marked.where("last").select(F.col("range").alias("previous"), F.col("end_text").alias("last_text"))
    goes_on = firsts.join(lasts, "previous").where(F.col("text") == F.col("last_text")).select("range", F.lit(True).alias("first"), F.lit(True).alias("goes_on"))
    chained = marked.join(goes_on, ["range", "first"], "left").withColumn("head", F.col("goes_on").isNull())
    along = Window.orderBy("range", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = chained.select("range", "run", "run_keep", "run_size", F.sum(F.col("head").cast("int")).over(along).alias("chain"))
    # texts that share key and range ends lie between each other's runs: heads of one text are one group
    heads = chained.where("head").join(numbered.select("range", "run", "chain"), ["range", "run"]).select("chain", F.min("chain").over(Window.partitionBy("end_text")).alias("group"))
    group = Window.partitionBy("group")
    return (
        numbered.join(heads, "chain")
        .withColumn("group_keep", best("run_keep").over(group))
        .withColumn("group_size", F.sum("run_size").over(group))
        .withColumn("wins", F.row_number().over(group.orderBy(ranked("run_keep"), "range", "run")) == 1)
        .select("range", "run", "group_keep", "group_size", "wins")
    )
