"""Contiguous shards of equal bytes, cut from global prefix sums.

Rows are put in the order of their content digest (equal texts adjacent) and then id, by a range
exchange of short rows; each partition adds up its own sizes, the partition totals (one row per
partition) give every partition its global offset, and each row's offset decides its shard.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint, text_or_empty

#: A group of equal texts is kept whole when it has at most this share of a shard's bytes.
WHOLE_GROUP_SHARE = 0.01


def _running_sums(batches):
    """Adds the partition number, the row's place in it and the bytes before it."""
    part, place, offset = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch.column("size")
        ends = pc.add(pc.cumulative_sum(size), offset)
        columns = [
            *batch.columns,
            pa.array([part] * batch.num_rows, pa.int32()),
            pa.array(range(place, place + batch.num_rows), pa.int64()),
            pc.subtract(ends, size),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "place", "before"])
        place, offset = place + batch.num_rows, ends[-1].as_py()


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", whole_group_share: float = WHOLE_GROUP_SHARE) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 length plus 1 (null text: 1). Shard k takes the rows whose bytes
    start in the k-th of ``shards`` equal parts of the total, so two shards differ by less than two
    rows' sizes plus the whole-group share. Groups of equal texts of up to that share are never
    split: the cut inside one moves to its nearer end; larger ones are cut where the cut falls.
    ``whole_group_share`` is that share (0: cuts fall where they fall, between rows). ``slot`` numbers a
    shard's rows from 0 without gaps. Rows that repeat text and id are ordered arbitrarily but counted
    each, and dealt to ranges by their place in the input too, so a row repeated without end fills
    several; null ids come first in their group. Extra columns are ignored. An empty table gives an
    empty result, and with fewer rows than shards some shards are empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = text_or_empty(docs[text_col])
    rows = docs.select(
        docs[id_col].alias("id"),
        F.md5(text.cast("binary")).alias("digest"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )
    ranged = rows.repartitionByRange("digest", "id", "row").sortWithinPartitions("digest", "id", "row").drop("row")
    kind = f"id {rows.schema['id'].dataType.simpleString()}, digest string, size long, crc long, part int, place long, before long"
    placed = shared_checkpoint(ranged.mapInArrow(_running_sums, kind))

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    starts, byte, row = [], 0, 0
    for t in totals:
        starts.append((t["part"], byte, row))
        byte, row = byte + t["bytes"], row + t["rows"]
    total = byte
    offsets = placed.sparkSession.createDataFrame(starts, "part int, part_bytes long, part_rows long")
    cuts = _move_to_group_ends(placed, starts, [total * k // shards for k in range(1, shards)], total / shards * whole_group_share)

    at = F.col("before") + F.col("part_bytes")
    index = F.col("place") + F.col("part_rows")
    shard, first = F.lit(0), F.lit(0).cast("long")
    for k, (cut, rows_before) in enumerate(cuts, 1):
        shard = F.when(at >= cut, F.lit(k)).otherwise(shard)
        first = F.when(at >= cut, F.lit(rows_before).cast("long")).otherwise(first)
    # one row per partition of the range exchange: bounded by the number of partitions, not of rows
    return placed.join(F.broadcast(offsets), "part").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"),
        (index - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _move_to_group_ends(placed: DataFrame, starts: list, targets: list[int], whole_bytes: float) -> list[tuple[int, int]]:
    """For each target offset: the cut, and the number of rows before it.

    Reads one row per cut from the data: the group of equal texts that straddles it.
    """
    if not starts:
        return [(0, 0) for _ in targets]
    byte_of = {p: b for p, b, _ in starts}
    row_of = {p: r for p, _, r in starts}
    order = sorted(byte_of)
    begin = [byte_of[p] for p in order]
    wanted = {}
    for cut in targets:
        k = max(0, bisect_left(begin, cut + 1) - 1)
        wanted.setdefault((order[k], cut - begin[k]), []).append(cut)
    test = F.lit(False)
    for part, local in wanted:
        test = test | ((F.col("part") == part) & (F.col("before") <= local) & (F.col("before") + F.col("size") > local))
    hits = placed.where(test).select("digest", "part", "place", "before", "size").collect()
    digests = sorted({h["digest"] for h in hits})
    spans = {}
    if digests:
        in_group = placed.where(F.col("digest").isin(digests))
        edge = F.struct("part", "place", "before")
        for g in in_group.groupBy("digest").agg(F.min(edge).alias("a"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect():
            low = byte_of[g["a"]["part"]] + g["a"]["before"]
            first = row_of[g["a"]["part"]] + g["a"]["place"]
            spans[g["digest"]] = (low, low + g["bytes"], first, first + g["rows"])
    out = []
    for cut in targets:
        hit = next(h for h in hits if byte_of[h["part"]] + h["before"] <= cut < byte_of[h["part"]] + h["before"] + h["size"])
        low, high, first, after = spans[hit["digest"]]
        start, row = byte_of[hit["part"]] + hit["before"], row_of[hit["part"]] + hit["place"]
        if high - low <= max(hit["size"], whole_bytes):
            out.append((low, first) if cut - low <= high - cut else (high, after))
        else:
            out.append((start, row) if cut - start <= start + hit["size"] - cut else (start + hit["size"], row + 1))
    return out
