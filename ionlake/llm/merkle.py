"""Merkle manifest of a table by superblock reduction.

Every row is a leaf; the leaves of a group, in order, are hashed in runs of ``fanout`` until one node
remains, and the groups' nodes in turn until the root. Leaves are indexed globally by a range
exchange of short rows, as sharding does; a bucket of fanout^levels neighbours then collapses that
many levels inside one task, and its one node goes on to the next reduction. A row's proof is the
concatenation of what it met in each of them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import shared_checkpoint, shared_table

#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the values, each as its UTF-8 byte count, a colon and itself, or ``-`` if null; 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(_field(v) for v in values)).cast("binary"), 256))


def _joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def _depth(size: int, fanout: int) -> int:
    """Levels from ``size`` nodes to one."""
    levels = 0
    while size > 1:
        size, levels = -(-size // fanout), levels + 1
    return levels


def collapse(digests: list[bytes], steps: int, fanout: int) -> tuple[bytes, list[bytes]]:
    """The node ``steps`` levels above neighbouring nodes, and the siblings of each on the way, left to right."""
    paths: list[list[bytes]] = [[] for _ in digests]
    nodes, width = digests, 1  # a node of this level stands above ``width`` of the first
    for _ in range(steps):
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for k in range(len(run)):
                siblings = b"".join(run[:k] + run[k + 1 :])
                if siblings:
                    for leaf in range((start + k) * width, min((start + k + 1) * width, len(digests))):
                        paths[leaf].append(siblings)
        nodes = [_joined(nodes[s : s + fanout]) for s in range(0, len(nodes), fanout)]
        width *= fanout
    return nodes[0], [b"".join(p) for p in paths]


def fold(digest: bytes, path: bytes, at: int, index: int, size: int, fanout: int) -> tuple[bytes, int]:
    """The node above all ``size`` leaves, from leaf ``index`` and its siblings from byte ``at`` on; and where they end."""
    while size > 1:
        place = index % fanout
        others = (min(fanout, size - index + place) - 1) * DIGEST
        left, right = path[at : at + place * DIGEST], path[at + place * DIGEST : at + others]
        digest = _joined([left, digest, right])
        at, index, size = at + others, index // fanout, -(-size // fanout)
    return digest, at


def _places(batches):
    """Adds the partition's number and the row's place in it."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        extra = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(place, place + batch.num_rows), pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "place"])
        place += batch.num_rows


def _ranged(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with ``part`` and ``place``, in order by both; and ``before`` of each part: one row a partition.

    Rows that are equal in ``order`` are told apart by their place in the input, so they fill several ranges.
    """
    own = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = own.repartitionByRange(*order, "row").sortWithinPartitions(*order, "row").drop("row")
    placed = shared_checkpoint(ranged.mapInArrow(_places, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, part int, place long"))
    starts, before = [], 0
    for t in placed.groupBy("part").count().orderBy("part").collect():
        starts.append((t["part"], before))
        before += t["count"]
    return placed, rows.sparkSession.createDataFrame(starts, "part int, before long")


def _reduced(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The rounds of the reduction, lowest first: their nodes with bucket, path and top (the bucket's node).

    ``nodes`` has tree, index, size (of the tree) and digest; further columns stay in the first round.
    In the last round every tree is one bucket.
    """
    width = fanout**levels

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        steps = min(levels, _depth(table["size"][0].as_py(), fanout))
        top, paths = collapse(table["digest"].to_pylist(), steps, fanout)
        return table.append_column("path", pa.array(paths, pa.binary())).append_column("top", pa.array([top] * table.num_rows, pa.binary()))

    rounds, biggest = [], None
    while biggest is None or biggest > width:
        keyed = nodes.withColumn("bucket", F.floor(F.col("index") / F.lit(width)).cast("long"))
        kind = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in keyed.schema)}, path binary, top binary"
        done = shared_table(keyed.groupBy("tree", "bucket").applyInArrow(apply, kind), "merkle")
        rounds.append(done)
        biggest = done.agg(F.max("size")).first()[0] or 0
        size = F.ceil(F.col("size") / F.lit(width)).cast("long")
        nodes = done.where(F.col("index") % width == 0).select("tree", F.col("bucket").alias("index"), size.alias("size"), F.col("top").alias("digest"))
    return rounds


def _assembled(rounds: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The lowest round's rows with their whole ``path``, ``subroot`` and, from ``above`` (tree, path, root), ``root``.

    A bucket's rows meet the one row of their bucket: no key has more rows than a bucket holds.
    """
    last = rounds[-1].withColumn("subroot", F.col("top"))
    if above is None:
        found = last.withColumn("root", F.col("top"))
    else:
        found = last.join(above.withColumnRenamed("path", "upper"), "tree").withColumn("path", F.concat("path", "upper")).drop("upper")
    for lower in reversed(rounds[:-1]):
        upper = found.select("tree", F.col("index").alias("bucket"), F.col("path").alias("upper"), "subroot", "root")
        found = lower.join(upper, ["tree", "bucket"]).withColumn("path", F.concat("path", "upper")).drop("upper")
    return found


def merkle_manifest(docs: DataFrame, fields=FIELDS, group_col: str = "lang", id_col: str = "doc_id", fanout: int = 2, levels: int = 12, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, path (32-byte digests), index, size, tree, trees, and ``carry``.

    ``index`` is the leaf's place among the ``size`` leaves of its group, ``tree`` the group's among the
    ``trees`` groups; ``path`` joins the siblings from leaf to root. Leaves ascend by id, nulls first; of
    rows that share an id those with the smaller leaf come first, and rows that are equal throughout are
    leaves each. Groups ascend bytewise, null first. A group of one leaf is that leaf, and a table of one
    group has its node as root. An empty table gives an empty result; texts of any length are hashed whole,
    and columns that no field names are ignored. ``levels`` are collapsed in one task.
    """
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be at least 2 and levels at least 1")
    more = carry or {}
    leaf = leaf_digest([docs[c] for c in fields])
    rows = docs.select(docs[id_col].alias("id"), docs[group_col].alias("group"), leaf.alias("digest"), *(c.alias(f"carry_{n}") for n, c in more.items()))
    placed, offsets = _ranged(rows, ["group", "id", "digest"])
    # a group's rows in one partition: about as many of these as partitions and groups
    spans = placed.groupBy("part", "group").agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("rows")).join(offsets, "part")
    groups, group_offsets = _ranged(spans.groupBy("group").agg(F.min(F.col("before") + F.col("low")).alias("first"), F.sum("rows").alias("size")), ["group"])
    trees = groups.join(group_offsets, "part").select("group", "first", "size", (F.col("before") + F.col("place")).alias("tree"))
    n_trees = trees.count()
    spans = spans.alias("s").join(trees.alias("t"), F.expr("s.group <=> t.group")).select("s.part", "s.group", "tree", "size", (F.col("before") - F.col("first")).alias("shift"))
    nodes = (
        placed.alias("p")
        .join(spans.alias("s"), F.expr("p.part = s.part AND p.group <=> s.group"))
        .select("tree", (F.col("place") + F.col("shift")).alias("index"), "size", "digest", "id", *(f"carry_{n}" for n in more))
    )
    rounds = _reduced(nodes, fanout, levels)
    subroots = rounds[-1].where("index = 0").select(F.lit(0).cast(LongType()).alias("tree"), F.col("tree").alias("index"), F.lit(n_trees).cast("long").alias("size"), F.col("top").alias("digest"))
    above = _assembled(_reduced(subroots, fanout, levels), None).select(F.col("index").alias("tree"), "path", "root")
    return _assembled(rounds, above).select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", "index", "size", "tree", F.lit(n_trees).cast("long").alias("trees"), *(F.col(f"carry_{n}").alias(n) for n in more)
    )


def fold_proofs(manifest: DataFrame, claim: str = "leaf", fanout: int = 2) -> DataFrame:
    """The manifest with ``proof_sha256`` (of the siblings), ``folded_root`` (from the digest in ``claim``, or the leaf where that is null) and ``verified``."""
    if claim != "leaf":
        manifest = manifest.withColumn(claim, F.coalesce(claim, "leaf"))

    def apply(batches):
        for batch in batches:
            proofs, roots = [], []
            for digest, path, index, size, tree, trees in zip(*(batch.column(c).to_pylist() for c in (claim, "path", "index", "size", "tree", "trees")), strict=True):
                proofs.append(hashlib.sha256(path.hex().encode()).hexdigest())
                node, at = fold(digest, path, 0, index, size, fanout)
                roots.append(fold(node, path, at, tree, trees, fanout)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(proofs, pa.string()), pa.array(roots, pa.binary())], names=[*batch.schema.names, "proof_sha256", "folded_root"])

    kind = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in manifest.schema)}, proof_sha256 string, folded_root binary"
    return manifest.mapInArrow(apply, kind).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_leaf(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", count_col: str = "n_chars", every: int = 7) -> Column:
    """The leaf of a row whose ``count_col`` grew by 1, where ``every`` divides the crc32 of the decimal id; else null.

    A null id has no decimal form and is never tampered with; a null count stays null.
    """
    grown = {count_col: docs[count_col].cast("decimal(20,0)") + 1}
    hit = F.crc32(docs[id_col].cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf_digest([grown.get(c, docs[c]) for c in fields]))
