"""Nearest neighbours by inner product: vantage-point trees per shard.

Vectors of norm at most M become points of the unit sphere, (x / M, sqrt(1 - |x|^2 / M^2)), and queries
(q / |q|, 0): there the nearest point is the one of largest inner product, and the triangle inequality
holds. A routing tree, built from a bounded sample, deals the vectors to shards of neighbours; each shard
is a vantage-point tree of its own. A query first searches the shard it falls into, which bounds its
distance, then goes to the shards that the bound cannot rule out. A subtree whose distances from the
vantage point differ from the query's by more than ``factor`` times the bound is left out: at factor 1
only what cannot be nearer, so the search is exact; below 1 more, at the price of recall.

Distances decide only where to look: a result's score is the inner product of the vectors as given,
in double precision, its terms added in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

#: Vectors of a shard, and queries that one task takes to it, at most.
SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
#: Vectors of the sample behind the routing tree on average, and those for each of its leaves.
SAMPLE_ROWS = 20_000
SAMPLED_PER_LEAF = 16
#: Vectors of a tree's leaf.
LEAF_ROWS = 128
#: Rounding of distances near 0, where the square root magnifies it.
SLACK = 1e-7
FOUND = "query long, query_id long, candidate long, vec_id long, score double"


class Tree:
    """A vantage-point tree over points: nodes as (vantage, inner child, outer child, their ranges) or leaves."""

    def __init__(self, points: np.ndarray, leaf_rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(points))
        self.vantage: list[np.ndarray | None] = []
        self.split: list[float] = []
        self.child: list[tuple[int, int]] = []  # of a leaf: its rows in ``order``
        self.span: list[tuple[float, float, float, float]] = []  # inner from, to; outer from, to
        open_nodes = [(0, len(points), self._new())]
        while open_nodes:
            start, end, node = open_nodes.pop()
            rows = self.order[start:end]
            if end - start <= leaf_rows:
                self.child[node] = (start, end)
                continue
            far = self._distances(points[rows], points[rows[rng.integers(len(rows))]])
            vantage = points[rows[int(far.argmax())]]  # a rim point: the shells around it are thin
            d = self._distances(points[rows], vantage)
            half = (end - start) // 2
            near = np.argpartition(d, half)
            split = float(d[near[half]])
            inner = d < split
            if not inner.any():  # half of all and more are equally far
                inner = d <= split
                split = float(np.nextafter(split, 4))
            if inner.all():
                self.child[node] = (start, end)
                continue
            self.order[start:end] = np.concatenate([rows[inner], rows[~inner]])
            middle = start + int(inner.sum())
            children = (self._new(), self._new())
            self.vantage[node], self.split[node], self.child[node] = vantage, split, children
            self.span[node] = (float(d[inner].min()), float(d[inner].max()), float(d[~inner].min()), float(d[~inner].max()))
            open_nodes += [(start, middle, children[0]), (middle, end, children[1])]

    def _new(self) -> int:
        self.vantage.append(None)
        self.split.append(0.0)
        self.child.append((0, 0))
        self.span.append((0.0, 0.0, 0.0, 0.0))
        return len(self.child) - 1

    @staticmethod
    def _distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((points - vantage) ** 2).sum(axis=1)))

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into, by the splits alone."""
        node = np.zeros(len(points), np.int64)
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            at, rows = open_nodes.pop()
            node[rows] = at
            if self.vantage[at] is not None and len(rows):
                inner = self._distances(points[rows], self.vantage[at]) < self.split[at]
                open_nodes += [(self.child[at][0], rows[inner]), (self.child[at][1], rows[~inner])]
        return node

    def leaves_within(self, points: np.ndarray, reach: np.ndarray):
        """(leaf, rows of points) for leaves whose region may hold something closer to a point than its reach."""
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            at, rows = open_nodes.pop()
            if self.vantage[at] is None:
                yield at, rows
                continue
            # regions end at the split: points that the sample lacked lie in them too
            d = self._distances(points[rows], self.vantage[at]) - self.split[at]
            for child, go in zip(self.child[at], (d <= reach[rows] + SLACK, -d <= reach[rows] + SLACK), strict=True):
                if go.any():
                    open_nodes.append((child, rows[go]))


class Best:
    """The k best of each query: largest score, then smallest id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score = np.full((queries, k), -np.inf)
        self.id = np.zeros((queries, k), np.int64)
        self.row = np.full((queries, k), -1, np.int64)

    def least(self) -> np.ndarray:
        """The score that a candidate has to reach."""
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        touched = np.unique(query)
        old_q, old_k = np.nonzero(self.row[touched] >= 0)
        old_q = touched[old_q]
        query = np.concatenate([old_q, query])
        score, ids, rows = (np.concatenate([own[old_q, old_k], new]) for own, new in ((self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, query))
        query = query[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = place < self.k
        to = (query[keep], place[keep])
        for own, new in ((self.score, score), (self.id, ids), (self.row, rows)):
            own[to] = new[order][keep]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the terms added from the first to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def on_sphere(vectors: np.ndarray, most: float) -> np.ndarray:
    scaled = vectors / most
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def as_queries(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    return np.concatenate([unit, np.zeros((len(vectors), 1))], axis=1)


def distance_of(score: np.ndarray, norms: np.ndarray, most: float) -> np.ndarray:
    """From a query to a point whose inner product with it is ``score``; infinite for none."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isneginf(score), np.inf, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * score / (most * norms))))


def search(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, most: float, factor: float) -> tuple[Best, int]:
    """The k best vectors of each query but its own row, by one tree; and the inner products that were looked at.

    Candidates below a query's ``floor`` may be left out. Queries go through the tree together and part
    where the bound of some rules a subtree out.
    """
    best = Best(len(queries), k, floor)
    points, probes, norms = on_sphere(vectors, most), as_queries(queries), np.linalg.norm(queries, axis=1)
    tree = Tree(points, LEAF_ROWS)
    del points
    seen = 0
    open_nodes = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
    while open_nodes:
        at, active, gap = open_nodes.pop()
        go = gap <= factor * distance_of(best.least()[active], norms[active], most) + SLACK
        active, gap = active[go], gap[go]
        if not len(active):
            continue
        if tree.vantage[at] is not None:
            d = tree._distances(probes[active], tree.vantage[at])
            low, high, out_low, out_high = tree.span[at]
            sides = [(child, np.maximum(gap, np.maximum(d - b, a - d))) for child, a, b in zip(tree.child[at], (low, out_low), (high, out_high), strict=True)]
            if np.count_nonzero(d < tree.split[at]) * 2 >= len(active):  # the side of most goes first: it is taken from the end
                sides.reverse()
            open_nodes += [(child, active, g) for child, g in sides]
            continue
        own_rows = tree.order[slice(*tree.child[at])]
        member, least = vectors[own_rows], best.least()[active]
        rough = queries[active] @ member.T
        seen += rough.size
        margin = 1e-12 * norms[active] * most
        take = (rough >= (least - margin)[:, None]) & (own[active][:, None] != rows[own_rows][None, :])
        q, c = np.nonzero(take)
        if len(q):
            hit, cand = active[q], own_rows[c]
            best.add(hit, inner_products(queries[hit], vectors[cand]), ids[cand], rows[cand])
    return best, seen


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors as rows of doubles, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def _with_norms(batches):
    """Adds norm and dim to the vectors that take part and drops the others."""
    for batch in batches:
        keep, norms, dims = [], [], []
        for k, vector in enumerate(batch.column("vector")):
            x = None if not vector.is_valid else vector.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes nan
            if x is not None and len(x) and np.isfinite(x).all() and x.any():
                keep.append(k)
                norms.append(float(np.sqrt((x**2).sum())))
                dims.append(len(x))
        if keep:
            chosen = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(norms), pa.array(dims, pa.int32())], names=[*batch.schema.names, "norm", "dim"])


def _batched(batch: pa.RecordBatch, most: int = 4096):
    for start in range(0, batch.num_rows, most):
        yield batch.slice(start, most)


def _searched(visits: DataFrame, vectors: DataFrame, sizes: dict[int, int], shard_rows: int, block_rows: int, k: int, dim: int, most: float, factor: float) -> DataFrame:
    """The k best of each visit (query row, leaf, floor) in each part of the leaf: FOUND.

    A leaf of more than ``shard_rows`` vectors is dealt to parts, a leaf of many visits to blocks of them; each
    pair of part and block is a task of bounded size.
    """
    asked = {r["leaf"]: r["n"] for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = [(leaf, -(-sizes.get(leaf, 0) // shard_rows), -(-n // block_rows)) for leaf, n in sorted(asked.items()) if sizes.get(leaf, 0)]
    spark = visits.sparkSession
    # one row for each leaf of the routing tree, which a bounded sample made
    parts = F.broadcast(spark.createDataFrame(plan, "leaf long, parts long, blocks long"))
    dealt = lambda df, key: df.join(parts, "leaf").withColumn("at", F.xxhash64(key))
    shards = dealt(vectors, "row").select("leaf", F.expr("pmod(at, parts)").alias("part"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "row", "vec_id", "vector")
    blocks = dealt(visits, "row").select("leaf", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.expr("pmod(at, blocks)").alias("block"), "row", "vec_id", "vector", "floor")

    def apply(asked: pa.Table, shard: pa.Table) -> pa.Table:
        empty = pa.table([[]] * 5, pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("candidate", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))
        if not asked.num_rows or not shard.num_rows:
            return empty
        last = np.iinfo(np.int64).max  # a null id comes after all others
        ids = shard["vec_id"].combine_chunks().fill_null(last).to_numpy()
        floor = asked["floor"].combine_chunks().fill_null(-np.inf).to_numpy()
        own = asked["row"].to_numpy()
        best, _ = search(_matrix(shard["vector"], dim), ids, shard["row"].to_numpy(), _matrix(asked["vector"], dim), own, floor, k, most, factor)
        q, place = np.nonzero(best.row >= 0)
        found = best.id[q, place]
        return pa.Table.from_arrays([pa.array(own[q]), asked["vec_id"].combine_chunks().take(pa.array(q)), pa.array(best.row[q, place]), pa.array(found, mask=found == last), pa.array(best.score[q, place])], schema=empty.schema)

    key = ["leaf", "part", "block"]
    return blocks.groupBy(*key).cogroup(shards.groupBy(*key)).applyInArrow(apply, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_modulus: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank (from 1), vec_id, score; nearest first, ties to smaller ids.

    Queries are the rows whose id ``query_modulus`` divides; candidates are all rows but the query's own. Vectors
    that are null, empty, zero or hold null or non-finite components take no part; shorter vectors are filled
    up with zeros. Of rows that share an id each is a query and a candidate of its own; a row without an id is
    no query, and as a candidate comes last among ties. With fewer candidates than ``k`` all are returned; an
    empty table gives an empty result. ``factor`` (0 to 1) relaxes the pruning; 1 is exact. The routing tree is
    built from about ``sample_rows`` vectors, every row is indexed. Other columns are ignored.
    """
    if not 0 < factor <= 1 or k < 1:
        raise ValueError("factor must be above 0 and at most 1, k positive")
    spark = table.sparkSession
    element = table.schema[vector_col].dataType.elementType.simpleString()
    vector = table[vector_col] if element in ("float", "double") else table[vector_col].cast("array<double>")
    kind = f"row long, vec_id long, vector array<{element if element in ('float', 'double') else 'double'}>"
    rows = table.select(F.monotonically_increasing_id().alias("row"), table[id_col].cast("long").alias("vec_id"), vector.alias("vector"))
    clean = shared_table(rows.mapInArrow(_with_norms, f"{kind}, norm double, dim int"), "vectors")
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.max("dim").alias("dim")).first()
    n, most, dim = facts["n"], facts["most"] or 1.0, facts["dim"] or 1

    leaves = max(1, min(-(-n // shard_rows), sample_rows // SAMPLED_PER_LEAF))
    sample = clean.select("vector")
    if n > sample_rows:
        sample = sample.sample(sample_rows / n, seed=7)
    got = sample.toArrow() if leaves > 1 else pa.table({"vector": pa.array([], pa.list_(pa.float64()))})
    router = Tree(on_sphere(_matrix(got["vector"], dim), most), max(1, -(-got.num_rows // leaves)))

    def homes(batches):
        for batch in batches:
            for part in _batched(batch):
                leaf = router.leaf_of(on_sphere(_matrix(part.column("vector"), dim), most))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "vec_id", "vector")), pa.array(leaf)], names=["row", "vec_id", "vector", "leaf"])

    vectors = shared_table(clean.mapInArrow(homes, f"{kind}, leaf long"), "shards")
    sizes = {r["leaf"]: r["n"] for r in vectors.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    asks = (shard_rows, block_rows, k, dim, most, factor)
    queries = shared_table(vectors.where(F.col("vec_id") % query_modulus == 0), "queries")
    at_home = shared_table(_searched(queries.withColumn("floor", F.lit(None).cast("double")), vectors, sizes, *asks), "found")
    first = _ranked(at_home, k)

    def onward(batches):
        for batch in batches:
            for part in _batched(batch):
                x, floor = _matrix(part.column("vector"), dim), part.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                reach = factor * distance_of(floor, np.linalg.norm(x, axis=1), most)
                home = part.column("leaf").to_numpy()
                for leaf, hit in router.leaves_within(as_queries(x), reach):
                    hit = hit[home[hit] != leaf]
                    if len(hit):
                        chosen = part.take(pa.array(hit))
                        yield pa.RecordBatch.from_arrays([*(chosen.column(c) for c in ("row", "vec_id", "vector", "floor")), pa.array([leaf] * len(hit), pa.int64())], names=["row", "vec_id", "vector", "floor", "leaf"])

    if len(sizes) > 1:
        floors = first.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
        bounded = queries.join(floors, "row", "left")
        visits = shared_table(bounded.select("row", "vec_id", "vector", "floor", "leaf").mapInArrow(onward, f"{kind}, floor double, leaf long"), "visits")
        elsewhere = _searched(visits, vectors, sizes, *asks)
        first = _ranked(first.drop("rank").unionByName(elsewhere), k)
    return first.select("query_id", "rank", "vec_id", "score")
