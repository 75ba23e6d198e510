"""Leaf-wise gradient boosting on feature vectors, with evaluation sets and early stopping.

The rows are stored once as one byte a feature (the number of its bin) with their target and margin. A
pass over them adds up, for each node asked for, gradient and count by feature and bin, inside each
task; the tasks' histograms are merged by (node, feature), in two steps where there are many tasks, and
each merged histogram gives its best split where it lies. The driver sees one row a node and feature.

Trees grow best gain first. Which leaf comes next depends on its children's gains, so a pass asks for
the children of several promising leaves at once; the order is then replayed strictly, and what was
asked for in vain is dropped. The tree is the one that single splits would give.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_corr
from ..operators.ranks import quantiles
from ..operators.windows import stable_split
from .storage import stored
from .trees import Forest

#: Distinct values of a feature that a task keeps exactly; beyond, evenly spaced ones that carry their neighbours' rows.
KEPT_VALUES = 4096
#: Leaves whose children one pass counts.
ASKED_LEAVES = 8
#: Trees that are added to the stored margins at a time.
STORED_TREES = 10
#: Histograms of so many tasks are merged in one step.
MERGED_TASKS = 256
TRAIN = 0


@dataclass(frozen=True)
class BoostParams:
    """``min_rows`` of a leaf, ``gamma`` the least gain of a split, ``l2`` the weight penalty; ``patience`` rounds without a better held-out error end the training."""

    trees: int = 30
    step: float = 0.5
    max_depth: int = 9
    max_leaves: int = 100
    min_rows: int = 50
    gamma: float = 0.1
    l2: float = 1.0
    bins: int = 64
    patience: int | None = 10

    def __post_init__(self):
        if not 2 <= self.bins <= 256 or self.max_leaves < 1 or self.trees < 1:
            raise ValueError("bins must be 2 to 256, leaves and trees positive")


@dataclass
class _Node:
    number: int
    depth: int
    weight: float  # of the leaf that it is or would be
    gain: float = -np.inf
    feature: int = -1
    bin: int = -1
    sides: tuple = ()  # (gradient, rows) of its children
    children: tuple[_Node, _Node] | None = field(default=None, repr=False)


@dataclass
class Boosted:
    """A fitted forest: its node table, the error by round and set, and the round that was kept."""

    nodes: pd.DataFrame
    history: pd.DataFrame
    best_round: int


def _kept(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(values) <= KEPT_VALUES:
        return values, weights
    at = np.linspace(0, len(values), KEPT_VALUES, endpoint=False).astype(int)
    return values[at], np.add.reduceat(weights, at)


def bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """For each place of the array column x: at most ``bins`` - 1 ascending edges; all distinct values but the least, if that many do."""

    def counted(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            for k in range(x.shape[1]):
                values, n = np.unique(x[:, k], return_counts=True)
                if k in held:
                    both = np.concatenate([held[k][0], values])
                    weights = np.concatenate([held[k][1], n])
                    values, place = np.unique(both, return_inverse=True)
                    n = np.bincount(place, weights)
                held[k] = _kept(values, n)
        for k, (values, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([values], pa.list_(pa.float64())), pa.array([n], pa.list_(pa.float64()))], names=["k", "v", "n"])

    def edges(table: pa.Table) -> pa.Table:
        values, place = np.unique(np.concatenate([np.array(v) for v in table["v"].to_pylist()]), return_inverse=True)
        upto = np.cumsum(np.bincount(place, np.concatenate([np.array(n) for n in table["n"].to_pylist()])))
        if len(values) <= bins:
            out = values[1:]
        else:
            out = np.unique(values[np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins, side="right").clip(1, len(values) - 1)])
        return pa.table({"k": table["k"].slice(0, 1), "edges": pa.array([out], pa.list_(pa.float64()))})

    found = rows.select("x").mapInArrow(counted, "k int, v array<double>, n array<double>").groupBy("k").applyInArrow(edges, "k int, edges array<double>")
    return [np.array(r["edges"], float) for r in sorted(found.collect(), key=lambda r: r["k"])]  # one short row a feature


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """Values of ``width`` bytes each, as a matrix."""
    start, end = (np.frombuffer(column.buffers()[1], np.int32)[k] for k in (column.offset, column.offset + len(column)))
    return np.frombuffer(column.buffers()[2], np.uint8)[start:end].reshape(len(column), width)


def _walked(bins: np.ndarray, tree: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The node that each row ends in; a node is (feature, bin, yes, no), feature -1 where it ends."""
    feature, limit, yes, no = (np.array(c, np.int64) for c in zip(*tree, strict=True))
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows := rows[feature[at[rows]] >= 0]):
        own = at[rows]
        at[rows] = np.where(bins[rows, feature[own]] <= limit[own], yes[own], no[own])
    return at


def _binned(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Each row's features as bytes: how many edges are at or below the value."""

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            out = np.empty(x.shape, np.uint8)
            for k, own in enumerate(edges):
                out[:, k] = np.searchsorted(own, x[:, k], side="right")
            kept = [batch.column(c) for c in ("part", "y")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in out], pa.binary())], names=["part", "y", "bins"])

    return rows.select("part", "y", "x").mapInArrow(apply, "part int, y double, bins binary")


def _margins(batch: pa.RecordBatch, width: int, trees: list) -> tuple[np.ndarray, np.ndarray]:
    bins = _bytes(batch.column("bins"), width)
    margin = batch.column("margin").to_numpy().copy()
    for tree, weights in trees:
        margin += weights[_walked(bins, tree)]
    return bins, margin


def _with_trees(table: DataFrame, width: int, trees: list) -> DataFrame:
    """The table with ``trees`` added to its margins."""

    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                _, margin = _margins(batch, width, trees)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "y", "bins")), pa.array(margin)], names=["part", "y", "bins", "margin"])

    return stored(table.mapInArrow(apply, "part int, y double, bins binary, margin double"))


def _merge(keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    def apply(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(v) for v in table["v"].to_pylist()], axis=0)
        return pa.table({**{k: table[k].slice(0, 1) for k in keys}, "v": pa.array([total], pa.list_(pa.float64()))})

    return apply


def _pass(table: DataFrame, width: int, bins: int, trees: list, tree: list, asked: dict[int, int], params: BoostParams, errors: bool) -> list:
    """Rows (node, feature, gain, bin, g, h, below_g, below_h), and with ``errors`` (-1 - part, -1, ..., n, absolute, squared).

    ``asked`` gives the nodes' slots. ``below`` is the side of the bins up to ``bin``.
    """
    slot_of = np.full(len(tree), -1, np.int64)
    for node, slot in asked.items():
        slot_of[node] = slot
    node_of = {slot: node for node, slot in asked.items()}

    def count(batches):
        sums = np.zeros((len(asked), width, 2, bins))
        wrong: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, margin = _margins(batch, width, trees)
            part, y = batch.column("part").to_numpy(), batch.column("y").to_numpy()
            if errors:
                for p in np.unique(part):
                    e = margin[part == p] - y[part == p]
                    wrong[int(p)] = wrong.get(int(p), np.zeros(3)) + np.array([len(e), np.abs(e).sum(), (e * e).sum()])
            train = np.flatnonzero(part == TRAIN)
            slot = slot_of[_walked(x[train], tree)]
            rows, slot = train[slot >= 0], slot[slot >= 0]
            gradient = margin[rows] - y[rows]
            for k in range(width):
                place = slot * bins + x[rows, k]
                sums[:, k, 0] += np.bincount(place, gradient, len(asked) * bins).reshape(-1, bins)
                sums[:, k, 1] += np.bincount(place, minlength=len(asked) * bins).reshape(-1, bins)
        for slot in range(len(asked)):
            if sums[slot, 0, 1].any():
                yield pa.RecordBatch.from_arrays([pa.array([node_of[slot]] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(list(sums[slot].reshape(width, -1)), pa.list_(pa.float64()))], names=["node", "feature", "v"])
        for p, v in wrong.items():
            yield pa.RecordBatch.from_arrays([pa.array([-1 - p], pa.int32()), pa.array([-1], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["node", "feature", "v"])

    least, gamma, l2 = params.min_rows, params.gamma, params.l2

    def best(table: pa.Table) -> pa.Table:
        total = np.sum([np.array(v) for v in table["v"].to_pylist()], axis=0)
        if table["node"][0].as_py() < 0:
            found = (0.0, -1, *total, 0.0)
        else:
            g, h = np.cumsum(total.reshape(2, -1), axis=1)
            score = lambda a, b: a * a / (b + l2)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = 0.5 * (score(g, h) + score(g[-1] - g, h[-1] - h) - score(g[-1], h[-1])) - gamma
            gain[(h < max(1, least)) | (h[-1] - h < max(1, least))] = -np.inf
            at = int(gain.argmax())
            found = (float(gain[at]), at, g[-1], h[-1], g[at], h[at])
        kinds = [pa.float64(), pa.int32(), *[pa.float64()] * 4]
        return pa.table({"node": table["node"].slice(0, 1), "feature": table["feature"].slice(0, 1), **{n: pa.array([v], k) for n, v, k in zip(("gain", "bin", "g", "h", "below_g", "below_h"), found, kinds, strict=True)}})

    counted = table.mapInArrow(count, "node int, feature int, v array<double>")
    if (tasks := table.rdd.getNumPartitions()) > MERGED_TASKS:
        deal = F.pmod(F.spark_partition_id(), F.lit(-(-tasks // MERGED_TASKS)))
        keys = ["node", "feature", "deal"]
        counted = counted.withColumn("deal", deal).groupBy(*keys).applyInArrow(_merge(keys), "node int, feature int, deal int, v array<double>")
    return counted.groupBy("node", "feature").applyInArrow(best, "node int, feature int, gain double, bin int, g double, h double, below_g double, below_h double").collect()


def _replayed(root: _Node, max_leaves: int) -> tuple[list[_Node], list[_Node]]:
    """(nodes that are split in order, leaves whose children are wanted): best gain first, as far as the children are known."""
    heap, split = [(-root.gain, root.number, root)], []
    while heap and len(split) + 1 < max_leaves and -heap[0][0] > 0:
        if heap[0][2].children is None:
            room = max_leaves - len(split) - 1
            return split, [n for _, _, n in heapq.nsmallest(min(room, ASKED_LEAVES), heap) if n.gain > 0 and n.children is None]
        node = heapq.heappop(heap)[2]
        split.append(node)
        for child in node.children:
            heapq.heappush(heap, (-child.gain, child.number, child))
    return split, []


def _grown(ask: Callable[[list, dict, bool], list], params: BoostParams) -> tuple[list[_Node], _Node, list]:
    """(split nodes, root, error rows) of one tree. ``ask`` runs a pass for the nodes of a partial tree."""

    def learn(rows, nodes: dict[int, _Node]) -> None:
        for number, node in nodes.items():
            own = [r for r in rows if r["node"] == number]
            if own and node.depth < params.max_depth:
                r = min(own, key=lambda r: (-r["gain"], r["feature"]))
                node.gain, node.feature, node.bin = r["gain"], r["feature"], r["bin"]
                node.sides = ((r["below_g"], r["below_h"]), (r["g"] - r["below_g"], r["h"] - r["below_h"]))

    weight = lambda g, h: -params.step * g / (h + params.l2)
    root = _Node(0, 0, 0.0)
    flat = [(-1, 0, 0, 0)]
    rows = ask(flat, {0: 0}, True)
    errors = [r for r in rows if r["node"] < 0]
    if any(r["node"] == 0 for r in rows):
        first = next(r for r in rows if r["node"] == 0)
        root.weight = weight(first["g"], first["h"])
    learn(rows, {0: root})
    while True:
        split, wanted = _replayed(root, params.max_leaves)
        if not wanted:
            return split, root, errors
        fresh: dict[int, _Node] = {}
        for node in wanted:
            node.children = tuple(_Node(len(flat) + k, node.depth + 1, weight(*node.sides[k])) for k in (0, 1))
            flat[node.number] = (node.feature, node.bin, node.children[0].number, node.children[1].number)
            flat += [(-1, 0, 0, 0)] * 2
            fresh |= {c.number: c for c in node.children}
        open_nodes = {n: c for n, c in fresh.items() if c.depth < params.max_depth}
        if open_nodes:
            learn(ask(flat, {n: k for k, n in enumerate(open_nodes)}, False), open_nodes)


def _flattened(split: list[_Node], root: _Node) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """(nodes as _walked takes them, their weights), numbered in the order of splitting."""
    number, order = {root.number: 0}, [root]
    for node in split:
        for child in node.children:
            number[child.number] = len(order)
            order.append(child)
    inner = {n.number for n in split}
    flat = [(n.feature, n.bin, *(number[c.number] for c in n.children)) if n.number in inner else (-1, 0, 0, 0) for n in order]
    return flat, np.array([n.weight for n in order])


def _as_rows(vectors: DataFrame, ion: str, part: int) -> DataFrame:
    y = F.try_element_at("targets", F.lit(ion)).cast("double")
    return vectors.select(F.lit(part).alias("part"), y.alias("y"), F.col("features").cast("array<double>").alias("x")).where(F.col("y").isNotNull())


def fit_leafwise(vectors: DataFrame, ion: str, name: str, params: BoostParams | None = None, evals: dict[str, DataFrame] | None = None) -> Boosted:
    """A forest for one ion type from rows with ``features`` and ``targets``, fitted to squared error.

    ``evals`` are held-out tables; the mean absolute error of the first one decides when to stop and which
    round is kept (without any, the last). Rows without a target of the ion are left out; without rows the
    forest is one leaf of 0. A test is ``value < edge``.
    """
    params = params or BoostParams()
    rows = _as_rows(vectors, ion, TRAIN)
    for k, held in enumerate((evals or {}).values(), 1):
        rows = rows.unionByName(_as_rows(held, ion, k))
    rows = stored(rows)
    train = rows.where(F.col("part") == TRAIN)
    base = float(train.agg(F.avg("y")).first()[0] or 0.0)
    edges = bin_edges(train, params.bins)
    width = len(edges)
    columns = ["model", "ion", "tree", "node", "feature", "threshold", "yes", "no", "leaf", "base_score"]
    if not width:
        return Boosted(pd.DataFrame([(name, ion, 0, 0, None, None, None, None, 0.0, base)], columns=columns), pd.DataFrame(columns=["round", "set", "mae", "rmse"]), 1)
    table = stored(_binned(rows, edges).withColumn("margin", F.lit(base)))
    names = ["train", *(evals or {})]
    trees: list = []
    pending: list = []  # trees that the stored margins lack
    history: list[tuple] = []

    def told(errors, number: int) -> None:
        for r in sorted(errors, key=lambda r: -r["node"]):
            n, absolute, squared = r["g"], r["h"], r["below_g"]
            history.append((number, names[-1 - r["node"]], absolute / n, (squared / n) ** 0.5))

    def stops() -> bool:
        own = [(mae, number) for number, name_, mae, _ in history if len(names) > 1 and name_ == names[1] and number]
        return bool(params.patience and own and own[-1][1] - min(own)[1] >= params.patience)

    def ask(tree, asked, errors):
        return _pass(table, width, params.bins, pending, tree, asked, params, errors)

    while len(trees) < params.trees:
        split, root, errors = _grown(ask, params)
        told(errors, len(trees))  # of the forest before this tree
        if stops():
            break
        trees.append(_flattened(split, root))
        pending = [*pending, trees[-1]]
        if len(pending) >= STORED_TREES:
            table, pending = _with_trees(table, width, pending), []
    else:
        told([r for r in ask([(-1, 0, 0, 0)], {0: 0}, True) if r["node"] < 0], len(trees))
    scored = [(mae, number) for number, name_, mae, _ in history if len(names) > 1 and name_ == names[1] and number]
    best = min(scored)[1] if scored else len(trees)
    out = []
    for t, (flat, weights) in enumerate(trees[:best]):
        for k, (feature, at, yes, no) in enumerate(flat):
            test = feature >= 0
            out.append((name, ion, t, k, feature if test else None, float(edges[feature][at]) if test else None, yes if test else None, no if test else None, None if test else float(weights[k]), base))
    return Boosted(pd.DataFrame(out, columns=columns), pd.DataFrame(history, columns=["round", "set", "mae", "rmse"]), best)


def score_vectors(vectors: DataFrame, nodes: pd.DataFrame, ion: str) -> DataFrame:
    """(psmid, charge, target, prediction) of the rows that have a target of the ion."""
    forest = Forest.from_nodes(nodes[nodes["ion"] == ion])

    def apply(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("psmid", "charge", "target")), pa.array(forest.score(_matrix(batch.column("x"))))], names=["psmid", "charge", "target", "prediction"])

    kinds = dict(vectors.dtypes)
    target = F.try_element_at("targets", F.lit(ion)).cast("double")
    rows = vectors.select("psmid", "charge", target.alias("target"), F.col("features").cast("array<double>").alias("x")).where(F.col("target").isNotNull())
    return rows.mapInArrow(apply, f"psmid {kinds['psmid']}, charge {kinds['charge']}, target double, prediction double")


def leaf_grid(vectors: DataFrame, ion: str, depths: list[int], leaves: list[int], params: BoostParams | None = None, evals: dict[str, DataFrame] | None = None, test_fraction: float = 0.3, points: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """(max_depth, max_leaves, set, charge, percentiles, mae, best_round): depth x leaves, judged by charge on each set.

    The first set, ``test``, holds ``test_fraction`` of the psmids; percentiles are of the correlations of single
    psmids, undefined ones left out.
    """
    train, test = stable_split(vectors, "psmid", test_fraction)
    sets = {"test": stored(test), **(evals or {})}
    train = stored(train)
    found = None
    for depth in depths:
        for n in leaves:
            fitted = fit_leafwise(train, ion, "grid", replace(params or BoostParams(), max_depth=depth, max_leaves=n), sets)
            for name, held in sets.items():
                scored = score_vectors(held, fitted.nodes, ion)
                each = scored.groupBy("charge", "psmid").agg(safe_corr(F.col("target"), F.col("prediction")).alias("r")).where("r is not null")
                mae = scored.groupBy("charge").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"))
                judged = quantiles(each, "r", ["charge"], list(points)).select("charge", F.col("quantiles").alias("percentiles"))
                own = mae.join(judged, "charge", "left").select(F.lit(depth).alias("max_depth"), F.lit(n).alias("max_leaves"), F.lit(name).alias("set"), "charge", "percentiles", "mae", F.lit(fitted.best_round).alias("best_round"))
                found = own if found is None else found.unionByName(own)
    return found


def cross_validated(vectors: DataFrame, ion: str, combinations: list[dict], params: BoostParams | None = None, folds: int = 5, patience: int | None = 10) -> pd.DataFrame:
    """A row for each combination and round: mean and deviation, over the folds, of both sides' rmse.

    Folds are by psmid. With ``patience`` a combination's rows end at its best round, once so many rounds
    after it were no better; a fold's forest of a round does not depend on later ones.
    """
    fold = F.pmod(F.xxhash64("psmid", F.lit("fold")), F.lit(folds))
    vectors = stored(vectors)
    out = []
    for own in combinations:
        runs = []
        for k in range(folds):
            fitted = fit_leafwise(vectors.where(fold != k), ion, "cv", replace(params or BoostParams(), **own, patience=None), {"test": vectors.where(fold == k)})
            runs.append(fitted.history.pivot(index="round", columns="set", values="rmse"))
        both = pd.concat(runs, keys=range(len(runs)))
        by_round = both.groupby(level=1)
        rows = pd.DataFrame({"round": sorted(set(both.index.get_level_values(1)))})
        for side in ("test", "train"):
            rows[f"{side}_mean"], rows[f"{side}_std"] = by_round[side].mean().to_numpy(), by_round[side].std(ddof=0).to_numpy()
        rows = rows[rows["round"] > 0].reset_index(drop=True)
        if patience and len(rows):
            best, last = 0, len(rows) - 1
            for k in range(len(rows)):
                if rows["test_mean"][k] < rows["test_mean"][best]:
                    best = k
                if k - best >= patience:
                    last = best
                    break
            rows = rows.loc[:last]
        out.append(rows.assign(**own))
    return pd.concat(out, ignore_index=True)


def best_combination(results: pd.DataFrame, names: list[str]) -> dict:
    """The values of ``names`` in the row of least held-out error."""
    row = results.loc[results["test_mean"].idxmin()]
    return {n: row[n].item() if hasattr(row[n], "item") else row[n] for n in names}
