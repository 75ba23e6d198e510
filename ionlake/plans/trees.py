"""Tree ensembles as tables, scored in the JVM or in Arrow batches."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import rounded
from ..functions.residues import PSEUDO
from ..operators.features import merged, peptide_features

#: A node with a leaf value has no test. A further column ``missing`` may name the branch of a null or NaN; without it, or where it is null, that is ``no``.
NODE_SCHEMA = "model string, ion string, tree int, node int, feature int, threshold double, yes int, no int, leaf double, base_score double"
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
#: Nodes up to which a forest is written out as one expression.
EXPRESSION_NODES = 400


@dataclass(frozen=True)
class Forest:
    """One ion type's trees in flat arrays: at a node, feature < threshold goes to ``yes``, NaN to ``missing``, else ``no``."""

    feature: np.ndarray
    threshold: np.ndarray
    yes: np.ndarray
    no: np.ndarray
    missing: np.ndarray
    leaf: np.ndarray
    roots: np.ndarray
    base_score: float

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame) -> Forest:
        own = nodes.sort_values(["tree", "node"], ignore_index=True)
        place = {(t, n): k for k, (t, n) in enumerate(zip(own["tree"], own["node"]))}
        go = lambda c: np.array([place[t, int(n)] if pd.isna(leaf) else -1 for t, n, leaf in zip(own["tree"], own[c], own["leaf"])], np.int64)
        tests = own["leaf"].isna().to_numpy()
        own["missing"] = own["missing"].where(own["missing"].notna(), own["no"]) if "missing" in own else own["no"]
        return cls(
            np.where(tests, np.nan_to_num(own["feature"].to_numpy(float)), -1).astype(np.int64),
            np.nan_to_num(own["threshold"].to_numpy(float)),
            go("yes"),
            go("no"),
            go("missing"),
            np.nan_to_num(own["leaf"].to_numpy(float)),
            np.array([place[t, 0] for t in sorted(set(own["tree"]))], np.int64),
            float(own["base_score"].iloc[0]) if len(own) else 0.0,
        )

    def score(self, x: np.ndarray) -> np.ndarray:
        """Base score plus the leaves that each row of ``x`` reaches; all rows walk a tree in step."""
        x = x if x.dtype.kind == "f" else x.astype(np.float64)
        total = np.full(len(x), self.base_score)
        rows = np.arange(len(x))
        for root in self.roots:
            if self.feature[root] < 0:
                total += self.leaf[root]
                continue
            value = x[:, self.feature[root]]  # all rows are at the root
            at = np.where(value < self.threshold[root], self.yes[root], np.where(np.isnan(value), self.missing[root], self.no[root]))
            while True:
                test = self.feature[at] >= 0
                if not test.any():
                    break
                k = rows[test]
                value, node = x[k, self.feature[at[k]]], at[k]
                at[k] = np.where(value < self.threshold[node], self.yes[node], np.where(np.isnan(value), self.missing[node], self.no[node]))
            total += self.leaf[at]
        return total


def _node_rows(trees, ion: str, model: str, base_score: float) -> pd.DataFrame:
    rows = [(model, ion, tree, *node[:-1], base_score, node[-1]) for tree, nodes in enumerate(trees) for node in nodes]
    return pd.DataFrame(rows, columns=[*NODE_COLUMNS, "missing"])


def read_boosted_json(spark: SparkSession, path: str, ion: str, model: str) -> pd.DataFrame:
    """The node table of a boosted model saved as JSON: a regression forest for one ion type.

    The file is as large as the model and is read on the driver, as the forest travels with the scorer.
    """
    return boosted_json_nodes(spark.read.text(path, wholetext=True).first()[0], ion, model)


def boosted_json_nodes(text: str, ion: str, model: str) -> pd.DataFrame:
    """The node table of a boosted model's JSON; ``default_left`` says where a missing value goes."""
    learner = json.loads(text)["learner"]
    trees = []
    for t in learner["gradient_booster"]["model"]["trees"]:
        default = t.get("default_left") or [0] * len(t["left_children"])
        own = zip(t["left_children"], t["right_children"], t["split_indices"], t["split_conditions"], default, strict=True)
        trees.append(
            [(k, None, None, None, None, float(c), None) if yes < 0 else (k, int(f), float(c), int(yes), int(no), None, int(yes if left else no)) for k, (yes, no, f, c, left) in enumerate(own)]
        )
    score = learner["learner_model_param"]["base_score"]
    return _node_rows(trees, ion, model, float(score.strip("[]") if isinstance(score, str) else score))


def boosted_json(nodes: pd.DataFrame) -> str:
    """One ion type's forest as the JSON of a boosted model, which boosted_json_nodes reads back."""
    trees = []
    for _, tree in nodes.groupby("tree"):
        own = tree.sort_values("node")
        number = {int(k): place for place, k in enumerate(own["node"])}  # children are named by place
        leaf = own["leaf"].notna().tolist()
        missing = own["missing"] if "missing" in own else own["no"]
        trees.append({
            "left_children": [-1 if b else number[int(y)] for b, y in zip(leaf, own["yes"])],
            "right_children": [-1 if b else number[int(n)] for b, n in zip(leaf, own["no"])],
            "split_indices": [0 if b else int(f) for b, f in zip(leaf, own["feature"])],
            "split_conditions": [float(x) if b else float(t) for b, x, t in zip(leaf, own["leaf"], own["threshold"])],
            "default_left": [0 if b or pd.isna(m) else int(int(m) == int(y)) for b, m, y in zip(leaf, missing, own["yes"])],
        })
    return json.dumps({"learner": {"learner_model_param": {"base_score": repr(float(nodes["base_score"].iloc[0]))}, "gradient_booster": {"model": {"trees": trees}}}})


#: Lines of a text dump: a test, or a leaf.
DUMP_TEST = re.compile(r"\s*(\d+):\[f?(\d+)<([^\]]+)\] yes=(\d+),no=(\d+)(?:,missing=(\d+))?")
DUMP_LEAF = re.compile(r"\s*(\d+):leaf=([^,\s]+)")


def read_boosted_dump(spark: SparkSession, path: str, ion: str, model: str, base_score: float = 0.5) -> pd.DataFrame:
    """The node table of a boosted model's text dump, which does not hold its base score."""
    return boosted_dump_nodes(spark.read.text(path, wholetext=True).first()[0], ion, model, base_score)


def boosted_dump_nodes(text: str, ion: str, model: str, base_score: float = 0.5) -> pd.DataFrame:
    trees: list[list[tuple]] = []
    for line in text.splitlines():
        if line.startswith("booster["):
            trees.append([])
        elif m := DUMP_TEST.match(line):
            trees[-1].append((int(m[1]), int(m[2]), float(m[3]), int(m[4]), int(m[5]), None, int(m[6] or m[5])))
        elif m := DUMP_LEAF.match(line):
            trees[-1].append((int(m[1]), None, None, None, None, float(m[2]), None))
    return _node_rows(trees, ion, model, base_score)


def forest_expression(nodes: pd.DataFrame, features: Column) -> Column:
    """A forest as nested CASE expressions over an array column; for small forests."""
    if len(nodes) > EXPRESSION_NODES:
        raise ValueError(f"{len(nodes)} nodes are too many for one expression; score in batches")
    total = F.lit(float(nodes["base_score"].iloc[0]))
    for _, tree in nodes.groupby("tree"):
        by_node = {int(r.node): r for r in tree.itertuples()}

        def build(k):
            r = by_node[k]
            if not pd.isna(r.leaf):
                return F.lit(float(r.leaf))
            value = F.get(features, F.lit(int(r.feature)))
            test = value < float(r.threshold)
            if not pd.isna(missing := getattr(r, "missing", None)) and int(missing) == int(r.yes):
                test = F.coalesce(test, F.lit(True)) | F.isnan(value)
            return F.when(test, build(int(r.yes))).otherwise(build(int(r.no)))

        total = total + build(0)
    return total


def score_sites(sites: DataFrame, nodes: pd.DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., site, prediction map of ion type to value) for site_features rows.

    Batches leave the JVM as Arrow; the forests, the size of the model, travel with the function.
    """
    forests = {ion: Forest.from_nodes(own) for ion, own in nodes.groupby("ion")}
    ions = sorted(forests)

    def score(batches):
        for batch in batches:
            features = batch.column("features")
            width = len(features[0]) if batch.num_rows else 0
            x = features.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            own = [batch.column(k) for k in (*keep, "site")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(forests[i].score(x), pa.float64()) for i in ions)], names=[*keep, "site", *(f"p_{i}" for i in ions)])

    kinds = dict(sites.dtypes)
    kind = ", ".join(f"{k} {kinds[k]}" for k in (*keep, "site")) + "".join(f", p_{i} double" for i in ions)
    return sites.select(*keep, "site", "features").mapInArrow(score, kind)


def _forests(nodes: pd.DataFrame) -> tuple[list[int], dict[str, Forest]]:
    """(the features that are read, the forest of each ion type over those alone)."""
    read = sorted({int(k) for k in nodes["feature"].dropna()})
    place = {k: i for i, k in enumerate(read)}
    own = nodes.assign(feature=[None if pd.isna(k) else place[int(k)] for k in nodes["feature"]])
    return read, {ion: Forest.from_nodes(part) for ion, part in own.groupby("ion")}


def _scores(batch: pa.RecordBatch, version: str, read: list[int], forests: dict[str, Forest]):
    """(rows, [peptide, ion number - 1] of each ion type) for the peptides of each length."""
    for rows, x in peptide_features(batch, version, read):
        found = {i: forest.score(x.reshape(-1, len(read))).reshape(-1, x.shape[1]) for i, forest in sorted(forests.items())}
        yield rows, {i: got if i[0] in "ABC" else got[:, ::-1] for i, got in found.items()}


def score_totals(peptides: DataFrame, nodes: pd.DataFrame, keep: tuple[str, ...], version: str = "general") -> DataFrame:
    """(keep..., ion, n_ions, top_ion, sum_log2, intensity): one row for each peptide and ion type.

    Values are added up where they are made, in log2 space (6 places) and as intensities (8 places); a value is no
    row. ``top_ion`` has the highest value, each ion number counting a thousandth less. A peptide without sites has no row.
    """
    read, forests = _forests(nodes)
    ions, names = sorted(forests), ("top", "sum", "intensity")
    more = [c for c in ("peptide", "charge", *(["ce"] if version == "ce" else [])) if c not in keep]

    def score(batches):
        for batch in merged(batches):
            n = np.zeros(batch.num_rows, np.int64)
            out = {(i, c): np.zeros(batch.num_rows, np.int64 if c == "top" else np.float64) for i in ions for c in names}
            for rows, found in _scores(batch, version, read, forests):
                for i, p in found.items():
                    n[rows] = p.shape[1]
                    out[i, "top"][rows] = np.argmax(p * 1000 - np.arange(1, p.shape[1] + 1), axis=1) + 1
                    out[i, "sum"][rows] = rounded(p.sum(axis=1), 6)
                    out[i, "intensity"][rows] = rounded(np.maximum(np.power(2.0, p) - PSEUDO, 0).sum(axis=1), 8)
            some = np.flatnonzero(n)
            kept = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in keep), pa.array(n[some]), *(pa.array(x[some]) for x in out.values())], names=[*keep, "n_ions", *columns.values()])

    columns = {(i, c): f"_{c}{k}" for k, i in enumerate(ions) for c in names}
    kinds = dict(peptides.dtypes)
    kind = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", n_ions long" + "".join(f", {c} {'long' if k[1] == 'top' else 'double'}" for k, c in columns.items())
    rows = peptides.select(*keep, *more).mapInArrow(score, kind)
    each = [F.struct(F.lit(i).alias("ion"), *[F.col(columns[i, c]).alias(n) for c, n in zip(names, ("top_ion", "sum_log2", "intensity"), strict=True)]) for i in ions]
    return rows.select(*keep, "n_ions", F.explode(F.array(*each)).alias("_i")).select(*keep, "_i.ion", "n_ions", "_i.top_ion", "_i.sum_log2", "_i.intensity")


def score_peptides(peptides: DataFrame, nodes: pd.DataFrame, keep: tuple[str, ...], version: str = "general") -> DataFrame:
    """(keep..., an array p_<ion> for each ion type): one row per peptide, values in ion order.

    A peptide goes to Python as one row and comes back as one: its sites' features, those that the
    model reads, are made, scored and folded in the same Arrow pass. Prefix ions count from the first
    site, suffix ions from the last. A peptide without sites has empty arrays.
    """
    read, forests = _forests(nodes)
    ions = sorted(forests)
    more = [c for c in ("peptide", "charge", *(["ce"] if version == "ce" else [])) if c not in keep]

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.fill_null(pc.binary_length(batch.column("peptide")), 0).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(np.maximum(lengths - 1, 0))])
            values = {i: np.empty(starts[-1]) for i in ions}
            for rows, found in _scores(batch, version, read, forests):
                for i, got in found.items():
                    values[i][starts[rows][:, None] + np.arange(got.shape[1])] = got
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values[i])) for i in ions]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *lists], names=[*keep, *(f"p_{i}" for i in ions)])

    kinds = dict(peptides.dtypes)
    kind = ", ".join(f"{k} {kinds[k]}" for k in keep) + "".join(f", p_{i} array<double>" for i in ions)
    return peptides.select(*keep, *more).mapInArrow(score, kind)


def importance(nodes: DataFrame) -> DataFrame:
    """How many tests use each feature."""
    return nodes.where("leaf is null or isnan(leaf)").groupBy("model", "ion", "feature").agg(F.count(F.lit(1)).alias("n_tests"))


def toy_nodes(ions: tuple[str, ...] = ("B", "Y"), model: str = "toy") -> pd.DataFrame:
    """A small fixed forest in log2 space, so that every plan runs without trained weights."""
    rows = []
    for k, ion in enumerate(ions):
        for tree, (feature, threshold, low, high) in enumerate(((27, 3.0, -2.5, -0.5), (28, 4.0, -1.5, 0.25), (1, 3.0, 0.3, -0.6), (71, 110.0, -0.2, 0.7))):
            rows.append((model, ion, tree, 0, feature + 0, threshold + k, 1, 2, None, -5.0 + k))
            rows.append((model, ion, tree, 1, None, None, None, None, low, -5.0 + k))
            rows.append((model, ion, tree, 2, None, None, None, None, high, -5.0 + k))
    return pd.DataFrame(rows, columns=NODE_COLUMNS)
