"""Training of tree ensembles on feature vectors, and their export to node tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import safe_corr
from ..operators.features import feature_names
from ..operators.ranks import quantiles
from ..operators.windows import stable_split
from .boosting import Boosted, BoostParams, best_combination, cross_validated, fit_leafwise, score_vectors
from .forest_code import write_forest_source
from .storage import stored_table
from .trees import importance


def grid(values: dict[str, list]) -> list[dict]:
    """Every combination of hyper-parameter values."""
    return [dict(zip(values, combination)) for combination in product(*values.values())]


def _assembled(vectors: DataFrame, ion: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return vectors.where(F.try_element_at("targets", F.lit(ion)).isNotNull()).select("psmid", array_to_vector(F.col("features").cast("array<double>")).alias("x"), F.element_at("targets", ion).cast("double").alias("y"))


def train_ion(vectors: DataFrame, ion: str, name: str, trees: int = 20, depth: int = 4, step: float = 0.1, seed: int = 1):
    """(fitted model, node table) for one ion type: gradient-boosted regression trees."""
    from pyspark.ml.regression import GBTRegressor

    fitted = GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed).fit(_assembled(vectors, ion))
    return fitted, export_nodes(fitted, name, ion)


def export_nodes(fitted, name: str, ion: str) -> pd.DataFrame:
    """Node rows of a fitted ensemble. A split ``x <= t`` on whole numbers becomes ``x < floor(t) + 1``."""
    rows = []
    for tree, (weight, t) in enumerate(zip(fitted.treeWeights, fitted.trees)):
        number = [0]

        def walk(node, k):
            if node.numDescendants() == 0:
                rows.append((name, ion, tree, k, None, None, None, None, float(node.prediction()) * weight, 0.0))
                return
            number[0] += 2
            left, right = number[0] - 1, number[0]
            split = node.split()
            rows.append((name, ion, tree, k, int(split.featureIndex()), float(int(split.threshold() // 1) + 1), left, right, None, 0.0))
            walk(node.leftChild(), left)
            walk(node.rightChild(), right)

        walk(t._call_java("rootNode"), 0)
    return pd.DataFrame(rows, columns=["model", "ion", "tree", "node", "feature", "threshold", "yes", "no", "leaf", "base_score"])


def cross_validate(vectors: DataFrame, ion: str, combinations: list[dict], folds: int = 5, **fixed) -> DataFrame:
    """Mean absolute error of each combination over folds by psmid; one row each."""
    fold = F.pmod(F.xxhash64("psmid", F.lit("fold")), F.lit(folds))
    rows = []
    for params in combinations:
        errors = []
        for k in range(folds):
            fitted, _ = train_ion(vectors.where(fold != k), ion, "cv", **{**fixed, **params})
            held = fitted.transform(_assembled(vectors.where(fold == k), ion))
            errors.append(held.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0])
        scored = [e for e in errors if e is not None]
        rows.append((str(params), float(sum(scored) / len(scored)) if scored else None))
    return vectors.sparkSession.createDataFrame(rows, "params string, error double")


def best_params(results: DataFrame) -> DataFrame:
    """The combination of least error: one row."""
    return results.agg(F.min_by("params", "error").alias("params"), F.min("error").alias("error"))


def psm_percentiles(predictions: DataFrame, by: list[str], points: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 0.9)) -> DataFrame:
    """Percentiles, by group, of the correlation of each psmid; undefined ones are left out."""
    each = predictions.groupBy(*by, "psmid").agg(safe_corr(F.col("target"), F.col("prediction")).alias("r")).where("r is not null")
    return quantiles(each, "r", by, list(points)).select(*by, F.col("quantiles").alias("percentiles"))


#: The combinations that a search goes through, unless others are given.
SEARCHED = {"max_depth": [7, 8, 9], "min_rows": [300, 350, 400], "gamma": [0.0, 1.0]}


@dataclass
class Trained:
    """One ion type's forest with the parameters it was fitted with, its errors, and the sets it was judged on."""

    ion: str
    fitted: Boosted
    params: BoostParams
    sets: dict[str, DataFrame]
    searched: pd.DataFrame | None = None


def train_model(vectors: DataFrame, ions: list[str], name: str, params: BoostParams | None = None, evals: dict[str, DataFrame] | None = None, test_fraction: float = 0.2, search: dict[str, list] | None = None, folds: int = 5) -> list[Trained]:
    """A forest for each ion type: psmids are split, the held-out part decides when to stop.

    With ``search`` the parameters come from the combination of least cross-validated error first. ``evals``
    are further tables to report errors on. An ion type without targets is an error.
    """
    params = params or BoostParams()
    train, test = (stored_table(side, "vectors") for side in stable_split(vectors, "psmid", test_fraction))
    out = []
    for ion in ions:
        if train.where(F.try_element_at("targets", F.lit(ion)).isNotNull()).isEmpty():
            raise ValueError(f"no targets of ion type {ion}")
        own, searched = params, None
        if search:
            searched = cross_validated(train, ion, grid(search), params, folds)
            own = replace(params, **best_combination(searched, list(search)))
        sets = {"test": test, **(evals or {})}
        out.append(Trained(ion, fit_leafwise(train, ion, name, own, sets), own, sets, searched))
    return out


def write_training(trained: list[Trained], path: str, version: str = "general", mode: str = "overwrite") -> None:
    """Folders beside ``path``: source text, feature importance, errors by round, predictions of each set, and the search."""
    spark = next(iter(trained[0].sets.values())).sparkSession
    names = dict(enumerate(feature_names(version)))
    nodes = pd.concat([t.fitted.nodes for t in trained], ignore_index=True)
    write_forest_source(spark, nodes, f"{path}.c")
    labelled = spark.createDataFrame([(k, n) for k, n in names.items()], "feature int, name string")
    table = spark.createDataFrame(nodes).withColumn("feature", F.col("feature").cast("int"))
    counts = importance(table).join(labelled, "feature", "left").select("model", "ion", F.coalesce("name", F.col("feature").cast("string")).alias("name"), "n_tests")
    counts.coalesce(1).orderBy("ion", F.desc("n_tests"), "name").write.mode(mode).csv(f"{path}_importance.csv", header=True)
    history = pd.concat([t.fitted.history.assign(ion=t.ion, best_round=t.fitted.best_round) for t in trained], ignore_index=True)
    spark.createDataFrame(history).coalesce(1).write.mode(mode).csv(f"{path}_history.csv", header=True)
    found = None
    for t in trained:
        for name, rows in t.sets.items():
            own = score_vectors(rows, t.fitted.nodes, t.ion).select(F.lit(t.ion).alias("ion"), F.lit(name).alias("set"), "psmid", "target", "prediction")
            found = own if found is None else found.unionByName(own)
    found.write.mode(mode).csv(f"{path}_predictions.csv", header=True)
    searched = [t.searched.assign(ion=t.ion) for t in trained if t.searched is not None]
    if searched:
        spark.createDataFrame(pd.concat(searched, ignore_index=True)).coalesce(1).write.mode(mode).csv(f"{path}_search.csv", header=True)
