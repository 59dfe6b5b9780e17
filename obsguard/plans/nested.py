"""Grid cells that are parts of one fit: a tree cut at every depth and gain, a boosted chain scored at every length.

MLlib grows a tree node by node: the best split of a node depends on its rows alone, and `maxDepth` and `minInfoGain`
only say where growth stops. The tree of the deepest, least demanding cell therefore holds every other cell's tree: it
ends at the first node on a row's path that is deep enough or gains too little. A boosted chain adds trees one by one, so a
shorter chain is its front. One fit and one pass over the validation rows then score all cells of a group.

(Random forests are not nested: their trees draw features and rows in an order that depends on depth and number.)

`node_table` gives any fitted tree model as a table, one row a node; `Walker` follows it for whole batches of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..session import discard, ensure_checkpoint_dir

REGRESSION_METRICS = ("rmse", "mse", "mae", "r2")
CUT_AXES = ("maxDepth", "minInfoGain")
LENGTH_AXIS = "maxIter"
_NODE = ["id", "prediction", "gain", "leftChild", "rightChild", "split", "impurityStats"]


def node_table(spark: SparkSession, model) -> tuple[DataFrame, str]:
    """(tree, weight, id, prediction, gain, left, right, feature, threshold, left_categories, categories, stats) of a
    fitted tree model, one row a node; a leaf has left = -1. Read from the model as MLWriter stores it, in the folder
    that is also returned."""
    path = f"{ensure_checkpoint_dir(spark)}/nodes-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.load(f"{path}/data")
    if "nodeData" in data.columns:
        weights = spark.read.load(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
        nodes = data.select(F.col("treeID").alias("tree"), *[F.col(f"nodeData.{c}").alias(c) for c in _NODE]).join(F.broadcast(weights), "tree")
    else:
        nodes = data.select(F.lit(0).alias("tree"), F.lit(1.0).alias("weight"), *_NODE)
    cats = F.col("split.numCategories")
    value = F.col("split.leftCategoriesOrThreshold")
    table = nodes.select("tree", "weight", "id", "prediction", "gain", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                        F.col("split.featureIndex").alias("feature"), F.when((cats < 0) & (F.size(value) > 0), F.get(value, F.lit(0))).alias("threshold"),
                        F.when(cats >= 0, value).alias("left_categories"), cats.alias("categories"), F.col("impurityStats").alias("stats"))
    return table, path


@dataclass
class Walker:
    """The nodes of one tree as arrays; a tree has at most 2 ** (depth + 1) nodes."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    goes_left: np.ndarray          # node x category
    categorical: np.ndarray
    prediction: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Walker:
        rows = sorted(rows, key=lambda r: r["id"])
        ids = {r["id"]: i for i, r in enumerate(rows)}
        width = max([int(r["categories"]) for r in rows] + [1])
        goes_left = np.zeros((len(rows), width), bool)
        for i, r in enumerate(rows):
            for c in r["left_categories"] or ():
                goes_left[i, int(c)] = True
        at = {**ids, -1: -1}
        return cls(*(np.array(x) for x in ([at[r["left"]] for r in rows], [at[r["right"]] for r in rows], [max(r["feature"], 0) for r in rows],
                                           [np.nan if r["threshold"] is None else r["threshold"] for r in rows])), goes_left,
                   np.array([r["categories"] >= 0 for r in rows]), np.array([r["prediction"] for r in rows]), np.array([r["gain"] for r in rows]))

    def step(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The next node of every row; a row at a leaf stays."""
        value = x[np.arange(len(x)), self.feature[at]]
        number = np.clip(np.nan_to_num(value), 0, self.goes_left.shape[1] - 1).astype(np.int64)
        to_left = np.where(self.categorical[at], self.goes_left[at, number], value <= self.threshold[at])
        return np.where(self.left[at] < 0, at, np.where(to_left, self.left[at], self.right[at]))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (self.left[at] >= 0).any():
            at = self.step(x, at)
        return at

    def cut_predictions(self, x: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
        """rows x cuts: what the tree says when it ends at this depth, and at nodes that gain less."""
        at = np.zeros(len(x), np.int64)
        out = np.empty((len(x), len(cuts)))
        open_ = np.ones((len(x), len(cuts)), bool)
        depth = 0
        while open_.any():
            ends = self.left[at] < 0
            for c, (most, least) in enumerate(cuts):
                stop = open_[:, c] & (ends | (self.gain[at] < least) | (depth >= most))
                out[stop, c] = self.prediction[at[stop]]
                open_[stop, c] = False
            at, depth = self.step(x, at), depth + 1
        return out


def walkers(spark: SparkSession, model) -> tuple[list[Walker], list[float]]:
    """The trees of a model in order, and their weights. A model is bounded by its cell: trees x 2 ** (depth + 1) nodes."""
    by: dict = {}
    nodes, path = node_table(spark, model)
    for r in nodes.collect():
        by.setdefault(r["tree"], []).append(r)
    discard(spark, path)
    return [Walker.of(by[t]) for t in sorted(by)], [by[t][0]["weight"] for t in sorted(by)]


def _scored(valid: DataFrame, features_col: str, predict) -> DataFrame:
    """(label, cell, prediction): `predict` turns a feature matrix into rows x cells."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"label": f["label"], "p": list(predict(np.vstack(f["x"].to_numpy())))})

    rows = valid.select(F.col(C.LABEL_COL).cast("double").alias("label"), vector_to_array(F.col(features_col)).alias("x"))
    out = rows.mapInPandas(run, "label double, p array<double>")
    return out.select("label", F.posexplode("p").alias("cell", "prediction"))


def _counted(valid: DataFrame, features_col: str, predict) -> DataFrame:
    """(label, cell, prediction, n): as `_scored`, but equal answers leave their batch as one row with their number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                p = predict(np.vstack(f["x"].to_numpy()))
                for c in range(p.shape[1]):
                    n = pd.DataFrame({"label": f["label"], "prediction": p[:, c]}).groupby(["label", "prediction"], dropna=False).size()
                    yield n.reset_index(name="n").assign(cell=c)[["label", "cell", "prediction", "n"]]

    rows = valid.select(F.col(C.LABEL_COL).cast("double").alias("label"), vector_to_array(F.col(features_col)).alias("x"))
    return rows.mapInPandas(run, "label double, cell int, prediction double, n long")


def _metrics(valid: DataFrame, features_col: str, predict, task: str, name: str, cells: int) -> list:
    """(metric or None, error) of every cell, from one aggregate: one row a (cell, label, prediction) or a cell."""
    out: list = [(None, "no validation rows")] * cells
    scored = (_counted if task == "classification" else _scored)(valid, features_col, predict)
    if task == "classification":
        by: dict = {}
        for r in scored.groupBy("cell", "label", "prediction").agg(F.sum("n").cast("double").alias("n")).collect():
            by.setdefault(r["cell"], []).append((r["label"], r["prediction"], r["n"]))
        same: dict = {}
        for c, counts in by.items():
            key = tuple(sorted(counts))
            if key not in same:
                if name == "accuracy":
                    same[key] = sum(n for y, p, n in counts if y == p) / sum(n for _, _, n in counts)
                else:
                    table = scored.sparkSession.createDataFrame(counts, "label double, prediction double, n double")
                    same[key] = MulticlassClassificationEvaluator(metricName=name, weightCol="n").evaluate(table)
            out[c] = (same[key], None)
        return out
    err = F.col("prediction") - F.col("label")
    for r in scored.groupBy("cell").agg(F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop("label").alias("var")).collect():
        value = {"mse": r["mse"], "rmse": r["mse"] ** 0.5, "mae": r["mae"],
                 "r2": 1.0 - r["mse"] / r["var"] if r["var"] else float("nan")}[name]
        out[r["cell"]] = (value, None) if value == value else (None, "the metric is not a number")
    return out


def can_nest(task: str, family: str, metric: str) -> bool:
    return family in ("decision_tree", "gbt") and (task == "classification" or metric in REGRESSION_METRICS)


def groups_of(family: str, cells: list[dict]) -> list[list[int]]:
    """Cells (as {parameter: value}) that one fit can answer: alike but for the cuts of a tree, or a chain's length."""
    axes = CUT_AXES if family == "decision_tree" else (LENGTH_AXIS,)
    by: dict = {}
    for i, values in enumerate(cells):
        by.setdefault(tuple(sorted((k, repr(v)) for k, v in values.items() if k not in axes)), []).append(i)
    return list(by.values())


def score_group(est, cells: list[dict], train: DataFrame, valid: DataFrame, task: str, family: str, metric: str, features_col: str) -> list:
    """(metric or None, error) of the cells of one group (lists of {Param: value}), from one fit and one pass."""
    spark = train.sparkSession
    values = [{p.name: v for p, v in c.items()} for c in cells]
    param = {p.name: p for c in cells for p in c}

    def setting(name):
        default = est.getOrDefault(est.getParam(name))
        return [v.get(name, default) for v in values]

    if family == "decision_tree":
        cuts = list(zip(setting("maxDepth"), setting("minInfoGain"), strict=True))
        deepest = {**cells[0], **{param[n]: pick(setting(n)) for n, pick in zip(CUT_AXES, (max, min), strict=True) if n in param}}
        (tree,), _ = walkers(spark, est.fit(train, deepest))
        return _metrics(valid, features_col, lambda x: tree.cut_predictions(x, cuts), task, metric, len(cells))
    lengths = setting(LENGTH_AXIS)
    longest = {**cells[0], **({param[LENGTH_AXIS]: max(lengths)} if LENGTH_AXIS in param else {})}
    trees, weights = walkers(spark, est.fit(train, longest))

    def predict(x: np.ndarray) -> np.ndarray:
        out, total = np.empty((len(x), len(lengths))), np.zeros(len(x))
        for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
            total = total + weight * tree.prediction[tree.leaves(x)]
            for c, length in enumerate(lengths):
                if i + 1 == min(length, len(trees)):
                    out[:, c] = total > 0 if task == "classification" else total
        return out

    return _metrics(valid, features_col, predict, task, metric, len(cells))
