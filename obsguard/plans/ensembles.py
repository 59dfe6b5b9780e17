"""Fitted tree models as tables: nodes that score rows without the model, leaves as boxes for any SQL engine.

A tree, forest or boosted chain is one table of nodes (`nested.node_table`). `TreeTable.score` follows it for every row inside
one projection: the nodes are one value of the plan (trees x 2 ** (depth + 1) nodes, bounded by the grid cell, not by
the data) that no row carries, a row takes one step a level in each tree, nothing is shuffled and no Python runs. `leaves` gives the same trees as
boxes: one row a (tree, leaf, feature) with the bounds or categories that lead there, so that a join by ranges scores
them anywhere. Rows are the vectors that the model's own stage reads (after the pipeline's VectorIndexer).

Votes are combined as MLlib does: a tree's own prediction; a forest's mean (regression) or its summed class shares, the first
greatest winning (classification); a chain's weighted sum, as it is (regression) or by its sign (classification).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..schema import spare_names
from ..session import discard, reliable_checkpoint
from .nested import node_table

TREE, FOREST, CHAIN = "tree", "forest", "chain"


def kind_of(model) -> tuple[str, str]:
    """(tree, forest or chain; classification or regression) of a fitted tree model."""
    name = type(model).__name__
    kinds = {"DecisionTree": TREE, "RandomForest": FOREST, "GBT": CHAIN}
    found = [k for start, k in kinds.items() if name.startswith(start)]
    if not found:
        raise ValueError(f"{name} is not made of trees")
    return found[0], "classification" if "Classif" in name else "regression"


@dataclass
class TreeTable:
    """The nodes of one model: rows (tree, weight, id, prediction, gain, left, right, feature, threshold, left_categories,
    categories, stats), a leaf has left = -1."""

    nodes: DataFrame
    kind: str
    task: str
    depth: int

    @classmethod
    def of(cls, spark: SparkSession, model) -> TreeTable:
        nodes, path = node_table(spark, model)
        kept = reliable_checkpoint(nodes)
        discard(spark, path)
        depth = int(model.depth) if kind_of(model)[0] == TREE else max([int(t.depth) for t in model.trees] + [0])
        return cls(kept, *kind_of(model), depth)

    def write(self, path: str) -> None:
        """The nodes as Parquet, each with the kind, task and depth of its model."""
        self.nodes.withColumns({"kind": F.lit(self.kind), "task": F.lit(self.task), "depth": F.lit(self.depth)}).write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TreeTable:
        rows = spark.read.parquet(path)
        one = rows.select("kind", "task", "depth").first()
        return cls(rows.drop("kind", "task", "depth"), one["kind"], one["task"], one["depth"])

    def _votes(self) -> bool:
        return self.kind == FOREST and self.task == "classification"

    def _one_value(self) -> Column:
        """All trees in order, each with its nodes by id and what a leaf says: one value, read once for all rows."""
        shares = F.lit(None).cast("array<double>")
        if self._votes():
            total = F.aggregate("stats", F.lit(0.0), lambda s, c: s + c)
            shares = F.transform("stats", lambda c: F.when(total > 0, c / total).otherwise(0.0))
        node = F.struct("id", "left", "right", F.greatest("feature", F.lit(0)).alias("feature"), "threshold", "left_categories",
                        (F.col("categories") >= 0).alias("categorical"), "prediction", shares.alias("shares"))
        trees = self.nodes.groupBy("tree").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list(node)).alias("nodes"))
        tree = F.struct("tree", "weight", "nodes")
        return trees.agg(F.sort_array(F.collect_list(tree)).alias("model")).scalar()

    def score(self, rows: DataFrame, features_col: str = C.FEATURES_COL, prediction_col: str = C.PREDICTION_COL,
              trees_col: str | None = None) -> DataFrame:
        """`rows` plus the model's prediction; `trees_col` adds what every tree says, in order of the trees.

        Of a row's way through the trees only what its leaves say is kept, and no row carries the nodes."""
        model, ends = spare_names(rows, "model", "ends", also=(prediction_col, trees_col or ""))

        def leaf_of(tree: Column, value: Column) -> Column:
            nodes = tree["nodes"]

            def step(node: Column, _: Column) -> Column:
                here = F.get(value, node["feature"])
                to_left = F.when(node["categorical"], F.array_contains(node["left_categories"], here)).otherwise(here <= node["threshold"])
                return F.when(node["left"] < 0, node).otherwise(F.get(nodes, F.when(to_left, node["left"]).otherwise(node["right"])))

            def says(leaf: Column) -> Column:
                if self.kind == CHAIN:
                    return F.struct(tree["weight"].alias("weight"), leaf["prediction"].alias("prediction"))
                return F.struct(leaf["prediction"].alias("prediction"), leaf["shares"].alias("shares")) if self._votes() else leaf["prediction"]

            return F.aggregate(F.array_repeat(F.lit(0), self.depth), F.get(nodes, F.lit(0)), step, says)

        # the vector is turned into an array once a row (an array of one, so that it is a variable of the lambda), and a model
        # that is used once is read in place: no row is widened by it
        x = F.array(vector_to_array(F.col(f"`{features_col}`")))
        ways = F.transform(x, lambda value: F.transform(F.col(model), lambda tree: leaf_of(tree, value)))
        wide = rows.withColumn(model, self._one_value()).withColumn(ends, F.get(ways, F.lit(0))).drop(model)
        out = {prediction_col: self._combined(F.col(ends))}
        if trees_col:
            out[trees_col] = F.col(f"{ends}.prediction") if self.kind == CHAIN or self._votes() else F.col(ends)
        return wide.withColumns(out).drop(ends)

    def _combined(self, ends: Column) -> Column:
        zero = F.lit(0.0)
        if self.kind == CHAIN:
            total = F.aggregate(ends, zero, lambda s, e: s + e["weight"] * e["prediction"])
            return F.when(total > 0, 1.0).otherwise(0.0) if self.task == "classification" else total
        if self.kind == TREE:
            return F.get(ends, F.lit(0))
        if self.task == "regression":
            return F.aggregate(ends, zero, lambda s, e: s + e) / F.size(ends)
        classes = F.size(F.get(ends, F.lit(0))["shares"])
        votes = F.aggregate(ends, F.array_repeat(zero, classes), lambda s, e: F.zip_with(s, e["shares"], lambda a, b: a + b))
        return (F.array_position(votes, F.array_max(votes)) - 1).cast("double")

    def leaves(self) -> DataFrame:
        """(tree, weight, leaf, prediction, feature, low, high, among, outside): a row is in the leaf if for all of its
        rows low < x[feature] <= high, x[feature] is among and not outside (null: no such bound). The one leaf of a tree
        without a split has one row with a null feature."""
        schema = "array<struct<feature:int,low:double,high:double,among:array<double>,outside:array<double>>>"
        nodes = self.nodes
        open_ = nodes.where("id = 0").withColumn("path", F.array().cast(schema))
        done = None
        for level in range(self.depth + 1):
            ends = open_.where("left < 0").select("tree", "weight", F.col("id").alias("leaf"), "prediction", "path")
            done = ends if done is None else done.unionByName(ends)
            if level == self.depth:
                break
            number = F.col("categories") < 0
            none, nothing = F.lit(None).cast("double"), F.lit(None).cast("array<double>")

            def bound(left: bool, number=number, none=none, nothing=nothing) -> Column:
                threshold, cats = F.when(number, F.col("threshold")), F.when(~number, F.col("left_categories"))
                return F.struct(F.col("feature").cast("int").alias("feature"), (none if left else threshold).alias("low"),
                                (threshold if left else none).alias("high"), (cats if left else nothing).alias("among"),
                                (nothing if left else cats).alias("outside"))

            sides = F.array(*[F.struct(F.col(c).alias("child"), F.concat("path", F.array(bound(c == "left")).cast(schema)).alias("path"))
                              for c in ("left", "right")])
            down = open_.where("left >= 0").select(F.col("tree").alias("t"), F.explode(sides).alias("s")).select("t", "s.child", "s.path")
            open_ = nodes.join(down, (F.col("tree") == F.col("t")) & (F.col("id") == F.col("child"))).drop("t", "child")
        flat = done.select("tree", "weight", "leaf", "prediction", F.explode_outer("path").alias("c")).select(
            "tree", "weight", "leaf", "prediction", "c.*")
        sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("outside")))).alias("outside")]
        # among: what every set of the path holds
        both = F.aggregate(F.collect_list("among"), F.first("among", ignorenulls=True), lambda s, a: F.array_intersect(s, a))
        out = flat.groupBy("tree", "weight", "leaf", "prediction", "feature").agg(
            F.max("low").alias("low"), F.min("high").alias("high"), both.alias("among"), *sets)
        return out.withColumn("outside", F.when(F.size("outside") > 0, F.col("outside")))
