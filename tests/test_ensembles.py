"""Tree models as tables: every row scored from the nodes, and from the leaves in DuckDB, as the model does."""

import duckdb
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from obsguard.plans.ensembles import TreeTable, kind_of

MODELS = {
    "tree_c": (DecisionTreeClassifier, {"maxDepth": 4}), "tree_r": (DecisionTreeRegressor, {"maxDepth": 4}),
    "forest_c": (RandomForestClassifier, {"numTrees": 7, "maxDepth": 4, "seed": 3}),
    "forest_r": (RandomForestRegressor, {"numTrees": 7, "maxDepth": 4, "seed": 3}),
    "chain_c": (GBTClassifier, {"maxIter": 5, "maxDepth": 3, "seed": 3}),
    "chain_r": (GBTRegressor, {"maxIter": 5, "maxDepth": 3, "seed": 3}),
}


@pytest.fixture(scope="module")
def points(spark, sf_small):
    li = spark.read.parquet(f"{sf_small}/lineitem.parquet")
    kind = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    rows = li.select("l_quantity", "l_tax", kind.alias("kind"), (F.col("l_linenumber") % 5).cast("double").alias("line"),
                     F.col("l_extendedprice").alias("price"), F.monotonically_increasing_id().alias("row_id"))
    rows = rows.withColumns({"label": ((F.col("line") * 7 + F.col("kind") * 3 + F.col("l_quantity")) % 11 > 5).cast("double")})
    vec = VectorAssembler(inputCols=["l_quantity", "l_tax", "kind", "line"], outputCol="raw").transform(rows)
    out = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=8).fit(vec).transform(vec)
    return out.select("row_id", "label", "price", "features").cache()


@pytest.fixture(scope="module")
def fitted(points):
    return {n: kind(labelCol="label" if n.endswith("_c") else "price", **settings).fit(points) for n, (kind, settings) in MODELS.items()}


@pytest.mark.parametrize("name", list(MODELS))
def test_nodes_score_as_the_model(spark, points, fitted, name, tmp_path):
    model = fitted[name]
    TreeTable.of(spark, model).write(str(tmp_path / "nodes"))
    table = TreeTable.read(spark, str(tmp_path / "nodes"))
    both = table.score(model.transform(points).withColumnRenamed("prediction", "own"), trees_col="says")
    assert both.where(F.abs(F.col("own") - F.col("prediction")) > 1e-9).isEmpty() and both.where("prediction is null").isEmpty()
    trees = 1 if name.startswith("tree") else len(model.trees)
    assert both.where(F.size("says") != trees).isEmpty()
    plan = table.score(points)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("name", list(MODELS))
def test_leaves_score_in_sql(spark, points, fitted, name):
    """DuckDB joins rows and leaves by ranges: exactly one leaf of a tree holds a row, and says what the tree says."""
    model = fitted[name]
    table = TreeTable.of(spark, model)
    leaves = table.leaves().toPandas()
    assert not leaves.duplicated(["tree", "leaf", "feature"]).any()
    some = points.where("row_id % 7 = 0")
    want = table.score(some, trees_col="says").select("row_id", F.posexplode("says").alias("tree", "says")).toPandas()
    from pyspark.ml.functions import vector_to_array

    cells = some.select("row_id", F.posexplode(vector_to_array("features")).alias("feature", "x")).toPandas()
    con = duckdb.connect()
    for n, f in (("leaves", leaves), ("want", want), ("cells", cells)):
        con.register(n, f)
    sql = """
    WITH need AS (SELECT tree, leaf, any_value(prediction) AS prediction, count(*) AS k FROM leaves GROUP BY tree, leaf),
    met AS (SELECT l.tree, l.leaf, c.row_id, count(*) AS k FROM leaves l JOIN cells c ON c.feature = l.feature
             AND (l.low IS NULL OR isnan(l.low) OR c.x > l.low) AND (l.high IS NULL OR isnan(l.high) OR c.x <= l.high)
             AND (l.among IS NULL OR list_contains(l.among, c.x)) AND (l.outside IS NULL OR NOT list_contains(l.outside, c.x))
            GROUP BY ALL),
    hit AS (SELECT met.row_id, need.tree, need.prediction FROM met JOIN need USING (tree, leaf) WHERE met.k = need.k)
    SELECT count(*) AS n, count(h.row_id) AS hits, sum((abs(h.prediction - w.says) > 1e-9)::INT) AS off
    FROM want w LEFT JOIN hit h ON h.row_id = w.row_id AND h.tree = w.tree"""
    n, hits, off = con.execute(sql).fetchone()
    assert n == hits == len(want) > 0 and off == 0


def test_a_tree_without_a_split(spark, points):
    model = DecisionTreeRegressor(maxDepth=2, labelCol="one").fit(points.withColumn("one", F.lit(3.0)))
    table = TreeTable.of(spark, model)
    assert table.depth == 0 and table.score(points).select("prediction").distinct().collect() == [(3.0,)]
    (leaf,) = table.leaves().collect()
    assert leaf.feature is None and leaf.prediction == 3.0


def test_names_that_rows_have_are_kept(spark, points, fitted):
    odd = points.withColumns({"_model": F.lit(1), "model": F.lit(2), "x": F.lit(3), "ends": F.lit(4), "nodes": F.lit(5)})
    out = TreeTable.of(spark, fitted["tree_r"]).score(odd)
    assert out.columns == [*odd.columns, "prediction"] and out.first().ends == 4


def test_other_models_are_refused(fitted):
    with pytest.raises(ValueError):
        kind_of(object())
    assert kind_of(fitted["chain_c"]) == ("chain", "classification")


def test_no_row_carries_the_nodes(spark, points, fitted):
    """The nodes are a value of the plan, not a column joined to every row."""
    scored = TreeTable.of(spark, fitted["forest_r"]).score(points)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Subquery" in plan


def test_forest_query_scores_a_row_once(spark, sf_small):
    """Rows are counted before they unfold into one row a tree, and no filter walks the trees again."""
    from obsguard.plans import catalog

    out = catalog.q_forest_trees_as_table(spark, sf_small)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Filter" in line and "transform(" in line]
    generate = next(i for i, line in enumerate(plan) if "Generate posexplode" in line)
    assert any("Aggregate" in line and "count(1)" in line for line in plan[generate + 1:])
