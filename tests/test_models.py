import glob

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from obsguard.operators.split import tag_split
from obsguard.plans import jobs, train
from obsguard.plans.grids import grid_size
from obsguard.session import ensure_checkpoint_dir
from obsguard.sources.registry import ModelRegistry


@pytest.fixture(scope="module")
def points(spark):
    rows = [(f"e{i % 3}", float(i), float(i % 2), Vectors.dense([float(i % 2) + (i % 5) * 0.1, (i % 7) / 7.0]))
            for i in range(200)]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("ado_id", T.StringType()), T.StructField("timestamp", T.DoubleType()),
                           T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    return spark.createDataFrame(rows, schema)


def test_full_grid_sizes(spark):
    sizes = {f: grid_size("full", "classification", f) for f in train.CLASSIFIERS}
    assert sizes == {"decision_tree": 32, "random_forest": 128, "gbt": 48, "mlp": 18, "logistic": 192,
                     "naive_bayes": 3}
    rsizes = {f: grid_size("full", "regression", f) for f in train.REGRESSORS}
    assert rsizes == {"linear": 192, "glm": 192, "decision_tree": 16, "random_forest": 64, "gbt": 48, "isotonic": 2}


def test_train_save_load_same_predictions(spark, points, tmp_path):
    tm = train.train_family(points, "classification", "decision_tree", train.TrainConfig(grid="smoke"))
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    key = ("classification", "x", "decision_tree", "h1")
    reg.save(tm.model, *key, metric=tm.validation_metric)
    assert reg.exists(*key)
    loaded = reg.load(*key)
    a = [r[0] for r in tm.model.transform(points).orderBy("timestamp").select("prediction").collect()]
    b = [r[0] for r in loaded.transform(points).orderBy("timestamp").select("prediction").collect()]
    assert a == b
    reg.save(tm.model, *key)
    assert reg.latest(*key)["version"] == 2
    assert reg.list_models().count() == 2
    reg.clear()
    assert not reg.exists(*key)


def test_failing_family_is_reported(spark, points):
    neg = points.selectExpr("ado_id", "timestamp", "label", "features").withColumn("label", points.label)
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    neg = neg.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda x: x - 5.0)))
    ms = jobs.train_models(neg, "classification", families=["naive_bayes", "logistic"],
                           config=jobs.JobConfig(train=train.TrainConfig(grid="smoke")))
    assert "naive_bayes" in ms.failures and "logistic" in ms.models


def test_evaluate_classification_one_row_per_model(spark, points):
    rep = jobs.evaluate_classification(points, (0.7, 0.3), 1, families=["logistic", "decision_tree"],
                                       config=jobs.JobConfig(train=train.TrainConfig(grid="smoke")))
    assert sorted(r["model"] for r in rep.collect()) == ["decision_tree", "logistic"]


def test_models_load_from_registry_when_not_forced(spark, points, tmp_path):
    cfg = jobs.JobConfig(train=train.TrainConfig(grid="smoke"), registry_root=str(tmp_path / "r"))
    first = jobs.train_models(points, "classification", "x", ["logistic"], force_train=False, config=cfg)
    assert [t.family for t in first.trained] == ["logistic"]
    second = jobs.train_models(points, "classification", "x", ["logistic"], force_train=False, config=cfg)
    assert second.trained == [] and "logistic" in second.models
    forced = jobs.train_models(points, "classification", "x", ["logistic"], force_train=True, config=cfg)
    assert [t.family for t in forced.trained] == ["logistic"]
    reg = ModelRegistry(spark, cfg.registry_root)
    assert reg.latest("classification", "x", "logistic")["version"] == 2


def test_evaluate_with_random_split(spark, points):
    rep = jobs.evaluate_classification(points, (0.7, 0.3), 1, families=["naive_bayes"], split="random",
                                       config=jobs.JobConfig(train=train.TrainConfig(grid="smoke")))
    assert [r["model"] for r in rep.collect()] == ["naive_bayes"]


def test_write_report_writes_and_never_raises(spark, tmp_path):
    import os

    from obsguard.sources.report import write_report

    rep = spark.createDataFrame([("m", 0.5)], "model string, accuracy double")
    assert write_report(rep, str(tmp_path / "rep"), "json")
    assert any(f.endswith(".json") for f in os.listdir(tmp_path / "rep"))
    assert write_report(rep, str(tmp_path / "bad"), "no-such-format") is False


SMOKE = train.TrainConfig(grid="smoke")


@pytest.fixture(scope="module")
def raw(spark):
    """An observation table: y follows x, u is noise, the status is suspect for high x."""
    rows = [(f"e{i % 3}", i, float(i % 10), float(10 * (i % 10) + i % 3), float((i * 7) % 11), 2 if i % 10 > 6 else 0)
            for i in range(300)]
    return spark.createDataFrame(rows, "ado_id string, timestamp long, x_value double, y_value double, u_value double, y_status int")


def test_the_default_search_space_is_the_full_one():
    assert train.TrainConfig().grid == "full" and jobs.JobConfig().train.grid == "full"


def test_regression_and_time_series_share_a_registry(spark, raw, tmp_path):
    cfg = jobs.JobConfig(train=SMOKE, registry_root=str(tmp_path / "r"))
    a = jobs.evaluate_regression_for(raw, "y", 200, config=cfg, families=["decision_tree"]).collect()
    b = jobs.evaluate_time_series_for(raw, "y", 200, force_train=False, config=cfg, families=["decision_tree"]).collect()
    assert a[0].error is None and b[0].error is None and a[0].n_rows == b[0].n_rows == 99
    listed = ModelRegistry(spark, cfg.registry_root).list_models().collect()
    assert sorted(r.features.split("\n") for r in listed) == [["timestamp"], ["x_value", "u_value"]]
    assert len({r.config_hash for r in listed}) == 2 and all(len(r.config_hash) == 64 for r in listed)
    again = jobs.evaluate_time_series_for(raw, "y", 200, force_train=False, config=cfg, families=["decision_tree"]).collect()
    assert again == b and ModelRegistry(spark, cfg.registry_root).list_models().count() == 2


def test_own_grids_have_keys_of_their_own():
    from obsguard.plans.grids import _grid

    def grid(depth):
        return train.TrainConfig(grid={"regression": {"decision_tree": lambda e, n: _grid(e, {"maxDepth": [depth]})}})

    one, nine = grid(1).hash("regression", "decision_tree"), grid(9).hash("regression", "decision_tree")
    assert one != nine and one == grid(1).hash("regression", "decision_tree")
    assert grid(1).hash("regression", "decision_tree", {"as_of_ms": 5}) != one


def test_saving_never_replaces_a_model(spark, points, tmp_path):
    tm = train.train_family(points, "classification", "decision_tree", SMOKE)
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    key = ("classification", "x", "decision_tree", "h")
    first = reg.save(tm.model, *key, features=["f"])
    reg.clear()
    second = reg.save(tm.model, *key, features=["f"])
    assert first != second
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(first) is not None
    with pytest.raises(ValueError, match="features"):
        reg.load(*key, features=["g"])


def test_an_unreadable_registry_is_an_error(spark, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path / "reg"))
    assert reg.table().count() == 0
    (tmp_path / "reg" / "registry" / "log").mkdir(parents=True)
    (tmp_path / "reg" / "registry" / "log" / "000000000001.json").write_bytes(b"not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        reg.exists("a", "b", "c")


def test_one_bad_model_costs_only_its_own_row(spark, points):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer

    good = train.train_family(points, "classification", "decision_tree", SMOKE).model
    bad = PipelineModel(stages=[SQLTransformer(statement="SELECT *, raise_error('broken') AS prediction FROM __THIS__")])
    rep = jobs._report({"good": good, "bad": bad}, {"lost": "no model"}, points, jobs.classification_report)
    got = {r.model: r for r in rep.collect()}
    assert got["good"].accuracy == 1.0 and "broken" in got["bad"].error and got["lost"].error == "no model"
    only = jobs._report({}, {"lost": "no model"}, points, jobs.classification_report).collect()
    assert [r.model for r in only] == ["lost"]


def test_whole_error_texts(spark, points):
    config = train.TrainConfig(grid={"classification": {}})
    ms = jobs.train_models(points, "classification", families=["logistic"], config=jobs.JobConfig(train=config))
    assert "logistic" in ms.failures["logistic"] and ms.models == {}


@pytest.mark.parametrize("family", ["linear", "decision_tree"])
def test_the_validation_does_not_depend_on_the_partitioning(spark, family):
    from pyspark.sql import functions as F

    rows = spark.range(500).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("w"),
                                   (F.col("id") * 3 + F.pmod(F.hash("id"), F.lit(11))).cast("double").alias("label"))
    from obsguard.operators.features import assemble

    base = assemble(rows, ["x", "w"]).select("label", "features")
    got = {round(train.train_family(base.repartition(n), "regression", family, SMOKE).validation_metric, 6) for n in (2, 3, 5, 16)}
    assert len(got) == 1


def test_one_store_and_one_indexer_for_all_families(spark, points, monkeypatch):
    fits = []
    fit = train.VectorIndexer.fit
    monkeypatch.setattr(train.VectorIndexer, "fit", lambda self, df, *a: fits.append(1) or fit(self, df, *a))
    stored = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = stored().size()
    ms = jobs.train_models(points, "classification", families=["decision_tree", "random_forest", "gbt"],
                           config=jobs.JobConfig(train=SMOKE))
    assert len(ms.models) == 3 and len(fits) == 1
    assert stored().size() <= before


def test_pooled_isotonic_equals_the_plain_fit(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression
    from pyspark.sql import functions as F
    from obsguard.operators.features import assemble

    rows = spark.range(400).select((F.col("id") % 23).cast("double").alias("x"), F.pmod(F.hash("id"), F.lit(50)).cast("double").alias("label"))
    base = assemble(rows, ["x"]).select("label", "features")
    plain = IsotonicRegression().fit(base)
    ours = IsotonicRegression(weightCol=train.WEIGHT_COL).fit(train.pooled(base))
    a, b = ([round(r[0], 9) for r in m.transform(base.distinct()).orderBy(vector_to_array("features")[0], "label")
             .select("prediction").collect()] for m in (plain, ours))
    assert a == b


def test_cells_are_reported(spark, points):
    tm = train.train_family(points, "classification", "decision_tree", SMOKE)
    cells = train.cells_frame(spark, [tm]).collect()
    assert len(cells) == 2 and sum(r.chosen for r in cells) == 1 and all(r.error is None for r in cells)


def _numbered(spark, rows):
    """(label, features) with six feature vectors and five labels each, or two classes."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    x = F.array((F.col("id") % 3).cast("double"), (F.col("id") % 2).cast("double"))
    y = (F.col("id") % 3) * 10 + (F.col("id") % 2) * 4 + F.floor(F.col("id") / 6) % 5
    return spark.range(rows).select(y.cast("double").alias("label"), array_to_vector(x).alias("features"))


def test_large_frames_are_stored_in_parts_of_bounded_rows(spark, monkeypatch):
    """However few splits a table is read in, a task of a fit reads a bounded number of rows."""
    monkeypatch.setattr(train, "PART_NUMBERS", 10_000, raising=False)
    stored = train.kept(_numbered(spark, 20_000).coalesce(4))
    assert stored.rdd.getNumPartitions() >= 20          # two features and eight more a row
    assert stored.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).max() <= 1_100
    assert stored.count() == 20_000
    stored.unpersist()


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_boosted_chain_is_fitted_on_pools(spark, monkeypatch, task):
    """Equal feature vectors are one weighted row a bin, and the chain says what the chain of all rows says."""
    from pyspark.sql import functions as F

    points = _numbered(spark, 6_000)
    if task == "classification":
        points = points.withColumn("label", (F.col("label") % 5 > 1).cast("double"))
    said, fitted_rows = {}, {}
    for name, least in (("rows", 1 << 40), ("pools", 1)):
        monkeypatch.setattr(train, "POOL_FROM", least, raising=False)
        monkeypatch.setattr(train, "POOL_GAIN", 0, raising=False)
        grid = {task: {"gbt": lambda e, n: train.grid_for("smoke", task, "gbt")(e, n)}}
        seen = []
        plain = train.make_estimator

        def watched(*a, plain=plain, seen=seen, **k):
            est = plain(*a, **k)
            fit = est._fit
            est._fit = lambda df: (seen.append(df.count()), fit(df))[1]
            est.copy = lambda extra=None, est=est: (est._set(**{p.name: v for p, v in (extra or {}).items()}), est)[1]
            return est

        with monkeypatch.context() as m:
            m.setattr(train, "make_estimator", watched)
            tm = train.train_family(points, task, "gbt", train.TrainConfig(grid=grid))
        fitted_rows[name] = max(seen)
        said[name] = {(tuple(r[0]), round(r[1], 9)) for r in tm.model.transform(points).select("features", "prediction").distinct().collect()}
        said[name, "metric"] = tm.validation_metric
    assert fitted_rows["rows"] == 6_000 and fitted_rows["pools"] < 1_000
    assert said["rows"] == said["pools"]
    assert said["rows", "metric"] == pytest.approx(said["pools", "metric"], abs=1e-9)


def test_grids_that_count_rows_are_not_pooled(spark):
    from pyspark.ml.regression import GBTRegressor

    data = train.draw_validation(_numbered(spark, 200_000), train.TrainConfig())
    est = GBTRegressor()
    for cell in ({est.subsamplingRate: 0.5}, {est.minInstancesPerNode: 5}, {est.lossType: "absolute"}):
        assert train.pooled_points(data, est, [cell], "regression", "features") is None
    pools = train.pooled_points(data, est, [{}], "regression", "features")
    from pyspark.sql import functions as F

    assert pools.agg(F.sum(train.WEIGHT_COL)).first()[0] == 200_000 and pools.count() < 2_000
    pools.unpersist()


def test_many_feature_vectors_that_repeat_a_little_are_pooled_once_each(spark):
    """A feature of 4,096 values, each held by some fifty rows: one pool for a value and side, not one for every bin."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    data = spark.range(200_000).select(((F.col("id") * 7919) % 4096 / 4096).alias("a"), (F.col("id") % 5).cast("double").alias("label"),
                                       (F.col("id") % 4 == 0).alias(train.VALID_COL))
    data = VectorAssembler(inputCols=["a"], outputCol="features").transform(data).select("label", "features", train.VALID_COL)
    pools = train.pooled_points(data, train.make_estimator("regression", "gbt"), [{}], "regression", "features")
    assert pools is not None
    assert pools.count() == data.select("features", train.VALID_COL).distinct().count()
    sums = pools.agg(F.sum(train.WEIGHT_COL).alias("n"), F.sum(F.col(train.WEIGHT_COL) * F.col("label")).alias("y")).first()
    want = data.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).first()
    assert sums["n"] == want["n"] and sums["y"] == pytest.approx(want["y"])
    pools.unpersist()


def test_the_draw_of_a_keyed_split_is_made_once(spark):
    """Profile, featuriser, training store and scoring read the parts; a row's key is computed for none of them again."""
    passes = spark.sparkContext.accumulator(0)
    key = F.udf(lambda i: passes.add(1) or f"k{i}", "string")
    raw = spark.range(600).select(F.concat(F.lit("e"), F.col("id") % 3).alias("ado_id"), F.col("id").alias("timestamp"), key("id").alias("obs_key"),
                                  (F.col("id") % 2).cast("double").alias("a_ua_b_value"), (F.col("id") % 11).cast("double").alias("a_ua_q_value"),
                                  F.when(F.col("id") % 2 == 1, 2).otherwise(0).alias("a_ua_b_status"))
    rep = jobs.evaluate_classification_for(raw, "a_ua_b", (0.7, 0.3), 1, config=jobs.JobConfig(train=train.TrainConfig(grid="smoke")), key_cols=["obs_key"],
                                           families=["naive_bayes", "decision_tree"]).collect()
    assert {r["model"]: r["error"] for r in rep} == {"naive_bayes": None, "decision_tree": None}
    assert passes.value == 600
    keys = spark.range(600).select(F.concat(F.lit("k"), F.col("id")).alias("obs_key"))
    assert {r["n_rows"] for r in rep} == {tag_split(keys, [0.7, 0.3], 1, key_cols=["obs_key"]).where("part = 1").count()}
    assert not glob.glob(f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/tagged-rows-*")


def test_a_void_column_does_not_stop_a_keyed_split(spark):
    raw = spark.range(400).select(F.concat(F.lit("e"), F.col("id") % 3).alias("ado_id"), F.col("id").alias("timestamp"), F.lit(None).alias("a_ua_none_value"),
                                  (F.col("id") % 2).cast("double").alias("a_ua_b_value"), F.when(F.col("id") % 2 == 1, 2).otherwise(0).alias("a_ua_b_status"))
    rep = jobs.evaluate_classification_for(raw, "a_ua_b", (0.7, 0.3), 1, config=jobs.JobConfig(train=train.TrainConfig(grid="smoke")), key_cols=["timestamp"],
                                           families=["naive_bayes"]).collect()
    want = tag_split(raw.select("timestamp"), [0.7, 0.3], 1, key_cols=["timestamp"]).where("part = 1").count()
    assert [(r["model"], r["error"], r["n_rows"]) for r in rep] == [("naive_bayes", None, want)]
