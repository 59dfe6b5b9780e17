"""Searches that share fits and passes give every cell the metric of a fit of its own; a fitted featuriser serves new rows."""
import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import functions as F

from obsguard.operators.features import assemble
from obsguard.plans import gram, nested, train
from obsguard.plans.grids import _grid
from obsguard.sources import fixtures


@pytest.fixture(scope="module")
def frame(spark, sf_small):
    """A noisy label, two numbers and a categorical feature."""
    o = fixtures.obs(spark, sf_small)
    names = ["li_ua_quantity_value", "li_ua_tax_value", "li_ua_linenumber_value"]
    y = F.col("li_ua_price_value") * (1 + F.col("li_ua_linenumber_value") % 3) + F.pmod(F.hash("obs_key"), F.lit(20000))
    df = o.select(y.alias("y"), (y > 70000).cast("double").alias("c"), *[F.col(c).cast("double").alias(c) for c in names])
    return assemble(df, names).select("y", "c", "features").persist()


def _set(frame, task):
    return train.training_set(frame.select(F.col("c" if task == "classification" else "y").alias("label"), "features"), families=("decision_tree",))


GRIDS = {
    "decision_tree": {"maxDepth": [2, 3, 5], "minInfoGain": [0.1, 0.01, 0.0]},
    "gbt": {"maxIter": [1, 3, 6], "maxDepth": [2, 3]},
}


@pytest.mark.parametrize("task", ["classification", "regression"])
@pytest.mark.parametrize("family", sorted(GRIDS))
def test_nested_cells_equal_separate_fits(spark, frame, task, family, monkeypatch):
    axes = dict(GRIDS[family])
    if task == "classification" and family == "decision_tree":
        axes["impurity"] = ["gini", "entropy"]
    if task == "regression" and family == "decision_tree":
        axes["minInfoGain"] = [5e8, 1e7, 0.0]
    space = {task: {family: lambda e, n: _grid(e, axes)}}
    ts = _set(frame, task)
    fits = []
    est_type = type(train.make_estimator(task, family))
    fit = est_type.fit
    monkeypatch.setattr(est_type, "fit", lambda self, df, *a: fits.append(1) or fit(self, df, *a))
    tm = train.train_family(ts, task, family, train.TrainConfig(grid=space))
    groups = 2 if (family == "gbt" or task == "classification") else 1
    assert len(fits) == groups + 1              # one fit a group of cells, one of the chosen cell
    monkeypatch.undo()
    data = ts.indexer.transform(ts.frame)
    held, rest = data.where(train.VALID_COL), data.where(~F.col(train.VALID_COL))
    est = train.make_estimator(task, family, train.INDEXED)
    if task == "classification":
        ev = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label")
    else:
        ev = RegressionEvaluator(metricName="rmse", labelCol="label")
    cells = space[task][family](est, 3)
    picked = range(0, len(cells), 3) if family == "decision_tree" else range(len(cells))
    for i in picked:
        assert tm.cell_metrics[i][2] is None
        assert tm.cell_metrics[i][1] == pytest.approx(ev.evaluate(est.fit(rest, cells[i]).transform(held)), rel=1e-9)
    assert len({m for _, m, _ in tm.cell_metrics}) > 1
    ts.release()


def test_linear_cells_from_one_pass_equal_mllib(spark, frame):
    data = frame.select(F.col("y").alias("label"), "features")
    both = gram.moments(data, F.col("label") > 1e5)
    m = both[True] + both[False]
    for reg, mix, intercept in [(0.0, 0.0, True), (0.1, 0.0, False), (2000.0, 0.4, True), (900.0, 1.0, True), (50.0, 0.6, False)]:
        want = LinearRegression(regParam=reg, elasticNetParam=mix, fitIntercept=intercept, maxIter=500, tol=1e-12).fit(data)
        w, b = gram.elastic_net(m, reg, mix, intercept)
        assert np.allclose(w, want.coefficients.toArray(), rtol=1e-6, atol=1e-6 * np.abs(w).max()) and b == pytest.approx(want.intercept, rel=1e-6, abs=1e-3)
        scored = want.transform(data)
        for name in gram.METRICS:
            assert gram.metric_of(m, w, b, name) == pytest.approx(RegressionEvaluator(metricName=name).evaluate(scored), rel=1e-6)
    glm = GeneralizedLinearRegression(family="gaussian", link="identity", regParam=0.1).fit(data)
    assert np.allclose(gram.elastic_net(m, 0.1)[0], glm.coefficients.toArray(), rtol=1e-6)


def test_the_full_linear_grid_runs_few_jobs(spark, frame):
    ts = _set(frame, "regression")
    sc = spark.sparkContext
    sc.setJobGroup("grid", "one pass")
    tm = train.train_family(ts, "regression", "linear")
    jobs = sc.statusTracker().getJobIdsForGroup("grid")
    sc.setLocalProperty("spark.jobGroup.id", None)
    ts.release()
    assert tm.grid_cells == 192 and all(e is None for _, _, e in tm.cell_metrics)
    assert len(jobs) < 30               # 192 fits would be hundreds
    assert sum(r.chosen for r in train.cells_frame(spark, [tm]).collect()) == 1


def test_equal_rows_are_drawn_apart(spark):
    few = assemble(spark.range(200).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2).cast("double").alias("x")), ["x"])
    tm = train.train_family(few.select("label", "features"), "classification", "decision_tree", train.TrainConfig(grid="smoke"))
    assert tm.validation_metric == 1.0 and all(e is None for _, _, e in tm.cell_metrics)


def test_the_node_table_is_the_model(spark, frame):
    ts = _set(frame, "classification")
    data = ts.indexer.transform(ts.frame)
    model = train.make_estimator("classification", "random_forest", train.INDEXED).setNumTrees(4).fit(data)
    trees, weights = nested.walkers(spark, model)
    assert len(trees) == 4 and weights == [1.0] * 4 and sum(len(t.left) for t in trees) == model.totalNumNodes
    rows = model.transform(data).select(train.INDEXED, "prediction").limit(500).collect()
    single = nested.walkers(spark, model.trees[0])[0][0]
    x = np.array([r[0].toArray() for r in rows])
    assert single.prediction[single.leaves(x)].tolist() == [model.trees[0].predict(r[0]) for r in rows]
    ts.release()


@pytest.mark.parametrize("rising", [True, False])
@pytest.mark.parametrize("kind", ["noise", "falling", "heavy end", "rising"])
def test_isotonic_steps_equal_mllib(spark, rising, kind):
    """Ties, weights, runs of violations over many chunks; chunks of 8 blocks."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression
    from obsguard.plans.isotonic import isotonic_steps, step_ends

    rng = np.random.default_rng(4)
    x = rng.integers(0, 90, 300).astype(float)
    y = {"noise": rng.normal(size=300) + x / 60, "falling": -x, "heavy end": x - 5000.0 * (x > 86), "rising": x}[kind]
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, rng.integers(1, 5, 300), strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1.0, None, 1.0), (2.0, 1e9, 0.0)], "x double, label double, w double")
    steps = isotonic_steps(df, "x", "label", "w", rising, chunk=8)
    got = sorted(map(tuple, steps.collect()))
    assert all(a[1] < b[0] and (a[3] <= b[3] + 1e-9 if rising else a[3] >= b[3] - 1e-9) for a, b in zip(got, got[1:], strict=False))
    plain = assemble(df.limit(300), ["x"])
    want = IsotonicRegression(weightCol="w", isotonic=rising).fit(plain)
    ours = IsotonicRegression(weightCol="weight", isotonic=rising, labelCol="value").fit(assemble(step_ends(steps), ["x"]))
    probe = assemble(spark.range(-2, 190).select((F.col("id") / 2).alias("x")), ["x"])
    a, b = ([r[1] for r in m.transform(probe).select("x", "prediction").sort("x").collect()] for m in (want, ours))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_isotonic_steps_of_nothing(spark):
    from obsguard.plans.isotonic import isotonic_steps

    assert isotonic_steps(spark.createDataFrame([], "x double, y double"), "x", "y").count() == 0


def test_a_stopped_search_fits_only_the_rest(spark, frame, tmp_path, monkeypatch):
    from obsguard.plans.ledger import CellLedger

    data = frame.select(F.col("c").alias("label"), "features")
    space = {"classification": {"naive_bayes": lambda e, n: _grid(e, {"smoothing": [0.0, 0.5, 1.0, 2.0]})}}
    plain = train.train_family(data, "classification", "naive_bayes", train.TrainConfig(grid=space))
    config = train.TrainConfig(grid=space, ledger=str(tmp_path / "ledger"), parallelism=1)
    est_type = type(train.make_estimator("classification", "naive_bayes"))
    fit, fits, enter, entered = est_type.fit, [], CellLedger.enter, []

    def stops(self, some):
        if len(entered) == 2:
            raise RuntimeError("the driver is gone")
        entered.append(1)
        enter(self, some)

    monkeypatch.setattr(CellLedger, "enter", stops)
    with pytest.raises(RuntimeError, match="gone"):
        train.train_family(data, "classification", "naive_bayes", config)
    monkeypatch.setattr(CellLedger, "enter", enter)
    fits.clear()
    monkeypatch.setattr(est_type, "fit", lambda self, df, *a: fits.append(1) or fit(self, df, *a))
    again = train.train_family(data.repartition(3), "classification", "naive_bayes", config)
    assert len(fits) == 2 + 1                   # the two cells that were missing, and the final fit
    assert again.cell_metrics == plain.cell_metrics and again.chosen == plain.chosen
    ledger = CellLedger(spark, config.ledger, "")
    before = sorted(map(tuple, ledger.entries().collect()))
    ledger.compact()
    assert sorted(map(tuple, ledger.entries().collect())) == before and len(before) == 4
    fits.clear()
    other = data.where("label = 1").unionByName(data)          # other rows: another search
    train.train_family(other, "classification", "naive_bayes", config)
    assert len(fits) == 4 + 1


def test_gram_hands_numbers_to_python_not_arrays(spark, monkeypatch):
    """One column a feature reaches the aggregate's tasks, and the sums are those of the rows."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from obsguard.plans import gram

    a, b = F.col("id").cast("double"), (F.col("id") % 7).cast("double")
    data = spark.range(500).select(array_to_vector(F.array(a, b)).alias("features"), (a + 2 * b).alias("label"))
    seen, plain = [], type(data).mapInPandas
    monkeypatch.setattr(type(data), "mapInPandas", lambda self, *x, **k: (seen.append(dict(self.dtypes)), plain(self, *x, **k))[1])
    got = gram.moments(data, F.col("label") > 100)
    assert seen and not [t for t in seen[0].values() if t.startswith("array")]
    rows = np.array([[i, i % 7, i + 2 * (i % 7)] for i in range(500)], float)
    for side in (False, True):
        assert np.allclose(got[side].means(), rows[(rows[:, 2] > 100) == side].mean(axis=0))


def test_a_classifiers_cells_are_counted_inside_the_tasks(spark):
    rows = spark.createDataFrame([(float(i % 2) if i % 50 else None, [float(i % 5)]) for i in range(1000)], "label double, x array<double>")
    valid = rows.select("label", array_to_vector("x").alias("features")).coalesce(1)

    def predict(x):
        return np.column_stack([x[:, 0] > 2, x[:, 0] > 0]).astype(float)

    pairs = nested._counted(valid, "features", predict)
    assert pairs.count() <= 2 * 6                # two cells, three labels, two predictions: no row a (row, cell)
    want = nested._scored(valid, "features", predict).groupBy("cell", "label", "prediction").count()
    assert set(map(tuple, pairs.select("cell", "label", "prediction", "n").collect())) == set(map(tuple, want.collect()))


@pytest.mark.parametrize("metric", ["accuracy", "f1", "weightedPrecision", "hammingLoss", "logLoss"])
def test_a_fitted_cells_metric_comes_from_counted_pairs(spark, metric, monkeypatch):
    scored = spark.range(1000).select((F.col("id") % 3).cast("double").alias("label"), (F.col("id") % 7 % 3).cast("double").alias("prediction"),
                                      array_to_vector(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))).alias("probability"))
    ev = MulticlassClassificationEvaluator(metricName=metric)
    want, seen = ev.evaluate(scored), []
    plain = MulticlassClassificationEvaluator._evaluate
    monkeypatch.setattr(MulticlassClassificationEvaluator, "_evaluate", lambda self, df: seen.append(df.count()) or plain(self, df))
    assert train._measured(ev, scored) == want
    assert seen == [1000 if metric == "logLoss" else 9]
