"""A fitted featuriser: training rows keep their features, new rows are measured with the training's rulers."""
import pytest
from pyspark.sql import functions as F

from obsguard.plans import featuriser, jobs, train
from obsguard.plans.featuriser import Featuriser, fit_featuriser
from obsguard.plans.grids import _grid
from obsguard.plans.labelled import transform_rows
from obsguard.schema import spare_names
from obsguard.sources import fixtures
from obsguard.sources.registry import ModelRegistry

SPLIT = 915148800000
SCHEMA = "ado_id string, timestamp long, x_value double, s_value string, y_value double, y_status int"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"e{i % 3}", i, float(i % 10), "abc"[i % 3 if i % 7 else 0], float(10 * (i % 10) + i % 3), 2 if i % 10 > 6 else 0) for i in range(120)]
    return spark.createDataFrame(data, SCHEMA)


def _rows(lp):
    return sorted(map(tuple, lp.expanded().collect()), key=repr)


@pytest.mark.parametrize("kw", [{"label": "li_ua_quantity_status", "null_threshold": 0.05}, {"label": "li_ua_price_value", "features": "time"}],
                         ids=["strings", "time"])
def test_training_rows_get_the_features_of_the_plan(spark, sf_small, kw):
    o = fixtures.obs_with_strings(spark, sf_small).where(F.col("timestamp") <= SPLIT)
    fz = Featuriser.load(spark, fit_featuriser(o, keep=("obs_key",), **kw).path)
    want = transform_rows(o, keep=("obs_key",), **kw)
    got = fz.apply(o, keep=("obs_key",))
    assert got.feature_names == want.feature_names and got.scaled == want.scaled
    assert _rows(got) == _rows(want) == _rows(fz.apply(o, keep=("obs_key",), force_shuffle=True))


def test_other_rows_never_change_a_training_feature(spark, rows):
    fz = fit_featuriser(rows, "y_status")
    late = spark.createDataFrame([("e0", 500 + i, 1e6, "c", -5.0, 0) for i in range(300)] + [("new", 900, 4.0, "z", 1.0, 2)], SCHEMA)
    alone = _rows(fz.apply(rows))
    mixed = sorted(map(tuple, fz.apply(rows.unionByName(late)).expanded().where("timestamp < 500").collect()), key=repr)
    assert mixed == alone and len(alone) == 120


def test_rules_for_what_training_has_not_seen(spark, rows):
    fz = fit_featuriser(rows, "y_status")
    assert fz.feature_names == ["x_value", "y_value", "s_value"] and fz.strings == {"s_value": 3} and fz.scaled
    new = spark.createDataFrame([("e0", 1, 18.0, "a", 0.0, 2), ("e1", 2, 4.5, "zzz", 0.0, 0), ("new", 3, 4.5, "a", 0.0, 0), (None, 4, 4.5, "a", 0.0, 0),
                                 ("e0", 5, None, "a", 0.0, 0), ("e0", 6, 1.0, None, 0.0, 0)], SCHEMA)
    got = {r["timestamp"]: r for r in fz.apply(new).expanded().collect()}
    assert sorted(got) == [1, 2, 3]          # without a feature, or an entity, a row cannot be scored
    assert got[1]["f_x_value"] == 2.0 and got[1]["label"] == 0.0           # outside the range of its entity
    assert got[2]["f_s_value"] == 3.0                                      # index 3, where its entity has 0 and 1
    assert got[3]["f_x_value"] == 0.5                                      # by the ranges of all training rows
    assert {r["timestamp"] for r in fz.apply(new, unseen_entities="skip").frame.collect()} == {1, 2}
    assert {r["timestamp"] for r in fz.apply(new, unseen_values="skip").frame.collect()} == {1, 3}
    assert max(r["f_x_value"] for r in fz.apply(new, clamp=True).expanded().collect()) == 1.0
    with pytest.raises(Exception, match="training has not seen"):
        fz.apply(new, unseen_values="error").frame.collect()
    with pytest.raises(ValueError, match="unseen"):
        fz.apply(new, unseen_values="guess")
    with pytest.raises(ValueError, match="x_value"):
        fz.apply(new.drop("x_value"))
    bare = fz.apply(new.drop("y_status"), labelled=False).frame
    assert {r["label"] for r in bare.collect()} == {None} and bare.count() == 3
    assert fz.apply(new.where("false")).frame.count() == 0


def test_helper_names_in_the_users_frame(spark, rows):
    names = ["_entity", "_known", "_low0", "_high0", "_value", "_index", "_lookup_key", "_hot_key", "_n", "_x0", "_y", "label", "features"]
    wide = rows.select("*", *[F.lit(float(i)).alias(c) for i, c in enumerate(names)])
    fz = fit_featuriser(wide, "y_status")
    keep = tuple(c for c in names if c not in ("label", "features"))
    got = fz.apply(wide, keep=keep, force_shuffle=True).frame
    assert [got.first()[c] for c in keep] == [float(names.index(c)) for c in keep] and got.count() == 120
    assert spare_names(wide, "n", "entity", also=("_entity_1",)) == ["_n_1", "_entity_2"]


def test_stored_models_serve_with_their_own_featuriser(spark, rows, tmp_path):
    grid = {"regression": {"linear": lambda e, n: _grid(e, {"regParam": [0.0]}), "decision_tree": lambda e, n: _grid(e, {"maxDepth": [3]})}}
    config = jobs.JobConfig(train=train.TrainConfig(grid=grid), registry_root=str(tmp_path / "r"))
    first = jobs.train_for(rows, "regression", "y", ["linear"], config)
    later = rows.withColumn("x_value", F.col("x_value") + 1000).withColumn("timestamp", F.col("timestamp") + 1000)
    second = jobs.train_for(later, "regression", "y", ["linear", "decision_tree"], config, force_train=False)
    assert [t.family for t in second.trained] == ["decision_tree"] and not second.failures
    assert second.featurisers["linear"].path == first.featurisers["linear"].path != second.featurisers["decision_tree"].path
    served = jobs.serve_for(rows, "regression", "y", ["linear"], config, keep=("s_value",), labelled=True)
    assert served.columns == ["ado_id", "timestamp", "s_value", "model", "label", "prediction"] and served.count() == 120
    want = first.models["linear"].transform(first.featurisers["linear"].apply(rows).frame)
    assert (sorted(round(r[0], 9) for r in served.select("prediction").collect())
            == sorted(round(r[0], 9) for r in want.select("prediction").collect()))
    both = jobs.serve_for(rows.drop("y_value"), "regression", "y", ["linear", "decision_tree"], config)
    assert {r["model"]: r["count"] for r in both.groupBy("model").count().collect()} == {"linear": 120, "decision_tree": 120}
    assert ModelRegistry(spark, config.registry_root).list_models().count() == 2
    with pytest.raises(KeyError, match="glm"):
        jobs.serve_for(rows, "regression", "y", ["glm"], config)


def test_the_evaluation_fits_on_its_training_part(spark, rows):
    """Test rows far outside change the metrics, not the models."""
    config = jobs.JobConfig(train=train.TrainConfig(grid="smoke"))
    early = rows.where("timestamp <= 90")
    far = rows.where("timestamp > 90").withColumn("x_value", F.col("x_value") * 1e6)
    a = jobs.evaluate_regression_for(rows, "y", 90, config=config, families=["decision_tree"]).first()
    b = jobs.evaluate_regression_for(early.unionByName(far), "y", 90, config=config, families=["decision_tree"]).first()
    assert a.n_rows == b.n_rows == 29 and a.mse < 30 < b.mse


def test_rows_that_are_read_once_are_not_stored(spark, rows, monkeypatch):
    """Without string columns the ranges are all there is to learn: one pass, straight from the source."""
    kept = []
    plain = featuriser.stored
    monkeypatch.setattr(featuriser, "stored", lambda df, name: kept.append(name) or plain(df, name))
    with_strings = fit_featuriser(rows, "y_value")
    assert kept == ["featuriser-rows"] and with_strings.strings
    fz = fit_featuriser(rows.drop("s_value"), "y_value")
    assert kept == ["featuriser-rows"] and not fz.strings
    at, same = with_strings.feature_names, [with_strings.overall[with_strings.feature_names.index(c)] for c in fz.feature_names]
    assert "s_value" in at and fz.overall == same
