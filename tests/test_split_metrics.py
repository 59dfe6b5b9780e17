import math

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.mllib.evaluation import BinaryClassificationMetrics, MulticlassMetrics
from pyspark.sql import functions as F

from obsguard.functions.metrics import classification_report, confusion_matrix, regression_report
from obsguard.operators import split
from obsguard.sources import fixtures


def test_split_by_date_disjoint_and_complete(spark, sf_small):
    o = fixtures.obs(spark, sf_small)
    a, b = split.split_by_date(o, 915148800000)
    assert a.count() + b.count() == o.count()
    assert a.join(b, ["obs_key", "timestamp"]).count() == 0  # obs_key alone repeats once at sf0.001


def test_hash_split_reproducible(spark, sf_small):
    o = fixtures.obs(spark, sf_small)
    p1 = split.hash_split(o, [0.7, 0.3], 9, key_cols=["obs_key"])
    p2 = split.hash_split(o.repartition(13), [0.7, 0.3], 9, key_cols=["obs_key"])
    k1 = sorted(r[0] for r in p1[1].select("obs_key").collect())
    k2 = sorted(r[0] for r in p2[1].select("obs_key").collect())
    assert k1 == k2
    assert p1[0].count() + p1[1].count() == o.count()
    assert abs(p1[1].count() / o.count() - 0.3) < 0.05


def _pairs(spark, tp, fp, fn, tn, positive=0.0):
    neg = 1.0 - positive
    rows = ([(positive, positive)] * tp + [(neg, positive)] * fp + [(positive, neg)] * fn + [(neg, neg)] * tn)
    return spark.createDataFrame([("m", l, p) for l, p in rows], "model string, label double, prediction double")


def _mllib(df):
    rdd = df.select(F.col("prediction"), F.col("label")).rdd.map(lambda r: (float(r[0]), float(r[1])))
    return MulticlassMetrics(rdd), BinaryClassificationMetrics(rdd)


def test_classification_matches_mllib(spark):
    for counts in [(30, 10, 5, 55), (3, 0, 7, 40), (0, 0, 9, 31), (12, 30, 0, 0)]:
        df = _pairs(spark, *counts)
        r = classification_report(df).first()
        mm, bm = _mllib(df)
        assert math.isclose(r["accuracy"], mm.accuracy, abs_tol=1e-12)
        if counts[0] + counts[2] > 0:
            assert math.isclose(r["precision"], mm.precision(0.0), abs_tol=1e-12)
            assert math.isclose(r["true_positive_rate"], mm.truePositiveRate(0.0), abs_tol=1e-12)
            assert math.isclose(r["f1"], mm.fMeasure(0.0), abs_tol=1e-12)
            if counts[1] + counts[3] > 0:
                assert math.isclose(r["false_positive_rate"], mm.falsePositiveRate(0.0), abs_tol=1e-12)
        assert math.isclose(r["area_under_roc"], bm.areaUnderROC, abs_tol=1e-9), counts
        assert math.isclose(r["area_under_pr"], bm.areaUnderPR, abs_tol=1e-9), counts


def test_legacy_swap_reproduces_old_numbers(spark):
    df = _pairs(spark, 30, 10, 5, 55)
    r = classification_report(df, legacy_swap=True).first()
    assert math.isclose(r["precision"], 30 / 35) and math.isclose(r["true_positive_rate"], 30 / 40)


def test_confusion_matrix_counts(spark):
    df = _pairs(spark, 3, 2, 1, 4)
    got = {(r["label"], r["prediction"]): r["n"] for r in confusion_matrix(df).collect()}
    assert got == {(0.0, 0.0): 3, (1.0, 0.0): 2, (0.0, 1.0): 1, (1.0, 1.0): 4}


def test_regression_matches_evaluator(spark, sf_small):
    p = fixtures.pred(spark, sf_small).where(F.col("model") == "rule_a").select(
        F.col("y").alias("label"), F.col("y_hat").alias("prediction"))
    r = regression_report(p, group_by=()).first()
    for m in ("mse", "rmse", "r2", "mae"):
        ref = RegressionEvaluator(metricName=m).evaluate(p)
        assert math.isclose(r[m], ref, rel_tol=1e-9), m


def test_fixture_time_is_zone_independent(spark, sf_small):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ny = fixtures.obs(spark, sf_small).agg(F.sum("timestamp"), F.min("timestamp")).first()
        ev_ny = fixtures.events_obs(spark, sf_small).agg(F.sum("timestamp")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    utc = fixtures.obs(spark, sf_small).agg(F.sum("timestamp"), F.min("timestamp")).first()
    ev_utc = fixtures.events_obs(spark, sf_small).agg(F.sum("timestamp")).first()
    assert tuple(ny) == tuple(utc) and tuple(ev_ny) == tuple(ev_utc)
    assert utc[1] == 789004800000  # 1995-01-02T00:00:00Z, the earliest ship date at sf0.001


def test_tag_split_equals_hash_split(spark, sf_small):
    o = fixtures.obs(spark, sf_small).select("obs_key", "timestamp")
    w = [0.5, 0.3, 0.2]
    parts = split.hash_split(o, w, 11, key_cols=["obs_key", "timestamp"])
    tagged = split.tag_split(o, w, 11, key_cols=["obs_key", "timestamp"])
    for i, p in enumerate(parts):
        a = sorted((r[0], r[1]) for r in p.collect())
        b = sorted((r[0], r[1]) for r in tagged.where(F.col("part") == i).select("obs_key", "timestamp").collect())
        assert a == b
