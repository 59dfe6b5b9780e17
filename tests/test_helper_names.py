"""Columns named like helpers are neither lost nor in the way; metrics and nulls."""
import pytest
from pyspark.sql import functions as F

from obsguard.functions.metrics import classification_report, regression_report
from obsguard.operators import features, rank
from obsguard.operators.joins import lookup_join

NAMES = ("_k", "_mn0", "_mx0", "_hot_key", "_hot_salts", "_lookup_key", "_left_salt", "_right_salt", "_count_key", "_idx", "_key",
         "_pid", "_mid", "_n", "_value", "_index")


@pytest.fixture(scope="module")
def wide(spark):
    rows = [("a" if i % 3 else None, float(i % 7), "x" if i % 4 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "ado_id string, v double, s_value string")
    return df.select("*", *[F.lit(float(i)).alias(c) for i, c in enumerate(NAMES)])


@pytest.mark.parametrize("what", ["scale", "index", "rank", "join"])
def test_helper_names_survive(spark, wide, what):
    if what == "scale":
        out = features.scale_by_entity(wide, ["v"], force_shuffle=True)
    elif what == "index":
        out = features.index_strings(wide, force_shuffle=True)
    elif what == "rank":
        out = rank.with_global_rank(wide, "v", name="position")
    else:
        small = spark.createDataFrame([("a", 1.5), (None, 2.5)], "id string, extra double")
        out = lookup_join(wide, small, "ado_id", "id")
    assert out.count() == 60
    row = out.agg(*[F.min(c).alias(f"lo{i}") for i, c in enumerate(NAMES)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(NAMES)]).first()
    assert [row[f"lo{i}"] for i in range(len(NAMES))] == [row[f"hi{i}"] for i in range(len(NAMES))] == [float(i) for i in range(len(NAMES))]
    assert set(wide.columns) <= set(out.columns)


def test_rows_without_a_label_or_prediction_take_no_part(spark):
    rows = [("m", 0.0, 0.0), ("m", 1.0, 1.0), ("m", 1.0, 0.0), ("m", None, 0.0), ("m", 0.0, None), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "model string, label double, prediction double")
    whole = df.where("label is not null and prediction is not null")
    got = {r["model"]: r for r in classification_report(df, with_rows=True).collect()}
    want = classification_report(whole).first()
    assert got["m"].n_rows == 5 and all(got["m"][c] == want[c] for c in want.asDict())
    assert got["none"].n_rows == 1 and all(got["none"][c] is None for c in want.asDict() if c != "model")
    many = {r["model"]: r for r in regression_report(df, with_rows=True).collect()}
    want = regression_report(whole).first()
    assert many["m"].n_rows == 5 and all(many["m"][c] == want[c] for c in want.asDict()) and many["none"].mse is None
