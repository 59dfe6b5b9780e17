import math

import pytest
from pyspark.ml.feature import MinMaxScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from obsguard.functions.exprs import binarize_status, trunc_to_int
from obsguard.operators import features
from obsguard.plans.labelled import transform_rows


def java_binarize(v):
    iv = 0 if math.isnan(v) else max(min(int(v), 2 ** 31 - 1), -(2 ** 31))
    return 0.0 if ((iv & -65) == 2 or iv >= 128) else 1.0


def test_binarize_matches_java_rule(spark):
    vals = [-1.0, 0.0, 1.0, 2.0, 2.7, 3.0, 64.0, 66.0, 66.5, 67.0, 127.0, 128.0, 130.0, 1e12, float("nan"), -1e12]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(binarize_status("v")).collect()]
    assert got == [java_binarize(v) for v in vals]


def test_trunc_to_int_saturates(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,), (1e12,), (-1e12,), (float("nan"),)], "v double")
    got = [r[0] for r in df.select(trunc_to_int("v")).collect()]
    assert got == [1, -1, 2 ** 31 - 1, -(2 ** 31), 0]


def test_frequency_index_matches_string_indexer(spark):
    words = ["b"] * 5 + ["a"] * 5 + ["c"] * 7 + ["d"] + [None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "k int, w string").repartition(3)
    ours = {r["k"]: r["w"] for r in features.index_column(df, "w").collect()}
    model = StringIndexer(inputCol="w", outputCol="i", handleInvalid="skip").fit(df)
    ref = {r["k"]: r["i"] for r in model.transform(df).collect()}
    assert ours == ref
    assert features.index_column(df, "w").columns == ["k", "w"]


def test_frequency_index_many_values_across_partitions(spark):
    df = spark.range(0, 3000, numPartitions=5).select(
        F.col("id"), (F.col("id") % 997).cast("string").alias("w"))
    table, _ = features.frequency_index_table(df, "w")
    rows = table.collect()
    idx = sorted(r["_idx"] for r in rows)
    assert idx == [float(i) for i in range(997)]
    # most frequent values first (ids 0..8 of 997 occur 4 times), ties by value
    top = sorted(rows, key=lambda r: r["_idx"])[:3]
    assert [r["w"] for r in top] == sorted([str(i) for i in range(9)])[:3]


def test_entity_scaling_matches_mllib_chain(spark):
    rows = [("a", float(i), float(i * i % 7), 5.0) for i in range(12)] + [("b", 3.0, 1.0, 2.0), ("c", 1.0, 2.0, 3.0),
                                                                        ("c", 4.0, 2.0, 3.5)]
    df = spark.createDataFrame(rows, "ado_id string, x double, y double, z double")
    feats = ["x", "y", "z"]
    ours = features.scale_by_entity(df, feats).collect()
    got = {}
    for r in ours:
        got.setdefault(r["ado_id"], []).append((r["x"], r["y"], r["z"]))
    for ent in ["a", "b", "c"]:
        part = VectorAssembler(inputCols=feats, outputCol="f").transform(df.where(F.col("ado_id") == ent))
        s = StandardScaler(inputCol="f", outputCol="s", withMean=False, withStd=True).fit(part).transform(part)
        m = MinMaxScaler(inputCol="s", outputCol="m").fit(s).transform(s)
        ref = sorted(tuple(round(v, 9) for v in r["m"]) for r in m.select(vector_to_array("m").alias("m")).collect())
        mine = sorted(tuple(round(v, 9) for v in t) for t in got[ent])
        assert mine == ref, ent


def test_labelled_plan_single_entity_not_scaled(spark):
    rows = [("a", i, float(i), i % 3, "x" if i % 2 else "y") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, q_value double, q_status int, f_value string")
    lp = transform_rows(df, "q_status", 0.0)
    assert not lp.scaled
    assert lp.feature_names == ["q_value", "f_value"]
    out = lp.expanded().orderBy("timestamp").collect()
    assert [r["f_q_value"] for r in out] == [float(i) for i in range(1, 9)]
    assert [r["label"] for r in out] == [java_binarize(float(i % 3)) for i in range(1, 9)]


def test_labelled_plan_label_guards(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("b", 2, 2.0, 3.0)],
                               "ado_id string, timestamp long, x_value double, y_value double")
    with pytest.raises(ValueError, match="not a column"):
        transform_rows(df, "nope_value")
    with pytest.raises(ValueError, match="null ratio"):
        transform_rows(df, "y_value", 0.0)
    const = spark.createDataFrame([("a", 1, 1.0, 2.0), ("b", 2, 1.0, 3.0)],
                                  "ado_id string, timestamp long, x_value double, y_value double")
    with pytest.raises(ValueError, match="zero standard deviation"):
        transform_rows(const, "x_value", 0.0)


def test_single_column_mode_rejects_string_label(spark):
    df = spark.createDataFrame([("a", 1, "u"), ("b", 2, "v")], "ado_id string, timestamp long, s_value string")
    with pytest.raises(ValueError, match="holds strings"):
        transform_rows(df, "s_value", 0.0, features="time")


def test_guarded_string_cast_equals_try_cast(spark):
    from obsguard.functions.exprs import to_double
    from pyspark.sql import types as T

    vals = ["1", " 2.5", "-3e2", "+4", ".5", "NaN", "nan", "-Infinity", "inf", "+inf", "Infinity", "0x1p3", "1d",
            "N", "Na", "in", "A", "R", "", "  ", "\t7", "x1", "1x", None, "ñ", "　1"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = df.select(to_double("s", T.StringType()).alias("a"), F.col("s").try_cast("double").alias("b")).collect()
    for (a, b), v in zip(got, vals):
        assert (a == b) or (a != a and b != b), v


def test_salted_join_equals_broadcast_join(spark):
    """Without broadcast, a hot entity (a third of all rows) is split over salts; results are unchanged."""
    from obsguard.operators.joins import hot_keys, lookup_join

    rows = [("hot", float(i), float(i % 13)) for i in range(600)] + \
           [(f"e{i % 40}", float(i), float(i % 7)) for i in range(1200)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "ado_id string, timestamp double, x double")
    ref = sorted(features.scale_by_entity(df, ["x"]).collect(), key=repr)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(features.scale_by_entity(df, ["x"]).collect(), key=repr)
        stats = df.groupBy("ado_id").agg(F.count(F.lit(1)).alias("_n"))
        hot = {r["ado_id"]: r["_salts"] for r in hot_keys(stats, "ado_id").collect()}
        idx = sorted(features.index_column(df.withColumn("w", F.col("ado_id")), "w").collect(), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == ref
    assert set(hot) == {"hot"} and hot["hot"] >= 2
    ref_idx = sorted(features.index_column(df.withColumn("w", F.col("ado_id")), "w").collect(), key=repr)
    assert idx == ref_idx


def test_scaled_features_in_unit_interval(spark, sf_small):
    from obsguard.sources import fixtures

    o = fixtures.obs(spark, sf_small).drop("obs_key")
    lp = transform_rows(o, "li_ua_quantity_status", 0.0, "all")
    wide = lp.expanded()
    feats = [c for c in wide.columns if c.startswith("f_")]
    r = wide.agg(*[F.min(c).alias("mn_" + c) for c in feats], *[F.max(c).alias("mx_" + c) for c in feats]).first()
    for c in feats:
        assert 0.0 <= r["mn_" + c] <= r["mx_" + c] <= 1.0, c
    assert lp.scaled


def test_unparsable_string_status_rows_are_dropped(spark):
    rows = [("a", 1, 1.0, "2"), ("a", 2, 2.0, "oops"), ("b", 3, 3.0, "0"), ("b", 4, 4.0, "66")]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, x_value double, x_status string")
    out = transform_rows(df, "x_status", 0.0).expanded().orderBy("timestamp").collect()
    assert [r["timestamp"] for r in out] == [1.0, 3.0, 4.0]
    assert [r["label"] for r in out] == [0.0, 1.0, 0.0]


def test_sort_by_time_spreads_a_hot_key(spark):
    rows = [("hot", 5, float(i)) for i in range(400)] + [("b", t, 1.0) for t in range(100)]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, x double").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sorted_df = features.sort_by_time(df)
        parts = sorted_df.select(F.spark_partition_id().alias("p"), "timestamp", "ado_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    hot_parts = {r["p"] for r in parts if r["ado_id"] == "hot"}
    assert len(hot_parts) > 1
    times = [r["timestamp"] for r in sorted_df.collect()]
    assert times == sorted(times)
