"""Frames that are not shaped like the fixtures: odd names, time types, bursts, hot keys, many string columns."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsguard.operators import clean, columns, entity, features, split
from obsguard.operators.inject import SuspectInjector
from obsguard.plans.labelled import transform_rows

MARKET = ["re_ua_high", "re_ua_low", "re_ua_open", "re_ua_close2", "re_ua_ask", "re_ua_bid", "re_ua_mid"]


@pytest.mark.parametrize("mode", ["stddev", "zeroes", "negatives", "hilo", "ask_bid_mid"])
def test_injectors_keep_exactly_the_input_columns(spark, mode):
    base = spark.range(40).select(
        F.concat(F.lit("e"), F.col("id") % 2).alias("ado_id"), F.col("id").alias("timestamp"), F.lit(1).alias("__batch"),
        F.lit(2).alias("_hit"), F.lit(3).alias("_u"), F.lit(4).alias("_lo"), F.lit(5).alias("sd_re_ua_ask_value"),
        F.lit("x").alias("_n"), *[(F.col("id") * 1.5 + i).alias(f"{a}_value") for i, a in enumerate(MARKET)],
        *[F.lit(0).alias(f"{a}_status") for a in MARKET])
    inj = SuspectInjector(ratio=0.5)
    args = [MARKET, 3] if mode in ("stddev", "zeroes", "negatives") else [3]
    out = getattr(inj, mode)(base, *args)
    assert out.columns == base.columns and out.dtypes == base.dtypes
    rows = out.collect()
    assert len(rows) == 40 and {(r["__batch"], r["_hit"], r["_u"], r["_lo"], r["_n"]) for r in rows} == {(1, 2, 3, 4, "x")}
    assert 5 < sum(any(r[f"{a}_status"] == 2 for a in MARKET) for r in rows) < 36


def test_a_burst_of_equal_rows_draws_by_row(spark):
    burst = spark.range(10_000, numPartitions=7).select(F.lit("e").alias("ado_id"), F.lit(5).alias("timestamp"),
                                                       F.lit(1.0).alias("x_value"), F.lit(0).alias("x_status"))
    hits = SuspectInjector(ratio=0.25).zeroes(burst, ["x"], 1).where("x_status = 2").count()
    assert abs(hits - 2500) <= 4 * (10_000 * 0.25 * 0.75) ** 0.5
    parts = [p.count() for p in split.hash_split(burst, [0.8, 0.2], 1)]
    assert sum(parts) == 10_000 and abs(parts[0] - 8000) <= 4 * (10_000 * 0.8 * 0.2) ** 0.5


def test_key_parts_cannot_be_forged(spark):
    from obsguard.functions.exprs import md5_hex

    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "c"), ("c", None), ("~", "c")], "x string, y string")
    assert df.select(md5_hex(["x", "y"], 1, "m").alias("d")).distinct().count() == 5


TIMES = [0, 1, 86_399_999, 86_400_000, 946_598_400_000, 946_598_400_001, -1, -86_400_000]


@pytest.mark.parametrize("kind", ["bigint", "timestamp", "timestamp_ntz", "date"])
def test_time_types_agree(spark, kind):
    ms = F.col("ms")
    as_kind = {"bigint": ms, "timestamp": F.timestamp_millis(ms),
               "timestamp_ntz": F.timestamp_millis(ms).cast("timestamp_ntz"),
               "date": F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(ms / 86_400_000).cast("int"))}[kind]
    df = spark.createDataFrame([(t, f"e{i % 2}", float(i)) for i, t in enumerate(TIMES)], "ms long, ado_id string, x_value double")
    df = df.withColumn("timestamp", as_kind)
    day = 86_400_000
    seen = {t: (t // day * day if kind == "date" else t) for t in TIMES}
    for bound in (0, 86_400_000, 946_598_400_000, -1):
        assert sorted(r.ms for r in clean.as_of(df, bound).collect()) == sorted(t for t in TIMES if seen[t] <= bound)
        early, late = split.split_by_date(df, bound)
        assert sorted(r.ms for r in late.collect()) == sorted(t for t in TIMES if seen[t] > bound)
        assert early.count() + late.count() == len(TIMES)
    lp = transform_rows(df.drop("ms"), "x_value", features="time", scale=False).expanded()
    assert sorted(r["timestamp"] for r in lp.collect()) == sorted(float(v) for v in seen.values())


def test_the_as_of_bound_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select(F.timestamp_millis(F.col("id") * 1000).alias("timestamp")).write.parquet(path)
    plan = clean.as_of(spark.read.parquet(path), 5000)._jdf.queryExecution().toString()
    assert "LessThan(timestamp" in plan


def _largest_share(df, partitions=8):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) * partitions / sum(counts)


@pytest.mark.parametrize("kind", ["null entity", "equal rows", "null stddev"])
def test_hot_keys_are_split_without_adaptive_execution(spark, kind):
    hot = {"null entity": F.lit(None).cast("string"), "equal rows": F.lit("hot"), "null stddev": F.lit("hot")}[kind]
    value = F.lit(1.0) if kind == "equal rows" else F.lit(None).cast("double") if kind == "null stddev" else F.rand(1)
    rows = spark.range(40_000, numPartitions=16).select(hot.alias("ado_id"), value.alias("x_value")).unionByName(
        spark.range(20_000, numPartitions=8).select((F.col("id") % 500).cast("string").alias("ado_id"), F.rand(2).alias("x_value")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stats = entity.entity_stddev(rows, ["x"], require_all=True, with_count=True)
        joined = entity.join_entity_stats(rows, stats, force_shuffle=True)
        assert joined.count() == 60_000
        assert _largest_share(joined) <= 2
        if kind == "equal rows":
            indexed = features.index_strings(rows.select(F.col("ado_id").alias("w_value")), force_shuffle=True)
            assert indexed.count() == 60_000 and _largest_share(indexed) <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_statistics_without_counts_are_salted_too(spark):
    rows = spark.range(9000, numPartitions=9).select(F.lit(None).cast("string").alias("ado_id"), F.col("id").cast("double").alias("x_value"))
    stats = entity.entity_stddev(rows, ["x"])
    got = entity.join_entity_stats(rows, stats, force_shuffle=True)
    assert got.columns == ["ado_id", "x_value", "sd_x_value"]
    assert got.where("sd_x_value is not null").count() == 9000


def test_string_index_jobs_do_not_grow_with_the_columns(spark):
    df = spark.range(200).select(F.col("id"), *[F.concat(F.lit(c), F.col("id") % n).alias(f"{c}_value")
                                              for c, n in (("a", 3), ("b", 5), ("c", 7))])

    def jobs(cols):
        group = f"index-{len(cols)}"
        sc = spark.sparkContext
        sc.setJobGroup(group, group)
        try:
            features.index_strings(df.select("id", *cols)).write.format("noop").mode("overwrite").save()
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    one, three = jobs(["a_value"]), jobs(["a_value", "b_value", "c_value"])
    assert three <= one + 3     # the joins' broadcasts; counts and ranks are shared


def test_indexing_several_columns_equals_one_by_one(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "q"), (4, "y", "q"), (5, "x", None)],
                               "k int, a_value string, b_value string")
    got = {r.k: (r.a_value, r.b_value) for r in features.index_strings(df).collect()}
    assert got == {1: (0.0, 1.0), 2: (0.0, 0.0), 3: (1.0, 0.0), 4: (1.0, 0.0)}


def test_status_lookup_is_exact_unless_legacy(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0, 2)], "li_ua_quantity_value double, li_ua_quality_value double, "
                                                   "li_ua_quantity_status int, li_ua_quality_status int")
    assert columns.filter_on_type(df, "double").columns[2:] == ["li_ua_quantity_status", "li_ua_quality_status"]
    assert columns.filter_on_type(df, "double", legacy_prefix=True).columns[2:] == ["li_ua_quantity_status"]


def test_describe_gives_the_ends_of_strings(spark):
    df = spark.createDataFrame([("R", 1.0, "3"), ("A", None, "12"), (None, 4.0, "x")], "s string, d double, n string")
    got = {r.column_name: r for r in clean.describe_columns(df).collect()}
    ref = {r["summary"]: r for r in df.describe().collect()}
    assert [got["s"].min_text, got["s"].max_text] == [ref["min"]["s"], ref["max"]["s"]]
    assert [got["n"].min_text, got["n"].max_text, got["n"].mean] == [ref["min"]["n"], ref["max"]["n"], float(ref["mean"]["n"])]
    assert (got["d"].min, got["d"].max, got["d"].min_text) == (1.0, 4.0, None)


def test_unparsed_labels_are_counted_and_kept_columns_travel(spark):
    rows = [("a", 1, 1.0, "2", "k1"), ("a", 2, 2.0, "oops", "k2"), ("b", 3, 3.0, "0", None), ("b", 4, 4.0, "66", "k4")]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, x_value double, x_status string, key string")
    lp = transform_rows(df, "x_status", 0.0, keep=("key",))
    assert lp.dropped_labels == 1 and lp.feature_names == ["x_value"]
    assert sorted((r.key or "") for r in lp.frame.collect()) == ["", "k1", "k4"]
    assert isinstance(lp.frame.schema["key"].dataType, T.StringType)


def test_the_sort_is_asked_for_and_total(spark):
    df = spark.createDataFrame([("b", 2, 1.0), ("a", 2, 2.0), ("a", 1, 3.0), ("c", 3, 4.0)], "ado_id string, timestamp long, x_value double")
    lp = transform_rows(df, "x_value", features="time", scale=False, sort=True)
    assert [(r.timestamp, r.ado_id) for r in lp.frame.collect()] == [(1.0, "a"), (2.0, "a"), (2.0, "b"), (3.0, "c")]
