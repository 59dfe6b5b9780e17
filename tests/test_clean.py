import math

from pyspark.sql import functions as F

from obsguard.operators import clean, columns


def test_profile_drops_constant_and_null_heavy(spark):
    rows = [("a", 1, 1.0, None, 5.0, "x"), ("a", 2, 1.0, 2.0, 6.0, "y"), ("b", 3, 1.0, 3.0, 7.0, "z")]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, k_value double, n_value double, "
                                     "v_value double, s_value string").repartition(3)
    p = clean.compute_profile(df, 0.0)
    assert p.row_count == 3
    assert p.zero_deviation == ["k_value"]
    assert p.null_heavy == ["n_value"]
    assert p.multiple_entities
    out = clean.apply_profile(df, p)
    assert out.columns == ["ado_id", "timestamp", "v_value", "s_value"]
    p2 = clean.compute_profile(df, 0.5)
    assert p2.null_heavy == []


def test_profile_edge_values(spark):
    # one value -> null stddev -> kept; NaN -> stddev NaN -> kept; numeric-looking strings -> dropped
    rows = [(1.0, float("nan"), "1", 3.0), (None, float("nan"), "A", 3.0), (None, 1.0, "1", 3.0)]
    df = spark.createDataFrame(rows, "one_value double, nan_value double, str_value string, c_status double")
    p = clean.compute_profile(df, 1.0)
    assert p.zero_deviation == ["str_value"]
    assert "c_status" not in p.zero_deviation  # only _value columns are tested for deviation


def test_profile_long_format_matches_eager(spark):
    rows = [("a", 1, 1.0, None), ("b", 2, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, k_value double, n_value double")
    long = {r["column_name"]: r for r in clean.profile_columns(df, 0.0).collect()}
    assert long["k_value"]["dropped"] == 1 and long["k_value"]["zero_deviation"] == 1
    assert long["n_value"]["dropped"] == 1 and long["n_value"]["null_count"] == 1
    assert long["ado_id"]["dropped"] == 0
    assert math.isclose(long["n_value"]["null_ratio"], 0.5)


def test_empty_frame_passes_through(spark):
    df = spark.createDataFrame([], "ado_id string, timestamp long, a_value double")
    p = clean.compute_profile(df, 0.0)
    assert p.row_count == 0 and p.to_drop == []
    assert clean.filter_incomplete_columns(df).columns == df.columns


def test_single_entity_and_null_entity(spark):
    one = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "ado_id string, timestamp long, v_value double")
    assert not clean.compute_profile(one, 1.0).multiple_entities
    with_null = spark.createDataFrame([("a", 1, 1.0), (None, 2, 2.0)], "ado_id string, timestamp long, v_value double")
    assert clean.compute_profile(with_null, 1.0).multiple_entities


def test_constant_column_over_partitions_is_dropped(spark):
    # merging partial variances can leave a tiny non-zero stddev; min = max cannot
    df = spark.range(0, 4099, numPartitions=3).select(F.lit(3.3).alias("c_value"), F.col("id").cast("double")
                                                       .alias("id_value"))
    assert clean.compute_profile(df, 0.0).zero_deviation == ["c_value"]


def test_complete_rows_keeps_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, y string")
    assert clean.complete_rows(df).count() == 2
    assert clean.complete_rows(df, ["x"]).count() == 3


def test_as_of_filters_by_any_date(spark):
    df = spark.createDataFrame([(1, 5), (2, 10)], "ado_id int, timestamp long")
    assert clean.as_of(df, None).count() == 2       # None alone means no filter
    assert clean.as_of(df, 0).count() == 0
    assert clean.as_of(df, -5).count() == 0
    assert clean.as_of(df, 5).count() == 1


def test_filter_on_type_short_names_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, 0, 2.0, 1)], "ab_value double, ab_status int, abc double, abc_status int")
    assert columns.filter_on_type_strict(df, "double").columns == ["ab_value", "abc"]
    assert columns.filter_on_type(df, "double").columns == ["ab_value", "abc", "ab_status", "abc_status"]
    out = columns.filter_on_type(df, "double", legacy_prefix=True).columns
    # the prefix of "ab_value" is the whole name, so it has no status; "abc" takes "abc_status"
    assert out == ["ab_value", "abc", "abc_status"]
    wide = spark.createDataFrame([(1.0, 0, 0)], "li_ua_quantity_value double, li_ua_qux_status int, "
                                                "li_ua_quantity_status int")
    legacy = columns.filter_on_type(wide, "double", legacy_prefix=True).columns
    assert legacy == ["li_ua_quantity_value", "li_ua_qux_status"]
    assert columns.filter_on_type(wide, "double").columns == ["li_ua_quantity_value", "li_ua_quantity_status"]
    assert columns.drop_columns(df, ["nope", "abc"]).columns == ["ab_value", "ab_status", "abc_status"]


def test_all_null_and_infinite_columns(spark):
    rows = [("a", 1, None, float("inf"), 1.0), ("b", 2, None, float("inf"), 1.0), ("c", 3, None, 5.0, 1.0)]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, z_value double, i_value double, c_value double")
    p = clean.compute_profile(df, 0.5)
    assert p.null_heavy == ["z_value"]          # all null: ratio 1 > 0.5
    assert "z_value" not in p.zero_deviation     # no values: stddev null, kept by that rule
    assert "i_value" not in p.zero_deviation     # infinite values: stddev NaN, kept
    assert p.zero_deviation == ["c_value"]


def test_one_row_frame(spark):
    from obsguard.plans.labelled import transform_rows

    df = spark.createDataFrame([("a", 5, 2.0, 66)], "ado_id string, timestamp long, x_value double, x_status int")
    p = clean.compute_profile(df, 0.0)
    assert p.row_count == 1 and p.to_drop == [] and not p.multiple_entities
    lp = transform_rows(df, "x_status", 0.0)
    rows = lp.expanded().collect()
    assert len(rows) == 1 and rows[0]["label"] == 0.0 and rows[0]["f_x_value"] == 2.0


def test_labelled_plan_empty_after_filters(spark):
    from obsguard.plans.labelled import transform_rows

    rows = [("a", 10, 1.0, 0, "u"), ("b", 20, 2.0, 2, "v"), ("a", 30, 3.0, 1, "u")]
    df = spark.createDataFrame(rows, "ado_id string, timestamp long, x_value double, x_status int, s_value string")
    lp = transform_rows(df, "x_status", 0.0, as_of_ms=5)
    assert lp.frame.count() == 0
    assert lp.frame.columns == ["ado_id", "timestamp", "label", "features"]


def test_key_column_dropped_is_an_error(spark):
    import pytest

    from obsguard.plans.labelled import transform_rows

    df = spark.createDataFrame([(None, 1, 1.0, 0), ("a", 2, 2.0, 1)], "ado_id string, timestamp long, x_value double, "
                                                                     "x_status int")
    with pytest.raises(ValueError, match="Key column 'ado_id'"):
        transform_rows(df, "x_status", 0.0)


def test_stored_profile_is_reused(spark, sf_small, tmp_path):
    from obsguard.plans.labelled import transform_rows
    from obsguard.sources import fixtures

    o = fixtures.obs(spark, sf_small).drop("obs_key")
    fresh = transform_rows(o, "li_ua_quantity_status", 0.0, sort=False)
    path = str(tmp_path / "profile")
    fresh.profile.to_frame(spark).write.parquet(path)
    stored = clean.Profile.from_frame(spark.read.parquet(path))
    assert stored.to_drop == fresh.profile.to_drop and stored.multiple_entities == fresh.profile.multiple_entities
    reused = transform_rows(o, "li_ua_quantity_status", sort=False, profile=stored)
    assert reused.feature_names == fresh.feature_names
    a = sorted(reused.expanded(9).collect(), key=repr)
    b = sorted(fresh.expanded(9).collect(), key=repr)
    assert a == b


def test_scans_by_path_format_and_table(spark, sf_small):
    from obsguard.sources.tables import load_rows, scan_all

    path = f"{sf_small}/lineitem.parquet"
    by_path = scan_all(spark, path=path, fmt="parquet", mergeSchema=False)
    assert by_path.count() == 6000
    by_path.createOrReplaceTempView("obsguard_scan_test")
    assert scan_all(spark, table="obsguard_scan_test").count() == 6000
    spark.catalog.dropTempView("obsguard_scan_test")
    from obsguard.sources.fixtures import obs_from_lineitem

    obs = obs_from_lineitem(by_path)
    one = load_rows(obs, "li_ua_price_value", single_column=True)
    assert one.columns == ["ado_id", "timestamp", "li_ua_price_value"]
    assert load_rows(obs, "li_ua_price_value", single_column=False).columns == obs.columns


def test_describe_columns_matches_spark_describe(spark, sf_small):
    import math as _m

    from obsguard.sources import fixtures

    o = fixtures.obs(spark, sf_small).select("li_ua_quantity_value", "li_ua_price_value", "li_ua_discount_value",
                                             "li_ua_linenumber_value")
    ours = {r["column_name"]: r for r in clean.describe_columns(o).collect()}
    ref = {r["summary"]: r for r in o.describe().collect()}
    for c in o.columns:
        assert ours[c]["count"] == int(ref["count"][c])
        for stat in ("mean", "stddev", "min", "max"):
            assert _m.isclose(ours[c][stat], float(ref[stat][c]), rel_tol=1e-12), (c, stat)
