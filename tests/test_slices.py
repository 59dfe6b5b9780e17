"""Profiles merged from slices equal those of the whole table."""

import math

import pytest
from pyspark.sql import functions as F

from obsguard.operators import clean, slices
from obsguard.session import ensure_checkpoint_dir
from obsguard.sources import fixtures

SCHEMA = "ado_id string, timestamp long, a_value double, b_value string, c_value double, d_status int"


@pytest.fixture
def store(spark, tmp_path):
    ensure_checkpoint_dir(spark)
    return slices.ProfileStore(spark, str(tmp_path / "stats"))


def _rows(df):
    return sorted(df.collect(), key=lambda r: r["column_name"])


def _same(a, b, digits=9):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        for c in x.asDict():
            if isinstance(x[c], float) and isinstance(y[c], float):
                assert math.isclose(x[c], y[c], rel_tol=10.0**-digits, abs_tol=1e-12) or (x[c] != x[c] and y[c] != y[c])
            else:
                assert x[c] == y[c], (c, x, y)


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.5])
def test_merged_slices_equal_the_whole_table(spark, store, sf_small, threshold):
    whole = fixtures.obs(spark, sf_small)
    month = F.month(F.timestamp_millis("timestamp"))
    for m in range(0, 12, 3):
        store.add(str(m), whole.where((month > m) & (month <= m + 3)))
    _same(_rows(slices.profile_of(store.merged(), threshold)), _rows(clean.profile_columns(whole, threshold)))
    numeric = [c for c, t in whole.dtypes if t in ("int", "bigint", "double")]
    want = _rows(clean.describe_columns(whole, numeric).select("column_name", "count", "mean", "stddev", "min", "max"))
    _same([r for r in _rows(slices.describe_of(store.merged())) if r["column_name"] in numeric], want)
    a, b = store.profile(threshold), clean.compute_profile(whole, threshold)
    assert (a.row_count, a.null_counts, a.zero_deviation, sorted(a.null_heavy), a.multiple_entities) == (
        b.row_count, b.null_counts, b.zero_deviation, sorted(b.null_heavy), b.multiple_entities)


def test_odd_slices(spark, store):
    """Constant in each slice but not overall, an empty slice, infinities, texts that are numbers, null entities."""
    one = spark.createDataFrame([("e", 1, 1.0, "7", math.inf, 0), ("e", 2, 1.0, "7", math.inf, 0)], SCHEMA)
    two = spark.createDataFrame([("e", 3, 2.0, "7.0", 1.0, None), (None, 4, 2.0, "7", None, 0)], SCHEMA)
    for name, part in (("1", one), ("2", two), ("none", one.limit(0))):
        store.add(name, part)
    whole = one.unionByName(two)
    _same(_rows(slices.profile_of(store.merged(), 0.3)), _rows(clean.profile_columns(whole, 0.3)))
    a, b = store.profile(0.3), clean.compute_profile(whole, 0.3)
    assert (a.zero_deviation, a.null_heavy, a.multiple_entities) == (b.zero_deviation, b.null_heavy, b.multiple_entities) == (
        ["b_value"], [], True)


def test_a_slice_written_again_counts_once(spark, store):
    first = spark.createDataFrame([("e", 1, 1.0, "7", 1.0, 0)] * 3, SCHEMA)
    again = spark.createDataFrame([("e", 1, 5.0, None, 1.0, 0)] * 2, SCHEMA)
    store.add("day", first)
    store.add("day", again)
    assert store.profile().row_count == 2
    assert _rows(slices.profile_of(store.merged())) == _rows(clean.profile_columns(again))


def test_a_column_that_comes_later_is_null_before(spark, store):
    rows = [("e", 1, 1.0, "7", 1.0, 0)] * 4
    store.add("old", spark.createDataFrame(rows, SCHEMA).drop("c_value"))
    store.add("new", spark.createDataFrame(rows, SCHEMA))
    got = {r["column_name"]: r for r in slices.profile_of(store.merged(), 0.2).collect()}
    assert got["c_value"]["null_count"] == 4 and got["c_value"]["row_count"] == 8 and got["c_value"]["dropped"] == 1


def test_an_empty_store(store):
    assert store.profile().row_count == 0 and store.merged().count() == 0


def test_a_new_slice_reads_only_itself(spark, store, sf_small, tmp_path):
    """Merging reads the stored statistics alone: the table may be gone."""
    part = fixtures.obs(spark, sf_small).limit(50)
    part.write.parquet(str(tmp_path / "day"))
    store.add("day", spark.read.parquet(str(tmp_path / "day")))
    assert all(str(tmp_path / "stats") in f for f in store.merged().inputFiles())
