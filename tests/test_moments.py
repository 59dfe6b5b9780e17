"""Deviations by exact sums: equal bit for bit under any partitioning, and right."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from obsguard.operators.entity import entity_stddev
from obsguard.operators.inject import SuspectInjector
from obsguard.operators.moments import entity_stddev_exact, exact_stddev
from obsguard.sources import fixtures

ATTRS = ["li_ua_quantity", "li_ua_price", "li_ua_linenumber"]


def _bits(df):
    return sorted(tuple(struct.pack(">d", v) if isinstance(v, float) else v for v in r) for r in df.collect())


def _cuts(df):
    """Five partitionings of the same rows, in different orders."""
    return [df.coalesce(1), df.repartition(3), df.repartition(7, F.rand(1)), df.orderBy(F.rand(2)), df.repartition(16, "li_ua_price_value")]


def test_five_partitionings_give_the_same_bits(spark, sf_small):
    o = fixtures.obs(spark, sf_small).withColumn("ado_id", F.pmod(F.col("ado_id").cast("int"), F.lit(3)).cast("string")).cache()
    got = [_bits(entity_stddev_exact(d, ATTRS)) for d in _cuts(o)]
    assert len(got[0]) == 3 and all(g == got[0] for g in got[1:])
    near = {r[0]: r for r in entity_stddev(o, ATTRS).collect()}
    for r in entity_stddev_exact(o, ATTRS).collect():
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(r[1:], near[r[0]][1:], strict=True))


def test_the_injector_repeats_bit_for_bit(spark, sf_small):
    o = fixtures.obs(spark, sf_small).withColumn("ado_id", F.lit("one")).cache()
    inject = SuspectInjector(ratio=0.5, magnitude=2.0, key_cols=["obs_key"], exact=True)
    got = [_bits(inject.stddev(d, ATTRS, seed=5).select("obs_key", "li_ua_price_value")) for d in _cuts(o)]
    assert all(g == got[0] for g in got[1:])


@pytest.mark.parametrize("shift,scale", [(0.0, 1.0), (1e9, 1e-3), (-5e5, 1e12), (0.0, 1e-290), (1.0, 1e290)])
def test_against_exact_fractions(spark, shift, scale):
    rnd = random.Random(3)
    values = [shift + scale * rnd.gauss(0, 1) for _ in range(500)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double").repartition(4)
    mean = sum(map(Fraction, values)) / len(values)
    want = sum((Fraction(v) - mean) ** 2 for v in values) / (len(values) - 1)
    unit = Fraction(scale)
    want = math.sqrt(want / unit / unit) * scale
    for shuffled in (False, True):
        assert math.isclose(exact_stddev(df, ["v"], "k", force_shuffle=shuffled).first()["sd_v"], want, rel_tol=1e-12)


def test_odd_groups(spark):
    rows = [("one", 1.0), ("same", 2.5), ("same", 2.5), ("nan", 1.0), ("nan", math.nan), ("inf", 1.0), ("inf", -math.inf),
            ("nulls", None), (None, 1.0), (None, 3.0), ("wide", -1.7e308), ("wide", 1.7e308), ("gap", 1.0), ("gap", None), ("gap", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.sd_v for r in exact_stddev(df, ["v"], "k").collect()}
    assert got["one"] is None and got["nulls"] is None and got["same"] == 0.0
    assert math.isnan(got["nan"]) and math.isnan(got["inf"])
    assert math.isclose(got[None], math.sqrt(2)) and math.isclose(got["gap"], math.sqrt(0.5))
    assert got["wide"] > 1.7e308
    assert exact_stddev(df.limit(0), ["v"], "k").count() == 0
    counts = {r.k: r._n for r in exact_stddev(df, ["v"], "k", with_count=True).collect()}
    assert counts["gap"] == 3 and counts["nulls"] == 1


def test_names_of_its_own_may_be_columns(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 9.0)], "key string, x0 double, n0 double")
    assert exact_stddev(df, ["n0", "x0"], "key").columns == ["key", "sd_n0", "sd_x0"]
    assert math.isclose(exact_stddev(df, ["n0", "x0"], "key").first()["sd_x0"], math.sqrt(0.5))
