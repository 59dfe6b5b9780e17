"""Standard deviations that are the same bit for bit under any partitioning.

Spark merges floating moments in whatever order tasks end, so their last bits vary. Here every value becomes an integer first:
its place in its entity's range (least and greatest do not depend on any order) in 60 binary digits, as two halves of 30. Sums
of integers and of their products are exact, so no order can change them; one fixed formula on the exact sums gives the
deviation. A value's place is rounded once, to 2 ** -53 of it, so the result is as close to the true deviation as a double
computation in any one order.

Cost: one aggregate for the ranges, one for the sums, and between them the measured broadcast or salted join of
`joins.lookup_join`, over the entity and the asked columns alone.

Cases, as Spark's stddev_samp: fewer than two values give null, equal values 0, a NaN or an infinity among them NaN; nulls take
no part; a null entity is a group of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_finite
from ..schema import DEFAULT_SCHEMA, ObsSchema
from .joins import COUNT_COL, lookup_join, materialise_small

HALF = 30                          # binary digits of each half of a place
WHOLE = "decimal(38,0)"


def _halves(x: Column, least: Column, span: Column) -> tuple[Column, Column]:
    """The place of x in its range, in [0, 1], as a * 2 ** -30 + b * 2 ** -60 with integers a and b."""
    scaled = (x / 2 - least / 2) / span * float(1 << HALF)
    a = F.floor(scaled)
    return a, F.floor((scaled - a) * float(1 << HALF))


def _deviation(i: int) -> Column:
    """The sample deviation of places times the range, from the exact sums of column i."""
    def s(name: str) -> Column:
        return F.col(f"{name}{i}").cast(WHOLE)

    n = F.col(f"n{i}")
    mean = F.floor(s("a") / n).cast(WHOLE)             # of the upper halves: what is left of them is small
    aa = s("aa") - (mean * s("a")).cast(WHOLE) * 2 + (mean * mean).cast(WHOLE) * n.cast(WHOLE)
    ab = s("ab") - (mean * s("b")).cast(WHOLE)
    total = (s("a") - (mean * n.cast(WHOLE)).cast(WHOLE)).cast("double") + s("b").cast("double") / float(1 << HALF)
    squares = (aa.cast("double") + 2 * ab.cast("double") / float(1 << HALF)
               + s("bb").cast("double") / float(1 << HALF) / float(1 << HALF))
    var = (squares - total * total / n) / (n - 1)
    return F.sqrt(F.greatest(var, F.lit(0.0))) / float(1 << HALF) * F.col(f"span{i}") * 2


def exact_stddev(df: DataFrame, columns: list[str], key: str, with_count: bool = False,
                 force_shuffle: bool = False) -> DataFrame:
    """(key, sd_<column> for each column): sample deviations per key; `with_count` adds the rows of each key."""
    x = {i: F.col(f"x{i}") for i in range(len(columns))}
    narrow = df.select(F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    ranges = [F.count(F.lit(1)).alias(COUNT_COL)]
    for i in x:
        ranges += [F.count(x[i]).alias(f"n{i}"), F.count(F.when(~is_finite(x[i]), 1)).alias(f"odd{i}"),
                   F.min(x[i]).alias(f"least{i}"), (F.max(x[i]) / 2 - F.min(x[i]) / 2).alias(f"span{i}")]
    per_key, small = materialise_small(narrow.groupBy("k").agg(*ranges))
    bounds = per_key.select(F.col("k").alias("key"), COUNT_COL, *[f"{c}{i}" for i in x for c in ("least", "span", "odd")])
    placed = lookup_join(narrow, bounds, "k", "key", how="inner", may_broadcast=small and not force_shuffle)
    halves, sums = [], []
    for i in x:
        use = x[i].isNotNull() & (F.col(f"odd{i}") == 0) & (F.col(f"span{i}") > 0)
        a, b = _halves(x[i], F.col(f"least{i}"), F.col(f"span{i}"))
        halves += [F.when(use, a).alias(f"a{i}"), F.when(use, b).alias(f"b{i}")]
        up, low = F.col(f"a{i}"), F.col(f"b{i}")
        for name, v in (("a", up), ("b", low), ("aa", up * up), ("ab", up * low), ("bb", low * low)):
            sums.append(F.sum(v.cast("decimal(20,0)")).alias(f"{name}{i}"))       # products stay below 2 ** 61
    totals = placed.select("k", *halves).groupBy(F.col("k").alias("key")).agg(*sums)
    both = per_key.join(totals, F.col("k").eqNullSafe(F.col("key")), "left")
    out = [F.col("k").alias(key)]
    for i, c in enumerate(columns):
        sd = (F.when(F.col(f"n{i}") < 2, None).when(F.col(f"odd{i}") > 0, F.lit(float("nan")))
              .when(F.col(f"span{i}") == 0, F.lit(0.0)).otherwise(_deviation(i)))
        out.append(sd.cast("double").alias(f"sd_{c}"))
    return both.select(*out, *([COUNT_COL] if with_count else []))


def entity_stddev_exact(df: DataFrame, attributes, schema: ObsSchema = DEFAULT_SCHEMA, require_all: bool = True,
                        with_count: bool = False) -> DataFrame:
    """`entity.entity_stddev` by exact sums: the same columns and the same rule for `require_all` and `with_count`."""
    cols = [schema.value_col(a) for a in attributes]
    out = exact_stddev(df, cols, schema.id_col, with_count)
    if not (require_all and cols):
        return out
    every = F.col(f"`sd_{cols[0]}`").isNotNull()
    for c in cols[1:]:
        every = every & F.col(f"`sd_{c}`").isNotNull()
    if not with_count:
        return out.where(every)
    return out.select(schema.id_col, *[F.when(every, F.col(f"`sd_{c}`")).alias(f"sd_{c}") for c in cols], COUNT_COL)
