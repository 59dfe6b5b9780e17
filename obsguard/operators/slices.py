"""Column statistics of a growing table, kept by slice and merged: a new day scans only itself.

A slice's statistics are one row per column whose parts add up: counts, extremes, and the mean and the sum of squared
deviations of its numbers. They are appended to a Parquet folder under the slice's name; the profile of the whole table
(null ratios, zero deviation, drop decisions, entity multiplicity) and its description come from the stored rows alone,
by one aggregate over slices x columns.

A slice may be written again (a late correction): its last version counts. Columns may come and go between slices: rows
of a slice without the column count as nulls in it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import is_finite
from ..schema import DEFAULT_SCHEMA, ObsSchema, is_numeric, is_string
from .clean import Profile, _numeric_view, _zero_dev

STATS_SCHEMA = ("column_name string, kind string, n bigint, filled bigint, numbers bigint, not_finite bigint, least double, "
                "greatest double, mean double, m2 double, least_text string, greatest_text string")


def _kind(name: str, df: DataFrame, schema: ObsSchema) -> str:
    if name == schema.id_col:
        return "entity"
    if name.endswith(schema.value_suffix) and _numeric_view(df, name) is not None:
        return "value"
    return "other"


def slice_stats(df: DataFrame, schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """STATS_SCHEMA: one row per column of `df`, from one aggregate over it. An empty slice has rows with n = 0."""
    rows = []
    for f in df.schema.fields:
        own = F.col(f"`{f.name}`")
        number = _numeric_view(df, f.name) if is_numeric(f.dataType) or is_string(f.dataType) else None
        text = own.cast("string") if is_string(f.dataType) or f.name == schema.id_col else F.lit(None).cast("string")
        x = F.lit(None).cast("double") if number is None else number
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(_kind(f.name, df, schema)).alias("kind"),
            F.count(F.lit(1)).alias("n"), F.count(own).alias("filled"), F.count(x).alias("numbers"),
            F.count(F.when(~is_finite(x), 1)).alias("not_finite"),
            F.min(x).alias("least"), F.max(x).alias("greatest"), F.avg(x).alias("mean"),
            (F.var_pop(x) * F.count(x)).alias("m2"), F.min(text).alias("least_text"), F.max(text).alias("greatest_text")))
    return df.agg(F.array(*rows).alias("d")).select(F.explode("d").alias("p")).select("p.*")


def merge_stats(stats: DataFrame) -> DataFrame:
    """STATS_SCHEMA of all slices together, from rows (slice, STATS_SCHEMA).

    Deviations add up as m2 = sum of m2 + sum of numbers * (mean - overall mean) ** 2; the overall mean comes first."""
    total = stats.groupBy("slice").agg(F.max("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_rows"))
    means = stats.groupBy(F.col("column_name").alias("c")).agg(
        F.try_divide(F.sum(F.col("mean") * F.col("numbers")), F.sum("numbers").cast("double")).alias("overall"))
    # one row a column, and one row in all: both are bounded by the width of the table
    both = stats.join(F.broadcast(means), F.col("column_name") == F.col("c"))
    shift = F.col("mean") - F.col("overall")
    merged = both.groupBy("column_name").agg(
        F.max("kind").alias("kind"), F.sum("filled").alias("filled"), F.sum("numbers").alias("numbers"),
        F.sum("not_finite").alias("not_finite"), F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.max("overall").alias("mean"), F.sum(F.col("m2") + F.col("numbers") * shift * shift).alias("m2"),
        F.min("least_text").alias("least_text"), F.max("greatest_text").alias("greatest_text"))
    out = merged.join(F.broadcast(total))
    names = [p.split()[0] for p in STATS_SCHEMA.split(", ")]
    return out.withColumnRenamed("all_rows", "n").select(*names)


def profile_of(merged: DataFrame, threshold: float = C.DEFAULT_NULL_THRESHOLD) -> DataFrame:
    """The rows of `clean.profile_columns` from merged statistics."""
    n, nulls = F.col("n"), F.col("n") - F.col("filled")
    ratio = F.try_divide(nulls.cast("double"), n.cast("double"))
    zero = (F.col("kind") == "value") & F.coalesce(
        _zero_dev(F.col("numbers"), F.col("least"), F.col("greatest"), F.col("not_finite")), F.lit(False))
    heavy = F.coalesce(ratio > F.lit(float(threshold)), F.lit(False))
    return merged.select("column_name", n.alias("row_count"), nulls.alias("null_count"), ratio.alias("null_ratio"),
                         zero.cast("int").alias("zero_deviation"), ((zero | heavy) & (n > 0)).cast("int").alias("dropped"))


def describe_of(merged: DataFrame) -> DataFrame:
    """The numeric rows of `clean.describe_columns` from merged statistics: columns that hold a number."""
    some: Column = F.when(F.col("numbers") > 1, F.sqrt(F.col("m2") / (F.col("numbers") - 1)))
    return merged.where("numbers > 0").select("column_name", F.col("filled").alias("count"), "mean", some.alias("stddev"),
                                              F.col("least").alias("min"), F.col("greatest").alias("max"))


class ProfileStore:
    """Slice statistics in a Parquet folder of shared storage: (slice, version, STATS_SCHEMA), appended."""

    def __init__(self, spark: SparkSession, path: str, schema: ObsSchema = DEFAULT_SCHEMA):
        self.spark, self.path, self.schema = spark, path, schema

    def add(self, name: str, df: DataFrame) -> None:
        """Scan one slice once and append its statistics; the same name again replaces the earlier version."""
        latest = self._rows().where(F.col("slice") == name).agg(F.max("version")).first()[0]
        stats = slice_stats(df, self.schema).coalesce(1)
        stats.select(F.lit(name).alias("slice"), F.lit((latest or 0) + 1).cast("bigint").alias("version"),
                     F.lit(uuid.uuid4().hex).alias("writer"), "*").write.mode("append").parquet(self.path)

    def _rows(self) -> DataFrame:
        schema = f"slice string, version bigint, writer string, {STATS_SCHEMA}"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def stats(self) -> DataFrame:
        """The counting version of every slice: the last, of two written at once the one of the greater writer."""
        rows = self._rows()
        last = rows.groupBy("slice").agg(F.max(F.struct("version", "writer")).alias("w"))
        last = last.select(F.col("slice").alias("s"), "w.version", "w.writer")
        return rows.join(last, (F.col("slice") == F.col("s")) & (rows["version"] == last["version"])
                         & (rows["writer"] == last["writer"])).select(
            "slice", *[p.split()[0] for p in STATS_SCHEMA.split(", ")])

    def merged(self) -> DataFrame:
        return merge_stats(self.stats())

    def profile(self, threshold: float = C.DEFAULT_NULL_THRESHOLD) -> Profile:
        """The `Profile` of all slices, for `transform_rows(profile=...)`; one row per column reaches the driver."""
        merged = self.merged().collect()
        out = Profile(row_count=int(merged[0]["n"]) if merged else 0, threshold=threshold)
        for r in merged if out.row_count else ():
            nulls = r["n"] - r["filled"]
            out.null_counts[r["column_name"]] = nulls
            if nulls / r["n"] > threshold:
                out.null_heavy.append(r["column_name"])
            if r["kind"] == "value" and r["numbers"] >= 2 and not r["not_finite"] and r["least"] == r["greatest"]:
                out.zero_deviation.append(r["column_name"])
            if r["kind"] == "entity":   # null is an entity of its own
                out.multiple_entities = r["least_text"] != r["greatest_text"] or 0 < nulls < r["n"]
        return out
