"""Column and row cleaning.

`profile` is the one eager step: a single aggregate over the frame (one row per *column* reaches the
driver, never one per row or entity) decides which columns survive. Everything else is lazy.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.exprs import is_finite, time_at_most, to_double
from ..schema import DEFAULT_SCHEMA, ObsSchema, is_numeric, is_string

log = logging.getLogger(__name__)


def _numeric_view(df: DataFrame, name: str) -> Column | None:
    """The values `describe()` would summarise: numbers as double, strings by a lenient cast."""
    dt = df.schema[name].dataType
    if is_numeric(dt):
        return F.col(name).cast("double")
    if is_string(dt):
        return to_double(name, dt)
    return None


def _profile_exprs(df: DataFrame, schema: ObsSchema) -> tuple[list[Column], dict]:
    exprs = [F.count(F.lit(1)).alias("n")]
    layout: dict = {"nn": {}, "dev": {}}
    for i, f in enumerate(df.schema.fields):
        exprs.append(F.count(F.col(f.name)).alias(f"nn{i}"))
        layout["nn"][f.name] = f"nn{i}"
        if f.name.endswith(schema.value_suffix):
            x = _numeric_view(df, f.name)
            if x is not None:
                exprs += [
                    F.count(x).alias(f"xc{i}"),
                    F.min(x).alias(f"mn{i}"),
                    F.max(x).alias(f"mx{i}"),
                    F.count(F.when(~is_finite(x), 1)).alias(f"nf{i}"),
                ]
                layout["dev"][f.name] = i
    return exprs, layout


def _zero_dev(xc, mn, mx, nf) -> Column:
    """Sample stddev exactly 0: at least two finite values, all equal (no float-merge rounding)."""
    return (xc >= 2) & (mn == mx) & (nf == 0)


def profile_columns(df: DataFrame, threshold: float = C.DEFAULT_NULL_THRESHOLD,
                    schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Lazy long-format profile: one row per column with its null count, null ratio and drop decision."""
    exprs, layout = _profile_exprs(df, schema)
    agg = df.agg(*exprs)
    n = F.col("n")
    rows = []
    for name in df.columns:
        nulls = n - F.col(layout["nn"][name])
        ratio = F.try_divide(nulls.cast("double"), n.cast("double"))
        if name in layout["dev"]:
            i = layout["dev"][name]
            zero = _zero_dev(F.col(f"xc{i}"), F.col(f"mn{i}"), F.col(f"mx{i}"), F.col(f"nf{i}"))
        else:
            zero = F.lit(False)
        null_drop = F.coalesce(ratio > F.lit(float(threshold)), F.lit(False))
        rows.append(F.struct(
            F.lit(name).alias("column_name"),
            n.alias("row_count"),
            nulls.alias("null_count"),
            ratio.alias("null_ratio"),
            zero.cast("int").alias("zero_deviation"),
            ((zero | null_drop) & (n > 0)).cast("int").alias("dropped"),
        ))
    return agg.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


@dataclass
class Profile:
    """Outcome of the profile aggregate (small: one entry per column)."""

    row_count: int
    threshold: float
    null_counts: dict = field(default_factory=dict)
    zero_deviation: list = field(default_factory=list)
    null_heavy: list = field(default_factory=list)
    multiple_entities: bool = False

    @property
    def to_drop(self) -> list:
        out = list(self.zero_deviation)
        out += [c for c in self.null_heavy if c not in out]
        return out

    def to_frame(self, spark) -> DataFrame:
        """One row per column, so a profile can be stored (any format) and re-used on new data."""
        names = list(self.null_counts) or sorted(set(self.zero_deviation) | set(self.null_heavy))
        rows = [(c, int(self.null_counts.get(c, 0)), c in self.zero_deviation, c in self.null_heavy,
                 int(self.row_count), float(self.threshold), bool(self.multiple_entities)) for c in names]
        schema = ("column_name string, null_count bigint, zero_deviation boolean, null_heavy boolean, "
                  "row_count bigint, threshold double, multiple_entities boolean")
        return spark.createDataFrame(rows, schema)

    @classmethod
    def from_frame(cls, df: DataFrame) -> "Profile":
        """Read back a stored profile (bounded: one row per column of the profiled table)."""
        rows = df.collect()
        if not rows:
            return cls(row_count=0, threshold=0.0)
        prof = cls(row_count=rows[0]["row_count"], threshold=rows[0]["threshold"],
                   multiple_entities=rows[0]["multiple_entities"])
        for r in rows:
            prof.null_counts[r["column_name"]] = r["null_count"]
            if r["zero_deviation"]:
                prof.zero_deviation.append(r["column_name"])
            if r["null_heavy"]:
                prof.null_heavy.append(r["column_name"])
        return prof


def compute_profile(df: DataFrame, threshold: float = C.DEFAULT_NULL_THRESHOLD,
                    schema: ObsSchema = DEFAULT_SCHEMA) -> Profile:
    """Run the single profile job: null counts, zero-deviation values, entity multiplicity, row count."""
    exprs, layout = _profile_exprs(df, schema)
    has_id = schema.id_col in df.columns
    if has_id:
        # Several entities <=> some id differs from one sample id (or nulls sit beside values).
        # Counting against a literal keeps every buffer fixed-width, so the aggregate stays a
        # code-generated hash aggregate; min/max of a string would force the interpreted sort path.
        idc = F.col(schema.id_col)
        probe = df.where(idc.isNotNull()).select(idc).limit(1).collect()
        exprs.append(F.count(idc).alias("id_nn"))
        if probe:
            exprs.append(F.count(F.when(idc != F.lit(probe[0][0]), 1)).alias("id_other"))
    row = df.agg(*exprs).first()
    n = row["n"]
    prof = Profile(row_count=n, threshold=threshold)
    if n == 0:
        log.warning("Empty frame: no columns can be filtered.")
        return prof
    for name, key in layout["nn"].items():
        nulls = n - row[key]
        prof.null_counts[name] = nulls
        if nulls / n > threshold:
            prof.null_heavy.append(name)
    for name, i in layout["dev"].items():
        xc, mn, mx, nf = row[f"xc{i}"], row[f"mn{i}"], row[f"mx{i}"], row[f"nf{i}"]
        if xc >= 2 and nf == 0 and mn == mx:
            prof.zero_deviation.append(name)
    if has_id:
        # distinct() counts null as a value of its own
        id_nn = row["id_nn"]
        other = row["id_other"] if "id_other" in row else 0
        prof.multiple_entities = (other or 0) > 0 or (0 < id_nn < n)
    return prof


def apply_profile(df: DataFrame, profile: Profile) -> DataFrame:
    return df.drop(*profile.to_drop)


def filter_incomplete_columns(df: DataFrame, threshold: float = C.DEFAULT_NULL_THRESHOLD,
                              schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Drop `_value` columns of zero deviation and any column whose null ratio exceeds `threshold`."""
    return apply_profile(df, compute_profile(df, threshold, schema))


def complete_rows(df: DataFrame, columns=None) -> DataFrame:
    """Keep rows without a null in any column (or in `columns`). NaN is a value, not a null."""
    names = list(columns) if columns else df.columns
    if not names:
        return df
    cond = F.col(names[0]).isNotNull()
    for c in names[1:]:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def as_of(df: DataFrame, as_of_ms: int | None, schema: ObsSchema = DEFAULT_SCHEMA) -> DataFrame:
    """Keep rows with time <= `as_of_ms` (epoch ms, any sign); None is the only "no filter".

    The time column may be epoch milliseconds, TIMESTAMP, TIMESTAMP_NTZ or DATE; the bound reaches the scan."""
    if as_of_ms is None:
        return df
    return df.where(time_at_most(schema.time_col, df.schema[schema.time_col].dataType, as_of_ms))


def describe_columns(df: DataFrame, columns=None) -> DataFrame:
    """Typed describe(): count, mean, sample stddev, min, max per numeric or string column, long format.

    A string column's mean and stddev are those of the values that are numbers; its least and greatest text
    stand in min_text and max_text (a number's min and max in min and max)."""
    names = columns or [f.name for f in df.schema.fields if is_numeric(f.dataType) or is_string(f.dataType)]
    rows = []
    for name in names:
        x, text = _numeric_view(df, name), is_string(df.schema[name].dataType)
        rows.append(F.struct(
            F.lit(name).alias("column_name"),
            F.count(F.col(name)).alias("count"),
            F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("stddev"),
            (F.lit(None).cast("double") if text else F.min(x)).alias("min"),
            (F.lit(None).cast("double") if text else F.max(x)).alias("max"),
            (F.min(F.col(name)) if text else F.lit(None)).cast("string").alias("min_text"),
            (F.max(F.col(name)) if text else F.lit(None)).cast("string").alias("max_text"),
        ))
    return df.agg(F.array(*rows).alias("d")).select(F.explode("d").alias("p")).select("p.*")
