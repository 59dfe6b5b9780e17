"""A fitted featuriser: what the labelled-point plan learns from training rows, stored and applied to other rows.

Fitting decides the feature columns (profile) and makes two tables, kept as Parquet: the string index (column, value,
index, rows) and the ranges of every entity (entity, low and high of each feature, rows). `apply` joins them to
any frame: training rows get exactly the features of `transform_rows`, later rows are measured with the same
rulers, and no row of theirs changes an index or a range.

What training has not seen has a rule:

* a string value without an index: `keep` gives it the index after the last one, `skip` leaves its row out,
  `error` fails the job when such a row is read;
* an entity without ranges: `overall` scales by the ranges over all training rows, `skip` leaves its rows out;
* a value outside its entity's range falls outside [0, 1], or is clamped on request.

A row with a null in a feature cannot be scored and is left out, as in training. A row without a label is kept
when `labelled=False`, which is how new rows are served.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..operators.clean import Profile, as_of, complete_rows, compute_profile
from ..operators.features import (assemble, binarize_labels, frequency_index_tables, scaled_between, to_double_all)
from ..operators.joins import COUNT_COL, broadcast_limit, lookup_join, measured_bytes
from ..schema import DEFAULT_SCHEMA, ObsSchema, is_string, require_columns, spare_names
from ..session import discard, ensure_checkpoint_dir, stored
from .labelled import LabeledPoints

UNSEEN_VALUES = ("keep", "skip", "error")
UNSEEN_ENTITIES = ("overall", "skip")


@dataclass
class Featuriser:
    """Fitted settings; the tables lie under `path`."""

    path: str
    label: str
    feature_names: list
    strings: dict = field(default_factory=dict)        # string column -> number of indexed values
    scaled: bool = False
    overall: list = field(default_factory=list)        # [low, high] of every feature over all training rows
    time_features: bool = False
    null_threshold: float = 0.0
    as_of_ms: int | None = None
    fitted_rows: int = 0
    naming: dict = field(default_factory=dict)
    small_tables: dict = field(default_factory=dict)   # measured bytes of each table

    @property
    def schema(self) -> ObsSchema:
        return ObsSchema(**self.naming)

    def index_table(self, spark: SparkSession) -> DataFrame:
        """(column, value, index, _n)."""
        return spark.read.schema(f"column string, value string, index double, {COUNT_COL} bigint").parquet(f"{self.path}/index")

    def range_table(self, spark: SparkSession) -> DataFrame:
        """(entity, low0, high0, ..., _n)."""
        return spark.read.parquet(f"{self.path}/ranges")

    def _may_broadcast(self, spark: SparkSession, table: str) -> bool:
        return 0 <= self.small_tables.get(table, -1) <= broadcast_limit(spark)

    # -- storage ------------------------------------------------------------------------------
    def save(self, spark: SparkSession) -> Featuriser:
        """Write the settings beside the tables, last: a folder without them is not a featuriser."""
        row = [(json.dumps(asdict(self) | {"path": ""}, sort_keys=True),)]
        spark.createDataFrame(row, "settings string").coalesce(1).write.parquet(f"{self.path}/settings")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Featuriser:
        row = spark.read.schema("settings string").parquet(f"{path}/settings").first()
        return cls(**(json.loads(row["settings"]) | {"path": path}))

    # -- use ----------------------------------------------------------------------------------
    def apply(self, df: DataFrame, keep: tuple = (), labelled: bool = True, unseen_values: str = "keep",
              unseen_entities: str = "overall", clamp: bool = False, force_shuffle: bool = False) -> LabeledPoints:
        """(id, time, kept columns, label, features) of the rows of any frame that has the fitted columns.

        Columns that training did not use are ignored. Without `labelled` the label is null and its column need
        not be there. `force_shuffle` takes the salted joins whatever the tables' sizes."""
        if unseen_values not in UNSEEN_VALUES or unseen_entities not in UNSEEN_ENTITIES:
            raise ValueError(f"unseen values: {UNSEEN_VALUES}; unseen entities: {UNSEEN_ENTITIES}")
        spark, s = df.sparkSession, self.schema
        needed = [c for c in self.feature_names if c != s.time_col] + ([self.label] if labelled else [])
        keys = [s.id_col, s.time_col]
        require_columns(df, [*keys, *needed], "feature column")
        kept = [c for c in dict.fromkeys(keep) if c not in keys]
        carried = spare_names(df, *[f"kept{i}" for i in range(len(kept))])      # as they are, features among them too
        rows = complete_rows(df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *needed])],
                                       *[F.col(f"`{c}`").alias(k) for c, k in zip(kept, carried, strict=True)]), [*keys, *needed])
        label_was_string = labelled and is_string(df.schema[self.label].dataType)
        for c, n_values in self.strings.items():
            if c in needed:
                rows = self._indexed(rows, c, n_values, unseen_values, force_shuffle)
        rows = to_double_all(rows, keep=(s.id_col, *carried))
        lost = 0
        if label_was_string and self.label not in self.strings:
            lost = rows.where(F.col(f"`{self.label}`").isNull()).count()
            rows = rows.where(F.col(f"`{self.label}`").isNotNull())
        names = spare_names(rows, *[f"x{i}" for i in range(len(self.feature_names))], "y", also=(C.LABEL_COL,))
        label = F.col(f"`{self.label}`") if labelled else F.lit(None).cast("double")
        rows = rows.select(*[F.col(f"`{c}`") for c in (*keys, *carried)], label.cast("double").alias(names[-1]),
                           *[F.col(f"`{c}`").alias(x) for c, x in zip(self.feature_names, names, strict=False)])
        names, y = names[:-1], names[-1]
        if self.scaled:
            rows = self._scaled(rows, names, unseen_entities, clamp, force_shuffle)
        if labelled and self.label.endswith(s.status_suffix):
            rows = binarize_labels(rows, y)
        out = assemble(rows, names)
        out = out.select(*keys, *[F.col(k).alias(c) for c, k in zip(kept, carried, strict=True)], F.col(y).alias(C.LABEL_COL), C.FEATURES_COL)
        return LabeledPoints(out, list(self.feature_names), None, self.scaled, self.label, lost)

    def _indexed(self, rows: DataFrame, column: str, n_values: int, unseen: str, force_shuffle: bool) -> DataFrame:
        key, index = spare_names(rows, "value", "index")
        table = self.index_table(rows.sparkSession).where(F.col("column") == column).select(
            F.col("value").alias(key), F.col("index").alias(index), COUNT_COL)
        text = rows.withColumn(column, F.col(f"`{column}`").cast("string"))
        joined = lookup_join(text, table, column, key, how="inner" if unseen == "skip" else "left", null_safe=False,
                             may_broadcast=self._may_broadcast(rows.sparkSession, "index") and not force_shuffle)
        value = F.col(index)
        if unseen == "keep":
            value = F.coalesce(value, F.lit(float(n_values)))
        elif unseen == "error":
            said = F.concat(F.lit(f"'{column}' has a value that training has not seen: "), F.col(f"`{column}`"))
            value = F.coalesce(value, F.raise_error(said).cast("double"))
        return joined.select(*[(value.alias(c) if c == column else F.col(f"`{c}`")) for c in rows.columns])

    def _scaled(self, rows: DataFrame, names: list, unseen: str, clamp: bool, force_shuffle: bool) -> DataFrame:
        entity, known, *ends = spare_names(rows, "entity", "known", *[f"{side}{i}" for i in range(len(names)) for side in ("low", "high")])
        stored = [f"{side}{i}" for i in range(len(names)) for side in ("low", "high")]
        table = self.range_table(rows.sparkSession).select(
            F.col("entity").alias(entity), F.lit(True).alias(known), *[F.col(c).alias(e) for c, e in zip(stored, ends, strict=True)], COUNT_COL)
        joined = lookup_join(rows, table, self.schema.id_col, entity, how="inner" if unseen == "skip" else "left",
                             may_broadcast=self._may_broadcast(rows.sparkSession, "ranges") and not force_shuffle)

        def scale(i: int, x: Column) -> Column:
            low, high = F.col(ends[2 * i]), F.col(ends[2 * i + 1])
            if unseen == "overall":
                low, high = (F.when(F.col(known), v).otherwise(F.lit(w).cast("double")) for v, w in zip((low, high), self.overall[i], strict=True))
            out = scaled_between(x, low, high)
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)) if clamp else out

        at = {x: i for i, x in enumerate(names)}
        return joined.select(*[scale(at[c], F.col(c)).alias(c) if c in at else F.col(f"`{c}`") for c in rows.columns])


def fit_featuriser(df: DataFrame, label: str, null_threshold: float = C.DEFAULT_NULL_THRESHOLD, features: str = "all",
                   as_of_ms: int | None = None, schema: ObsSchema = DEFAULT_SCHEMA, scale: bool | None = None,
                   profile: Profile | None = None, keep: tuple = (), root: str | None = None) -> Featuriser:
    """Learn feature columns, string index and entity ranges from training rows, and store them under `root`
    (the session's checkpoint folder unless named). Same rules and settings as `transform_rows`; `keep` names columns that
    are no features and do not decide which rows are complete."""
    from .labelled import cleaned_rows

    spark = df.sparkSession
    path = f"{(root or ensure_checkpoint_dir(spark)).rstrip('/')}/featuriser-{uuid.uuid4().hex}"
    rows, profile, strings = cleaned_rows(df, label, null_threshold, features, as_of_ms, schema, profile, tuple(keep))
    if features == "time":
        names = [schema.time_col]
    else:
        names = [c for c in rows.columns if c.endswith(schema.value_suffix) and c != label and c not in keep]
    strings = [c for c in strings if c in names or c == label]
    names = [c for c in names if c not in strings] + [c for c in names if c in strings]      # as the plan orders them
    needed = list(dict.fromkeys([schema.id_col, schema.time_col, *names, label]))
    rows, scratch = rows.select(*[F.col(f"`{c}`") for c in needed]), None
    if strings or is_string(rows.schema[label].dataType):
        # the cleaned columns that are used are read for the index and again for the ranges: keep them in shared storage
        rows, scratch = stored(rows, "featuriser-rows")
    sizes: dict = {}
    counts = {}
    if strings:
        tables = frequency_index_tables(rows, strings)
        stacked = None
        for c, (table, _) in tables.items():
            part = table.select(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"), F.col("_idx").alias("index"), COUNT_COL)
            stacked = part if stacked is None else stacked.unionByName(part)
        stacked.write.parquet(f"{path}/index")
        read = spark.read.parquet(f"{path}/index")
        counts = {r["column"]: int(r["n"]) for r in read.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        sizes["index"] = measured_bytes(read)[1]
    out = Featuriser(path, label, names, {c: counts.get(c, 0) for c in strings}, False, [], features == "time", float(null_threshold),
                     as_of_ms, 0, asdict(schema), sizes)
    plain = out.apply(rows).expanded()                 # indexed and cast, not scaled
    feats = [F.col(f"`f_{c}`") for c in names]
    pairs = [agg(x).alias(f"{side}{i}") for i, x in enumerate(feats) for side, agg in (("low", F.min), ("high", F.max))]
    do_scale = profile.multiple_entities if scale is None else scale
    if do_scale:
        plain.groupBy(F.col(schema.id_col).alias("entity")).agg(*pairs, F.count(F.lit(1)).alias(COUNT_COL)).write.parquet(f"{path}/ranges")
        ranges = spark.read.parquet(f"{path}/ranges")
        sizes["ranges"] = measured_bytes(ranges)[1]
        total = ranges.agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in ranges.columns if c.startswith(("low", "high"))],
                           F.sum(COUNT_COL).alias("n")).first()
    else:
        total = plain.agg(*pairs, F.count(F.lit(1)).alias("n")).first()
    out.overall = [[total[f"low{i}"], total[f"high{i}"]] for i in range(len(names))]
    out.fitted_rows, out.scaled, out.small_tables = int(total["n"] or 0), bool(do_scale), sizes
    if scratch:
        discard(spark, scratch)
    return out.save(spark)
