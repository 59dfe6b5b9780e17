"""The cleaning + featurising plan that turns an observation table into labelled points.

Jobs are constant in the number of entities: one profile aggregate, one index per string column,
one per-entity min/max aggregate; the rest is one lazy plan that Catalyst optimises as a whole.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.clean import as_of, complete_rows, compute_profile, Profile
from ..operators.features import (assemble, binarize_labels, index_columns, scale_by_entity, sort_by_time,
                                  to_double_all)
from ..schema import DEFAULT_SCHEMA, ObsSchema, is_string, spare_names
from ..session import stored
from ..sources.tables import load_rows

log = logging.getLogger(__name__)

FEATURE_MODES = ("all", "time")


@dataclass
class LabeledPoints:
    """Result of the plan: (id, time, label, features) plus what decided its shape."""

    frame: DataFrame
    feature_names: list = field(default_factory=list)
    profile: Profile | None = None
    scaled: bool = False
    label_source: str = ""
    dropped_labels: int = 0     # rows whose string status did not parse

    def expanded(self, round_to: int | None = None) -> DataFrame:
        """Vector expanded into one double column per feature name (for SQL comparison)."""
        from pyspark.ml.functions import vector_to_array

        arr = vector_to_array(F.col(C.FEATURES_COL))
        cols = []
        for i, name in enumerate(self.feature_names):
            v = arr[i]
            cols.append((F.round(v, round_to) if round_to is not None else v).alias(f"f_{name}"))
        return self.frame.select(*[c for c in self.frame.columns if c != C.FEATURES_COL], *cols)


def cleaned_rows(df: DataFrame, label: str, null_threshold: float, features: str, as_of_ms: int | None,
                 schema: ObsSchema, profile: Profile | None = None, keep: tuple = ()):
    """(rows, profile, string columns): weak columns dropped, complete rows up to the as-of date. Lazy but for the profile."""
    if features not in FEATURE_MODES:
        raise ValueError(f"features must be one of {FEATURE_MODES}")
    if label not in df.columns:
        raise ValueError(f"Label feature '{label}' is not a column of the frame")
    if features == "time":
        # time-only features read (entity, time, label) alone, as the projected scan does
        load_rows(df, label, True, schema)      # refuses a string label
        df = df.select(*dict.fromkeys([schema.id_col, schema.time_col, label, *keep]))
    keep = [c for c in keep if c not in (schema.id_col, schema.time_col, label)]
    judged = [c for c in df.columns if c not in keep]
    if profile is None:
        profile = compute_profile(df.select(*judged), null_threshold, schema)
    else:
        null_threshold = profile.threshold
    dropped = set(profile.to_drop) & set(judged)
    if label in dropped:
        why = "zero standard deviation" if label in profile.zero_deviation else (
            f"a null ratio above the threshold {null_threshold}")
        raise ValueError(f"Label feature '{label}' was dropped for {why}; raise the null threshold or choose "
                         f"another label.")
    for key in (schema.id_col, schema.time_col):
        if key in dropped:
            raise ValueError(f"Key column '{key}' was dropped for nulls (threshold {null_threshold})")
    df = df.drop(*dropped)
    df = as_of(complete_rows(df, [c for c in judged if c not in dropped]), as_of_ms, schema)
    strings = [f.name for f in df.schema.fields if f.name.endswith(schema.value_suffix) and is_string(f.dataType) and f.name not in keep]
    return df, profile, strings


def _prepare(df: DataFrame, label: str, null_threshold: float, features: str, as_of_ms: int | None,
             schema: ObsSchema, scale: bool | None, profile: Profile | None = None, keep: tuple = ()):
    df, profile, strings = cleaned_rows(df, label, null_threshold, features, as_of_ms, schema, profile, keep)
    keep = [c for c in keep if c not in (schema.id_col, schema.time_col, label)]
    lost = 0
    label_was_string = is_string(df.schema[label].dataType)
    if strings:
        # the cleaned rows are read for the index and again for the points: keep what is used of them once in shared
        # storage, column-wise, so that each reader takes only its columns
        used = {schema.id_col, schema.time_col, label, *keep}
        df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in used or c.endswith(schema.value_suffix)])
        df = index_columns(stored(df, "cleaned")[0], strings)
    df = to_double_all(df, keep=(schema.id_col, *keep))
    if label_was_string and not label.endswith(schema.value_suffix):
        # a string status that does not parse has no label: such rows cannot be trained on, and are counted
        lost = df.where(F.col(label).isNull()).count()
        if lost:
            log.warning("%d rows have a status '%s' that is not a number; they are left out.", lost, label)
        df = df.where(F.col(label).isNotNull())

    if features == "time":
        names = [schema.time_col]
        feat_cols = spare_names(df, "t")
        src = df.withColumn(feat_cols[0], F.col(schema.time_col))
    else:
        names = [c for c in df.columns if c.endswith(schema.value_suffix) and c != label and c not in keep]
        src = df
        feat_cols = names

    base = src.select(schema.id_col, schema.time_col, *keep, F.col(label).alias(C.LABEL_COL), *feat_cols)
    do_scale = profile.multiple_entities if scale is None else scale
    if do_scale:
        if features == "time" or label.endswith(schema.value_suffix):
            log.warning("Per-entity scaling of regression data with several entities leaves the response "
                        "unscaled.")
        base = scale_by_entity(base, feat_cols, key=schema.id_col)
    if label.endswith(schema.status_suffix):
        base = binarize_labels(base, C.LABEL_COL)
    return base, feat_cols, names, profile, do_scale, lost


def transform_rows(df: DataFrame, label: str, null_threshold: float = C.DEFAULT_NULL_THRESHOLD,
                   features: str = "all", as_of_ms: int | None = None, schema: ObsSchema = DEFAULT_SCHEMA,
                   scale: bool | None = None, sort: bool = False, profile: Profile | None = None,
                   keep: tuple = ()) -> LabeledPoints:
    """Clean and featurise: drop weak columns, keep complete rows up to `as_of_ms`, index strings,
    cast to double, assemble features (all `_value` columns but the label, or the time only),
    scale per entity when there are several, binarise a status label; with `sort`, order by time (a full
    range shuffle that no later step needs). `keep` names columns to carry through unchanged, such as a row key;
    they are no features and do not decide which rows are complete.

    With features="time" the profile and the row filter read (entity, time, label) alone, as the projected scan
    does; the original filtered on all columns there, which differs when the null threshold is above 0.

    A stored `profile` (see `Profile.to_frame` / `from_frame`) replaces the profile pass."""
    base, feat_cols, names, profile, do_scale, lost = _prepare(df, label, null_threshold, features, as_of_ms,
                                                               schema, scale, profile, keep)
    carried = [c for c in keep if c not in (schema.id_col, schema.time_col)]
    cols = [schema.id_col, schema.time_col, *carried, C.LABEL_COL, C.FEATURES_COL]
    if sort:
        # tie-break hash from the scalar columns, before they are packed into the vector
        tie = spare_names(base, "tie")[0]
        base = base.withColumn(tie, F.xxhash64(*[F.col(c) for c in base.columns]))
        lp = sort_by_time(assemble(base, feat_cols).select(*cols, tie), schema, tie_col=tie)
    else:
        lp = assemble(base, feat_cols).select(*cols)
    return LabeledPoints(lp, names, profile, do_scale, label, lost)


def load_and_transform(spark_or_df, label: str, null_threshold: float = C.DEFAULT_NULL_THRESHOLD,
                       single_column: bool = False, as_of_ms: int | None = None,
                       schema: ObsSchema = DEFAULT_SCHEMA, **scan_kw) -> LabeledPoints:
    """Scan (projected to one attribute in single-column mode) then transform."""
    df = load_rows(spark_or_df, label, single_column, schema, **scan_kw)
    return transform_rows(df, label, null_threshold, "time" if single_column else "all", as_of_ms, schema)


def labeled_points(df: DataFrame, task: str, attribute: str, as_of_ms: int | None = None,
                   features: str | None = None, null_threshold: float = C.DEFAULT_NULL_THRESHOLD,
                   schema: ObsSchema = DEFAULT_SCHEMA, sort: bool = False, keep: tuple = ()) -> LabeledPoints:
    """Task-specific loaders: classification labels the attribute's status, regression its value.

    Feature mode defaults: classification and regression use all attributes, time series the time.
    """
    if task == "classification":
        label, mode = schema.status_col(attribute), features or "all"
    elif task == "regression":
        label, mode = schema.value_col(attribute), features or "all"
    elif task == "time_series":
        label, mode = schema.value_col(attribute), features or "time"
    else:
        raise ValueError("task must be classification, regression or time_series")
    return transform_rows(df, label, null_threshold, mode, as_of_ms, schema, sort=sort, keep=keep)
