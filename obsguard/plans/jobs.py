"""Orchestration: train or load each family, score the hold-out set, and report all models at once.

The labelled rows are stored once per evaluation. Scores of every model come from one pass over the test rows,
stacked (model, label, prediction), and are reduced by one metrics aggregate.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.metrics import classification_report, regression_report
from ..operators.clean import as_of
from ..operators.split import split_by_date, tag_by_date, tag_split
from ..schema import DEFAULT_SCHEMA, ObsSchema, spare_names
from ..session import discard, reliable_checkpoint, stored
from ..sources.registry import ModelRegistry
from ..sources.report import write_report
from .featuriser import Featuriser, fit_featuriser
from .train import (CLASSIFIERS, REGRESSORS, VALID_COL, TrainConfig, TrainedModel, TrainingSet, draw_validation, store_drawn,
                    train_family, training_set)

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class JobConfig:
    """Job settings: null threshold, categorical limit, training, registry root and report folder."""

    null_threshold: float = C.DEFAULT_NULL_THRESHOLD
    train: TrainConfig = TrainConfig()
    registry_root: str | None = None
    report_dir: str | None = None
    report_format: str = "json"


@dataclass
class ModelSet:
    models: dict = field(default_factory=dict)      # family -> PipelineModel
    trained: list = field(default_factory=list)     # TrainedModel of families fitted in this run
    failures: dict = field(default_factory=dict)    # family -> error text


def train_models(df: DataFrame | TrainingSet, task: str, attribute: str = "", families=None, force_train: bool = True,
                 config: JobConfig = JobConfig(), context: dict | None = None, features=(),
                 stored: bool = False, featuriser: str | None = None) -> ModelSet:
    """Per family: load from the registry unless forced or absent, else train and save.

    `context` is all that tells this job's models from others of the same attribute (task form, as-of date,
    threshold, split); it is part of the registry key, as are the feature names. The training rows are stored
    once for all families; `stored` says that the caller has done so. A failing family is recorded with its error
    and the others go on. Models saved with a `featuriser` (its folder) are found again without the feature names,
    which the featuriser knows.
    """
    families = families or (CLASSIFIERS if task == "classification" else REGRESSORS)
    spark = df.frame.sparkSession if isinstance(df, TrainingSet) else df.sparkSession
    registry = ModelRegistry(spark, config.registry_root) if config.registry_root else None
    context = {**(context or {}), **({"fitted": True} if featuriser else {"features": list(features)})}
    out = ModelSet()
    wanted = []
    for fam in families:
        try:
            key_hash = config.train.hash(task, fam, context)
            if registry is not None and not force_train and registry.exists(task, attribute, fam, key_hash):
                out.models[fam] = registry.load(task, attribute, fam, key_hash, features)
            else:
                wanted.append((fam, key_hash))
        except Exception as e:  # noqa: BLE001 - family isolation
            out.failures[fam] = _failed(task, attribute, fam, e)
    if not wanted:
        return out
    ts = df if isinstance(df, TrainingSet) else training_set(df, config.train, [f for f, _ in wanted], stored)
    try:
        for fam, key_hash in wanted:
            try:
                tm: TrainedModel = train_family(ts, task, fam, config.train)
                out.models[fam] = tm.model
                out.trained.append(tm)
                if registry is not None:
                    registry.save(tm.model, task, attribute, fam, key_hash, tm.validation_metric, features, featuriser)
            except Exception as e:  # noqa: BLE001 - family isolation
                out.failures[fam] = _failed(task, attribute, fam, e)
    finally:
        if ts is not df:
            ts.release()
    return out


def _failed(task: str, attribute: str, family: str, error: Exception) -> str:
    log.warning("no %s model of family %s for attribute %r: %s", task, family, attribute, error)
    return f"{type(error).__name__}: {error}"


def score_all(models: dict, test: DataFrame, keep=()) -> DataFrame:
    """Stack the predictions of every model, (kept columns, model, label, prediction), in one pass over the test rows:
    the models' transforms are chained, and each row then unfolds into one row per model."""
    # kept columns travel as one, under a name that no model's own columns have
    held = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept") if keep else F.lit(True).alias("_kept")
    scored = test.select(C.LABEL_COL, C.FEATURES_COL, held)
    columns = {}
    for i, (fam, model) in enumerate(models.items()):
        columns[fam] = f"_prediction_{i}"
        names = [*scored.columns, F.col(C.PREDICTION_COL).cast("double").alias(columns[fam])]
        scored = model.transform(scored).select(*names)
    rows = F.array(*[F.struct(F.lit(fam).alias("model"), F.col(c).alias("prediction")) for fam, c in columns.items()])
    if not columns:
        rows = F.expr("cast(array() as array<struct<model:string,prediction:double>>)")
    return scored.select(F.explode(rows).alias("r"), F.col(C.LABEL_COL).alias("label"), "_kept").select(
        *[F.col("_kept").getField(c).alias(c) for c in keep], "r.model", "label", "r.prediction")


def _report(models: dict, failures: dict, test: DataFrame, summarise) -> DataFrame:
    """The report of all models, stored, with the error of each family that has none. If scoring them together
    fails, each is scored alone, so that one bad model costs only its own row."""
    failures = dict(failures)

    def frozen(some: dict) -> DataFrame:
        return reliable_checkpoint(summarise(score_all(some, test)))

    try:
        report = frozen(models)
    except Exception as e:  # noqa: BLE001 - model isolation
        log.warning("scoring all models together failed (%s); scoring them one by one", e)
        report = frozen({})
        for fam, model in models.items():
            try:
                report = report.unionByName(frozen({fam: model}))
            except Exception as single:  # noqa: BLE001 - model isolation
                failures[fam] = f"scoring failed: {type(single).__name__}: {single}"
    report = report.withColumn("error", F.lit(None).cast("string"))
    if not failures:
        return report
    fail = test.sparkSession.createDataFrame(list(failures.items()), "model string, error string")
    return report.unionByName(fail, allowMissingColumns=True)


PART = "_part"


def _evaluate(tagged: DataFrame, task: str, summarise, force_train: bool, attribute: str, config: JobConfig, families,
              context: dict | None, features, report_name: str) -> DataFrame:
    """Store the labelled rows once, with their part and validation flag; train on part 0, score part 1."""
    families = families or (CLASSIFIERS if task == "classification" else REGRESSORS)
    stored = store_drawn(tagged.select(C.LABEL_COL, C.FEATURES_COL, PART), config.train)
    cached = stored if VALID_COL in stored.columns else draw_validation(stored, config.train)
    try:
        ms = train_models(cached.where(F.col(PART) == 0), task, attribute, families, force_train, config, context, features,
                          stored=True)
        report = _report(ms.models, ms.failures, cached.where(F.col(PART) == 1), summarise)
    finally:
        stored.unpersist()
    if config.report_dir:
        write_report(report, f"{config.report_dir.rstrip('/')}/{report_name}", config.report_format)
    return report


def evaluate_classification(labeled: DataFrame, splits=(0.8, 0.2), seed: int = 42, force_train: bool = True,
                            attribute: str = "", config: JobConfig = JobConfig(), legacy_swap: bool = False,
                            families=None, key_cols=None, split: str = "hash", context: dict | None = None,
                            features=()) -> DataFrame:
    """Split → train/load classifiers → score the test part → one report row per model.

    `split="hash"` draws each row's part from a hash of its key (`key_cols`, else all its columns and its place
    in the scan); `split="random"` draws by Spark's generator, as the original did.
    """
    if split not in ("hash", "random"):
        raise ValueError("split must be 'hash' or 'random'")
    if split == "hash":
        tagged = tag_split(labeled, list(splits), seed, key_cols=key_cols, name=PART)
    else:
        share = splits[0] / sum(splits)
        tagged = labeled.withColumn(PART, F.when(F.rand(seed) < F.lit(share), F.lit(0)).otherwise(F.lit(1)))
    context = {"form": "classification", "split": [split, list(splits), seed, list(key_cols or ())], **(context or {})}
    return _evaluate(tagged, "classification", lambda scored: classification_report(scored, legacy_swap=legacy_swap, with_rows=True),
                     force_train, attribute, config, families, context, features, "classificationreport")


def _evaluate_by_date(labeled, split_ms, form, force_train, attribute, config, families, context, features, name):
    context = {"form": form, "split_ms": int(split_ms), **(context or {})}
    return _evaluate(tag_by_date(labeled, split_ms, PART), "regression", partial(regression_report, with_rows=True), force_train, attribute, config,
                     families, context, features, name)


def evaluate_regression(labeled: DataFrame, split_ms: int, force_train: bool = True, attribute: str = "",
                        config: JobConfig = JobConfig(), families=None, context: dict | None = None,
                        features=()) -> DataFrame:
    """Split by date → train/load regressors → score → mse, rmse, r2, mae per model."""
    return _evaluate_by_date(labeled, split_ms, "regression", force_train, attribute, config, families, context, features,
                             "regressionreport")


def evaluate_time_series(labeled: DataFrame, split_ms: int, force_train: bool = True, attribute: str = "",
                         config: JobConfig = JobConfig(), families=None, context: dict | None = None,
                         features=()) -> DataFrame:
    """The regression evaluation on time-only features, reported separately."""
    return _evaluate_by_date(labeled, split_ms, "time_series", force_train, attribute, config, families, context, features,
                             "timeseriesregressionreport")


# -- attribute forms: from the raw observation table ------------------------------------------------
#
# The featuriser (feature columns, string index, entity ranges) is fitted on the training rows alone and kept with the
# models. Test rows and later slices are measured with it; they never change a feature of a training row.

UNSTORABLE = ("void", "interval")       # types that Parquet does not take
FORMS = {"classification": "classification", "regression": "regression", "time_series": "regression"}
REPORTS = {"classification": "classificationreport", "regression": "regressionreport", "time_series": "timeseriesregressionreport"}


def _label_of(form: str, attribute: str, schema: ObsSchema) -> str:
    if form not in FORMS:
        raise ValueError(f"form must be one of {tuple(FORMS)}")
    return schema.status_col(attribute) if form == "classification" else schema.value_col(attribute)


def _context(form: str, config: JobConfig, as_of_ms: int | None, context: dict | None) -> dict:
    return {"form": form, "as_of_ms": as_of_ms, "null_threshold": config.null_threshold, **(context or {})}


@dataclass
class FittedModels:
    """Models by family, each with the featuriser that makes its features."""

    models: dict = field(default_factory=dict)          # family -> PipelineModel
    featurisers: dict = field(default_factory=dict)     # family -> Featuriser
    failures: dict = field(default_factory=dict)        # family -> error text
    trained: list = field(default_factory=list)         # TrainedModel of families fitted in this run
    dropped_labels: int = 0

    def by_featuriser(self) -> list[tuple[Featuriser, dict]]:
        out: dict = {}
        for fam, model in self.models.items():
            fz = self.featurisers[fam]
            out.setdefault(fz.path, (fz, {}))[1][fam] = model
        return list(out.values())


def load_for(spark, form: str, attribute: str, families=None, config: JobConfig = JobConfig(), as_of_ms: int | None = None,
             context: dict | None = None) -> FittedModels:
    """The latest stored models of an attribute with their featurisers; a family without one is a failure."""
    task, out = FORMS[form], FittedModels()
    if not config.registry_root:
        raise ValueError("stored models need a registry root")
    registry = ModelRegistry(spark, config.registry_root)
    key_context = {**_context(form, config, as_of_ms, context), "fitted": True}
    for fam in families or (CLASSIFIERS if task == "classification" else REGRESSORS):
        try:
            row = registry.latest(task, attribute, fam, config.train.hash(task, fam, key_context))
            if row is None or not row["featuriser"]:
                raise KeyError(f"no stored model of family {fam} for {form} of attribute {attribute!r}")
            fz = next((f for f in out.featurisers.values() if f.path == row["featuriser"]), None) or Featuriser.load(spark, row["featuriser"])
            if (row["features"] or "") != "\n".join(fz.feature_names):
                raise ValueError(f"the model at {row['path']} and its featuriser name different features")
            out.models[fam], out.featurisers[fam] = PipelineModel.load(row["path"]), fz
        except Exception as e:  # noqa: BLE001 - family isolation
            out.failures[fam] = f"{type(e).__name__}: {e}"
    return out


def train_for(obs: DataFrame, form: str, attribute: str, families=None, config: JobConfig = JobConfig(), as_of_ms: int | None = None,
              force_train: bool = True, context: dict | None = None, keep: tuple = (), schema: ObsSchema = DEFAULT_SCHEMA) -> FittedModels:
    """Models of one attribute from training rows of the raw table: stored ones unless forced or absent, else fitted
    together with a featuriser and saved with it. `keep` names columns that are no features."""
    task, label = FORMS[form], _label_of(form, attribute, schema)
    families = list(families or (CLASSIFIERS if task == "classification" else REGRESSORS))
    out = FittedModels()
    if config.registry_root and not force_train:
        out = load_for(obs.sparkSession, form, attribute, families, config, as_of_ms, context)
        out.failures = {}
    wanted = [f for f in families if f not in out.models]
    if not wanted:
        return out
    mode = "time" if form == "time_series" else "all"
    fz = fit_featuriser(obs, label, config.null_threshold, mode, as_of_ms, schema, keep=tuple(keep), root=config.registry_root)
    points = fz.apply(as_of(obs, as_of_ms, schema))
    ms = train_models(points.frame.select(C.LABEL_COL, C.FEATURES_COL), task, attribute, wanted, True, config,
                      _context(form, config, as_of_ms, context), fz.feature_names, featuriser=fz.path)
    out.models |= ms.models
    out.featurisers |= {f: fz for f in ms.models}
    out.failures, out.trained, out.dropped_labels = ms.failures, ms.trained, points.dropped_labels
    return out


def serve_for(obs: DataFrame, form: str, attribute: str, families=None, config: JobConfig = JobConfig(), as_of_ms: int | None = None,
              context: dict | None = None, keep: tuple = (), labelled: bool = False, **rules) -> DataFrame:
    """Score new rows with the stored models of an attribute: (id, time, kept columns, model, label, prediction).

    Nothing is fitted: index and ranges are those of the training rows. `rules` say what happens to unseen values and
    entities (`Featuriser.apply`). A family without a stored model is an error."""
    fitted = load_for(obs.sparkSession, form, attribute, families, config, as_of_ms, context)
    if fitted.failures:
        raise KeyError("; ".join(fitted.failures.values()))
    out = None
    for fz, models in fitted.by_featuriser():
        points = fz.apply(obs, keep=tuple(keep), labelled=labelled, **rules).frame
        rest = [c for c in points.columns if c not in (C.LABEL_COL, C.FEATURES_COL)]
        scored = score_all(models, points, rest)
        out = scored if out is None else out.unionByName(scored)
    return out


def _evaluate_for(parts: tuple[DataFrame, DataFrame], form: str, attribute: str, summarise, force_train: bool, config: JobConfig, families,
                  as_of_ms: int | None, context: dict, keep: tuple) -> DataFrame:
    """Fit featuriser and models on the first part, score the second: one report row per model."""
    train, test = parts
    fitted = train_for(train, form, attribute, families, config, as_of_ms, force_train, context, keep)
    report, dropped, failures = None, fitted.dropped_labels, dict(fitted.failures)
    for fz, models in fitted.by_featuriser() or [(None, {})]:
        points = fz.apply(as_of(test, as_of_ms)) if fz else None
        dropped += points.dropped_labels if fz else 0
        frame = points.frame if fz else test.sparkSession.createDataFrame([], "label double, features array<double>")
        part = _report(models, failures, frame, summarise)
        report, failures = part if report is None else report.unionByName(part), {}
    report = report.withColumn("dropped_labels", F.lit(int(dropped)).cast("bigint"))
    if config.report_dir:
        write_report(report, f"{config.report_dir.rstrip('/')}/{REPORTS[form]}", config.report_format)
    return report


def evaluate_classification_for(obs: DataFrame, attribute: str, splits=(0.8, 0.2), seed: int = 42,
                                force_train: bool = True, config: JobConfig = JobConfig(),
                                as_of_ms: int | None = None, key_cols=None, families=None, legacy_swap: bool = False,
                                context: dict | None = None) -> DataFrame:
    """Label the attribute's status, split the raw rows by a hash of `key_cols` (else of all columns and the place in
    the scan), fit on the first part and evaluate on the second; the report says how many rows had no readable label."""
    part = spare_names(obs, "part")[0]
    tagged, scratch = _tagged_once(tag_split(obs, list(splits), seed, key_cols=key_cols, name=part), attribute, key_cols)
    own = {"split": ["hash", list(splits), seed, list(key_cols or ())], **(context or {})}
    try:
        return _evaluate_for(tuple(tagged.where(F.col(part) == i).drop(part) for i in (0, 1)), "classification", attribute,
                             partial(classification_report, legacy_swap=legacy_swap, with_rows=True), force_train, config, families, as_of_ms, own,
                             tuple(key_cols or ()))
    finally:
        if scratch:
            discard(obs.sparkSession, scratch)


def _tagged_once(tagged: DataFrame, attribute: str, key_cols, schema: ObsSchema = DEFAULT_SCHEMA) -> tuple[DataFrame, str | None]:
    """(the tagged rows, their folder or None): profile, featuriser, training store and scoring each read the parts, so the draw
    of every row is made once and kept. The keys have done their work by then and are left out."""
    if not key_cols:       # the place in the scan decides: both parts must come from one scan
        return reliable_checkpoint(tagged), None
    if any(k in f.dataType.simpleString() for f in tagged.schema.fields for k in UNSTORABLE):
        return tagged, None
    used = (schema.id_col, schema.time_col, _label_of("classification", attribute, schema))
    return stored(tagged.drop(*[c for c in key_cols if c not in used]), "tagged-rows")


def _by_date(obs, form, attribute, split_ms, force_train, config, as_of_ms, families, context):
    own = {"split_ms": int(split_ms), **(context or {})}
    return _evaluate_for(split_by_date(obs, split_ms), form, attribute, partial(regression_report, with_rows=True), force_train, config,
                         families, as_of_ms, own, ())


def evaluate_regression_for(obs: DataFrame, attribute: str, split_ms: int, force_train: bool = True,
                            config: JobConfig = JobConfig(), as_of_ms: int | None = None,
                            families=None, context: dict | None = None) -> DataFrame:
    """Regress the attribute's value on the other attributes: rows up to the date train, later ones test."""
    return _by_date(obs, "regression", attribute, split_ms, force_train, config, as_of_ms, families, context)


def evaluate_time_series_for(obs: DataFrame, attribute: str, split_ms: int, force_train: bool = True,
                             config: JobConfig = JobConfig(), as_of_ms: int | None = None,
                             families=None, context: dict | None = None) -> DataFrame:
    """Regress the attribute's value on time alone: rows up to the date train, later ones test."""
    return _by_date(obs, "time_series", attribute, split_ms, force_train, config, as_of_ms, families, context)
