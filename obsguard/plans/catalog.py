"""Registered queries: each reads the driver's tables (through the fixture views) at `sf_dir`.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column names equal those of the
matching SQL in `oracle.py`. Floating results are rounded in the query wrappers only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..sources import fixtures
from .labelled import transform_rows

# Fixed parameters of the registered queries (shared with oracle.py).
AS_OF_MS = 946598400000          # 1999-12-31T00:00:00Z
SPLIT_MS = 915148800000          # 1999-01-01T00:00:00Z
SEED = 42
ROUND = 6


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.obs(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, index, scale per entity and binarise; then mean scaled feature per (entity, label)."""
    o = _obs(spark, sf_dir).drop("obs_key")
    lp = transform_rows(o, "li_ua_quantity_status", 0.0, "all", AS_OF_MS, sort=False)
    wide = lp.expanded()
    feats = [c for c in wide.columns if c.startswith("f_")]
    return wide.groupBy(C.ID_COL, C.LABEL_COL).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(c), ROUND).alias("mean_" + c[2:]) for c in feats],
    )


# ---------------------------------------------------------------------------------------------
# Operator queries (obs / market / pred fixture views over lineitem)
# ---------------------------------------------------------------------------------------------
from ..functions.exprs import binarize_status  # noqa: E402
from ..functions.metrics import classification_report, confusion_matrix, regression_report  # noqa: E402
from ..operators import clean, columns, entity, features, split  # noqa: E402
from ..operators.inject import SuspectInjector  # noqa: E402
from ..operators.rank import with_global_rank  # noqa: E402
from ..sources.tables import load_rows, scan_all  # noqa: E402

SCALE_FEATURES = ["li_ua_quantity_value", "li_ua_price_value", "li_ua_tax_value", "li_ua_linenumber_value"]
STD_ATTRS = ["li_ua_quantity", "li_ua_price", "li_ua_linenumber"]
ZERO_ATTRS = ["li_ua_quantity", "li_ua_linenumber", "li_ua_flag"]


def _round_doubles(df: DataFrame, digits: int = ROUND) -> DataFrame:
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def q_scan_all(spark, sf_dir):
    """The full scan of a table by path and format."""
    return scan_all(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", "parquet")


def q_scan_attribute(spark, sf_dir):
    return load_rows(_obs(spark, sf_dir), "li_ua_price_value", True)


def q_profile_columns(spark, sf_dir):
    return _round_doubles(clean.profile_columns(_obs(spark, sf_dir), 0.0))


def q_profile_columns_t05(spark, sf_dir):
    return _round_doubles(clean.profile_columns(_obs(spark, sf_dir), 0.05))


def q_profile_columns_events(spark, sf_dir):
    """The column profile on the second source (events)."""
    return _round_doubles(clean.profile_columns(fixtures.events_obs(spark, sf_dir), 0.0))


def q_profile_from_slices(spark, sf_dir):
    """The column profile merged from three slices by date, each scanned once on its own, with mean and deviation."""
    from ..operators.slices import ProfileStore, describe_of, profile_of
    from ..session import ensure_checkpoint_dir

    o = _obs(spark, sf_dir)
    store = ProfileStore(spark, f"{ensure_checkpoint_dir(spark)}/profile-{uuid.uuid4().hex}")
    when = F.col(C.TIME_COL)
    for name, part in (("early", when <= SPLIT_MS), ("middle", (when > SPLIT_MS) & (when <= AS_OF_MS)),
                       ("late", (when > AS_OF_MS) | when.isNull())):
        store.add(name, o.where(part))
    merged = store.merged()
    numbers = describe_of(merged).select(F.col("column_name").alias("c"), "mean", "stddev")
    both = profile_of(merged, 0.05).join(F.broadcast(numbers), F.col("column_name") == F.col("c"), "left").drop("c")
    return _round_doubles(both.withColumns({c: F.round(c, 2) for c in ("mean", "stddev")}))


def q_describe_columns(spark, sf_dir):
    o = _obs(spark, sf_dir)
    return _round_doubles(clean.describe_columns(o), 2)


def q_drop_incomplete_columns(spark, sf_dir):
    return clean.filter_incomplete_columns(_obs(spark, sf_dir), 0.0)


def q_drop_incomplete_columns_t05(spark, sf_dir):
    return clean.filter_incomplete_columns(_obs(spark, sf_dir), 0.05)


def q_complete_rows(spark, sf_dir):
    return clean.complete_rows(_obs(spark, sf_dir))


def q_complete_rows_subset(spark, sf_dir):
    return clean.complete_rows(fixtures.market(spark, sf_dir), ["re_ua_ask_value", "re_ua_bid_value"])


def q_as_of(spark, sf_dir):
    return clean.as_of(_obs(spark, sf_dir), AS_OF_MS)


def q_as_of_timestamp(spark, sf_dir):
    """The as-of filter on a timestamp column: the bound is a literal that reaches the scan."""
    return clean.as_of(fixtures.obs_timestamp(spark, sf_dir), AS_OF_MS)


def q_split_by_date(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, C.TIME_COL)
    return split.tag_by_date(o, SPLIT_MS).where("part is not null")


def q_split_by_date_timestamp(spark, sf_dir):
    o = fixtures.obs_timestamp(spark, sf_dir).select("obs_key", C.ID_COL, C.TIME_COL)
    train, test = split.split_by_date(o, SPLIT_MS)
    return train.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1))).drop(C.TIME_COL)


def q_hash_split(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, C.TIME_COL)
    return split.tag_split(o, [0.8, 0.2], SEED, key_cols=["obs_key"])


def q_select_by_type_strict(spark, sf_dir):
    return columns.filter_on_type_strict(_obs(spark, sf_dir), "double")


def q_select_by_type(spark, sf_dir):
    return columns.filter_on_type(_obs(spark, sf_dir), "double")


def q_select_drop_columns(spark, sf_dir):
    o = columns.select_columns(_obs(spark, sf_dir), ["obs_key", "ado_id", "li_ua_tax_value", "li_ua_flag_value"])
    return columns.drop_columns(o, ["li_ua_flag_value", "no_such_column"])


def q_to_double(spark, sf_dir):
    return features.to_double_all(_obs(spark, sf_dir), keep=(C.ID_COL, "obs_key"))


def q_binarize_status(spark, sf_dir):
    o = _obs(spark, sf_dir)
    return o.select("obs_key", "li_ua_quantity_status", "li_ua_price_status",
                    binarize_status("li_ua_quantity_status").alias("label_quantity"),
                    binarize_status("li_ua_price_status").alias("label_price"))


def q_index_strings(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_key", "li_ua_flag_value", "li_ua_tax_value")
    return features.index_strings(o)


def q_index_strings_events(spark, sf_dir):
    ev = fixtures.events_obs(spark, sf_dir).select("obs_key", "ev_ua_type_value")
    return features.index_strings(ev)


def q_minmax_by_entity(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, *SCALE_FEATURES)
    o = features.to_double_all(o, keep=("obs_key", C.ID_COL))
    return _round_doubles(features.scale_by_entity(o, SCALE_FEATURES))


def q_index_strings_shuffled(spark, sf_dir):
    """The index joined by the salted shuffle join: each return flag holds about a third of all rows."""
    o = _obs(spark, sf_dir).select("obs_key", "li_ua_flag_value", "li_ua_tax_value")
    return features.index_strings(o, force_shuffle=True)


def q_minmax_by_entity_shuffled(spark, sf_dir):
    """Per-entity scaling through the salted shuffle join instead of a broadcast."""
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, *SCALE_FEATURES)
    o = features.to_double_all(o, keep=("obs_key", C.ID_COL))
    return _round_doubles(features.scale_by_entity(o, SCALE_FEATURES, force_shuffle=True))


def q_minmax_global(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, *SCALE_FEATURES)
    o = features.to_double_all(o, keep=("obs_key", C.ID_COL))
    return _round_doubles(features.scale_global(o, SCALE_FEATURES))


def q_labeled_points_all(spark, sf_dir):
    o = _obs(spark, sf_dir).drop("obs_key")
    return transform_rows(o, "li_ua_quantity_status", 0.0, "all", AS_OF_MS).expanded(ROUND)


def q_labeled_points_time(spark, sf_dir):
    o = _obs(spark, sf_dir).drop("obs_key")
    return transform_rows(o, "li_ua_price_value", 0.0, "time").expanded(ROUND)


def q_labeled_points_regression(spark, sf_dir):
    o = _obs(spark, sf_dir).drop("obs_key")
    lp = transform_rows(o, "li_ua_price_value", 0.05, "all", AS_OF_MS)
    return lp.expanded(ROUND)


def q_labeled_points_events(spark, sf_dir):
    ev = fixtures.events_obs(spark, sf_dir).drop("obs_key")
    return transform_rows(ev, "ev_ua_value_status", 0.0, "all").expanded(ROUND)


def q_labeled_points_timestamp(spark, sf_dir):
    """The labelled plan on a timestamp column gives epoch milliseconds."""
    o = fixtures.obs_timestamp(spark, sf_dir).drop("obs_key")
    return transform_rows(o, "li_ua_quantity_status", 0.0, "all", AS_OF_MS).expanded(ROUND)


def q_labeled_points_three_strings(spark, sf_dir):
    """Three string attributes indexed in one pass."""
    o = fixtures.obs_with_strings(spark, sf_dir).drop("obs_key")
    return transform_rows(o, "li_ua_quantity_status", 0.05, "all").expanded(ROUND)


def q_sort_by_time(spark, sf_dir):
    """Rows in time order with their position in it; ties by entity, then by row key."""
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, C.TIME_COL)
    return with_global_rank(o, C.TIME_COL, C.ID_COL, "obs_key", name="position")


def q_entity_counts(spark, sf_dir):
    return entity.entity_counts(_obs(spark, sf_dir))


def q_entity_summary(spark, sf_dir):
    return entity.entity_summary(_obs(spark, sf_dir))


def q_distinct_entities(spark, sf_dir):
    return entity.distinct_entities(_obs(spark, sf_dir))


def q_entity_stddev(spark, sf_dir):
    return _round_doubles(entity.entity_stddev(_obs(spark, sf_dir), ["li_ua_quantity", "li_ua_price"]))


def q_join_entity_stats(spark, sf_dir):
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, "li_ua_quantity_value")
    st = entity.entity_stddev(o, ["li_ua_quantity"])
    return _round_doubles(entity.join_entity_stats(o, st))


def q_join_entity_stats_shuffled(spark, sf_dir):
    """The same join by the salted shuffle."""
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, "li_ua_quantity_value")
    st = entity.entity_stddev(o, ["li_ua_quantity"])
    return _round_doubles(entity.join_entity_stats(o, st, force_shuffle=True))


def q_minmax_by_entity_null_hot(spark, sf_dir):
    """Per-entity scaling by the salted shuffle where a null entity holds most rows."""
    o = _obs(spark, sf_dir).select("obs_key", F.when(F.col("li_ua_linenumber_value") > 2, F.col(C.ID_COL)).alias(C.ID_COL),
                                   *SCALE_FEATURES)
    o = features.to_double_all(o, keep=("obs_key", C.ID_COL))
    return _round_doubles(features.scale_by_entity(o, SCALE_FEATURES, force_shuffle=True))


def q_entity_feature_ranges(spark, sf_dir):
    o = _obs(spark, sf_dir)
    return _round_doubles(entity.entity_feature_ranges(o, ["li_ua_quantity_value", "li_ua_tax_value"]))


def q_load_and_transform_single(spark, sf_dir):
    """Projected scan of one attribute then the plan in time mode (the single-column loader)."""
    from .labelled import load_and_transform

    return load_and_transform(_obs(spark, sf_dir), "li_ua_quantity_value", 0.0, single_column=True).expanded(ROUND)


def q_labeled_points_classification_loader(spark, sf_dir):
    """Task loader: classification of an attribute's status with all attributes as features."""
    from .labelled import labeled_points

    o = _obs(spark, sf_dir).drop("obs_key")
    return labeled_points(o, "classification", "li_ua_price", as_of_ms=AS_OF_MS).expanded(ROUND)


def _injector():
    return SuspectInjector(key_cols=("obs_key",))


def q_inject_stddev(spark, sf_dir):
    return _round_doubles(_injector().stddev(_obs(spark, sf_dir), STD_ATTRS, SEED))


def q_inject_zero(spark, sf_dir):
    return _injector().zeroes(_obs(spark, sf_dir), ZERO_ATTRS, SEED)


def q_inject_negate(spark, sf_dir):
    return _injector().negatives(_obs(spark, sf_dir), ZERO_ATTRS, SEED)


def q_inject_hilo(spark, sf_dir):
    return _round_doubles(_injector().hilo(fixtures.market(spark, sf_dir), SEED))


def q_inject_spread(spark, sf_dir):
    return _round_doubles(_injector().ask_bid_mid(fixtures.market(spark, sf_dir), SEED))


def q_inject_negate_events(spark, sf_dir):
    """The negation injector on the second source (events, one entity per user)."""
    ev = fixtures.events_obs(spark, sf_dir)
    return _round_doubles(_injector().negatives(ev, ["ev_ua_value", "ev_ua_type"], SEED))


def q_inject_keeps_columns(spark, sf_dir):
    """Columns named like helpers survive an injector, unchanged."""
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, C.TIME_COL, "li_ua_quantity_value", "li_ua_quantity_status",
                                   F.col("li_ua_tax_value").alias("__batch"), F.col("li_ua_flag_value").alias("_hit"),
                                   F.col("li_ua_linenumber_value").alias("_u"))
    return _injector().negatives(o, ["li_ua_quantity"], SEED)


def q_inject_stack(spark, sf_dir):
    """Stack two injected variants of the same rows (bag union by name)."""
    inj = _injector().with_ratio(0.1)
    o = _obs(spark, sf_dir).select("obs_key", C.ID_COL, C.TIME_COL, "li_ua_quantity_value", "li_ua_quantity_status")
    a = inj.zeroes(o, ["li_ua_quantity"], SEED).withColumn("variant", F.lit("zero"))
    b = inj.negatives(o, ["li_ua_quantity"], SEED).withColumn("variant", F.lit("negative"))
    return a.unionByName(b)


def q_confusion_matrix(spark, sf_dir):
    return confusion_matrix(fixtures.pred(spark, sf_dir))


def q_classification_report(spark, sf_dir):
    return _round_doubles(classification_report(fixtures.pred(spark, sf_dir)))


def q_classification_report_legacy(spark, sf_dir):
    return _round_doubles(classification_report(fixtures.pred(spark, sf_dir), legacy_swap=True))


def q_regression_report(spark, sf_dir):
    return _round_doubles(regression_report(fixtures.pred(spark, sf_dir), label="y", prediction="y_hat"), 4)


# ---------------------------------------------------------------------------------------------
# Model queries (MLlib): training per family, registry round trip, evaluations
# ---------------------------------------------------------------------------------------------
from pyspark.ml.feature import VectorIndexer  # noqa: E402
from pyspark.ml.functions import vector_to_array  # noqa: E402

from . import jobs, train as training  # noqa: E402
from .grids import PRESETS, _grid  # noqa: E402

# The search spaces of the registered training queries are named here and small; the default is the full one.
QUICK = "smoke"


def _one_cell(task, fam, /, **values):
    """A search space of a single cell."""
    return {task: {fam: lambda est, n: _grid(est, {k: [v] for k, v in values.items()})}}


def _train(points, task, fam, /, **values):
    return training.train_family(points, task, fam, training.TrainConfig(grid=_one_cell(task, fam, **values)))


def _learnable_points(spark, sf_dir, task, family):
    """All rows with a label that the features determine: b tells line numbers above 3."""
    o = fixtures.learnable(spark, sf_dir)
    label = F.col("li_ua_b_value") if task == "classification" else F.col("li_ua_y_value")
    o = o.select("obs_key", label.alias(C.LABEL_COL), F.col("li_ua_b_value").alias("b"), F.col("li_ua_c_value").alias("c"),
                 "quantity")
    return features.assemble(o, ["b", "quantity"] if family in ("linear", "glm") else ["b", "c"])


def _noisy_points(spark, sf_dir, task, family):
    """All rows with a label that no feature explains wholly: the best prediction is the majority, or the mean, of a side of b."""
    o = fixtures.noisy(spark, sf_dir)
    label = binarize_status("li_ua_b_status") if task == "classification" else F.col("li_ua_y_value")
    o = o.select("obs_key", label.alias(C.LABEL_COL), F.col("li_ua_b_value").alias("b"), F.col("li_ua_c_value").alias("c"))
    return features.assemble(o, ["b"] if family in ("linear", "glm") else ["b", "c"])


# Plain least squares: with a penalty in the grid, chance would decide which of two near-equal cells is chosen.
_QUICK_EXACT = {task: {**table, **({"linear": lambda e, n: _grid(e, {"regParam": [0.0]})} if task == "regression" else {})}
                for task, table in PRESETS[QUICK].items()}


def _train_query(task, family):
    def run(spark, sf_dir):
        """Train one family over all rows, then count (label, prediction) over all rows. The label is noisy, but for the
        regression forest, whose bagged means SQL cannot know."""
        points = (_learnable_points if (task, family) == ("regression", "random_forest") else _noisy_points)(spark, sf_dir, task, family)
        tm = training.train_family(points, task, family, training.TrainConfig(grid=_QUICK_EXACT))
        return tm.model.transform(points).groupBy(
            C.LABEL_COL, F.round(F.col(C.PREDICTION_COL).cast("double"), 3).alias(C.PREDICTION_COL)).agg(
            F.count(F.lit(1)).alias("n"))

    run.__name__ = f"train_{task}_{family}"
    return run


def _status_points(spark, sf_dir, names):
    """The price status as label, raw numbers as features; all rows."""
    o = _obs(spark, sf_dir).select("obs_key", binarize_status(F.col("li_ua_price_status").cast("double")).alias(C.LABEL_COL),
                                   *[F.col(c).cast("double").alias(c) for c in names])
    return features.assemble(o, names)


NB_FEATURES = ["li_ua_quantity_value", "li_ua_linenumber_value"]


def q_naive_bayes_parameters(spark, sf_dir):
    """Class priors and conditional log shares of naive Bayes for each smoothing of the original search space."""
    points = _status_points(spark, sf_dir, NB_FEATURES)
    out = []
    for smoothing in (0.0, 1.0, 2.0):
        m = _train(points, "classification", "naive_bayes", smoothing=smoothing).model.stages[-1]
        for label in range(2):
            for j, name in enumerate(NB_FEATURES):
                out.append((smoothing, float(label), name, round(float(m.pi[label]), 6), round(float(m.theta[label, j]), 6)))
    return spark.createDataFrame(out, "smoothing double, label double, feature string, pi double, theta double")


def _price_on_quantity(spark, sf_dir):
    o = _obs(spark, sf_dir)
    return features.assemble(o.select("obs_key", F.col("li_ua_price_value").alias(C.LABEL_COL), "li_ua_quantity_value"),
                             ["li_ua_quantity_value"])


def _line(spark, model):
    res = spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    return res.select(F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


def q_linear_fit_coefficients(spark, sf_dir):
    """Least squares of price on quantity (no regularisation): slope and intercept."""
    tm = _train(_price_on_quantity(spark, sf_dir), "regression", "linear", regParam=0.0, solver="normal")
    return _line(spark, tm.model.stages[-1])


def q_glm_fit_coefficients(spark, sf_dir):
    """The gaussian generalized linear model with identity link is the same line."""
    tm = _train(_price_on_quantity(spark, sf_dir), "regression", "glm", family="gaussian", link="identity", regParam=0.0)
    return _line(spark, tm.model.stages[-1])


def _high_quantity(spark, sf_dir, label):
    o = _obs(spark, sf_dir)
    o = o.select("obs_key", label.alias(C.LABEL_COL), (F.col("li_ua_quantity_value") > 35).cast("double").alias("high"))
    return features.assemble(o, ["high"])


def q_logistic_log_odds(spark, sf_dir):
    """Logistic regression on one 0/1 feature: intercept and coefficient are log-odds of the counts."""
    label = binarize_status(F.col("li_ua_price_status").cast("double"))
    points = _high_quantity(spark, sf_dir, label)
    m = _train(points, "classification", "logistic", regParam=0.0, maxIter=100, tol=1e-10).model.stages[-1]
    res = spark.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, coefficient double")
    return res.select(F.round("intercept", 3).alias("intercept"), F.round("coefficient", 3).alias("coefficient"))


def q_tree_leaves(spark, sf_dir):
    """Trees of depth 1 on a 0/1 feature: leaf means of the price, leaf majorities of the price status."""
    price = _high_quantity(spark, sf_dir, F.col("li_ua_price_value"))
    status = _high_quantity(spark, sf_dir, binarize_status(F.col("li_ua_price_status").cast("double")))
    out = []
    for task, points in (("regression", price), ("classification", status)):
        tm = _train(points, task, "decision_tree", maxDepth=1, minInfoGain=0.0)
        high = vector_to_array(F.col(C.FEATURES_COL))[0]
        out.append(tm.model.transform(points).groupBy(high.alias("high"), F.round(F.col(C.PREDICTION_COL), 2).alias("leaf"))
                   .agg(F.count(F.lit(1)).alias("n")).withColumn("task", F.lit(task)))
    return out[0].unionByName(out[1])


def q_isotonic_invariants(spark, sf_dir):
    """Isotonic regression of price on quantity: the fit keeps the sum of the labels and never falls."""
    points = _price_on_quantity(spark, sf_dir)
    tm = _train(points, "regression", "isotonic", isotonic=True)
    scored = tm.model.transform(points).select(vector_to_array(F.col(C.FEATURES_COL))[0].alias("x"), C.LABEL_COL, C.PREDICTION_COL)
    by = scored.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum(C.PREDICTION_COL).alias("p"),
                                 F.min(C.PREDICTION_COL).alias("lo"), F.max(C.PREDICTION_COL).alias("hi"))
    from pyspark.sql.window import Window

    falls = F.when(F.lag("hi").over(Window.orderBy("x")) > F.col("lo") + 1e-9, 1).otherwise(0)    # one row a quantity
    return by.withColumn("falls", falls).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_values"),
                                             F.sum("falls").alias("n_falls"), F.round(F.sum("p"), 0).alias("sum_prediction"))


def q_isotonic_steps(spark, sf_dir):
    """The step function of price over time, rising and falling: the fitted value at every ship date."""
    from .isotonic import isotonic_steps

    o = _obs(spark, sf_dir).select(C.TIME_COL, "li_ua_price_value")
    dates = o.groupBy(C.TIME_COL).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for rising in (True, False):
        steps = isotonic_steps(o, C.TIME_COL, "li_ua_price_value", increasing=rising)
        inside = (F.col(C.TIME_COL) >= F.col("first_x")) & (F.col(C.TIME_COL) <= F.col("last_x"))
        part = dates.join(F.broadcast(steps), inside).select(F.lit(rising).alias("rising"), C.TIME_COL, "n", F.round("value", 4).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def q_validation_cells(spark, sf_dir):
    """Every cell of a named search space with its validation metric, on a learnable label: all cells are right."""
    points = _learnable_points(spark, sf_dir, "classification", "decision_tree")
    space = {"classification": {"decision_tree": lambda e, n: _grid(e, {"impurity": ["gini", "entropy"], "maxDepth": [3, 5, 7, 9]})}}
    tm = training.train_family(points, "classification", "decision_tree", training.TrainConfig(grid=space))
    n = points.count()
    return training.cells_frame(spark, [tm]).select("cell", "metric_name", "metric", "chosen", F.lit(n).cast("bigint").alias("n_rows"))


def _held_flag():
    """Rows that validate, by the registered split draw of the row key (so that SQL knows them)."""
    return split.split_word(["obs_key"], SEED)


def q_tree_grid_cells(spark, sf_dir):
    """All 32 tree cells of the original search space on a noisy label and one 0/1 feature: which gains allow the split,
    and the accuracy of each cell on the validation rows."""
    from ..functions.exprs import word_below

    o = _obs(spark, sf_dir)
    label = binarize_status(F.col("li_ua_price_status").cast("double"))
    o = o.select("obs_key", label.alias(C.LABEL_COL), (F.col("li_ua_quantity_value") > 35).cast("double").alias("high"))
    points = features.assemble(o, ["high"]).withColumn(training.VALID_COL, ~word_below(_held_flag(), 0.8))
    tm = training.train_family(points.select(C.LABEL_COL, C.FEATURES_COL, training.VALID_COL), "classification", "decision_tree")
    return _round_doubles(training.cells_frame(spark, [tm]).select(
        "cell", F.get_json_object("params", "$.minInfoGain").cast("double").alias("min_info_gain"),
        F.get_json_object("params", "$.impurity").alias("impurity"), F.get_json_object("params", "$.maxDepth").cast("int").alias("max_depth"),
        "metric_name", "metric", "chosen"))


def _price_by_sides(spark, sf_dir):
    """Price in ten thousands by three 0/1 features: high quantity, middle quantity, line number above 3."""
    o = _obs(spark, sf_dir)
    quantity = F.col("li_ua_quantity_value")
    sides = {"high": quantity > 25, "middle": (quantity > 10) & (quantity <= 40), "last": F.col("li_ua_linenumber_value") > 3}
    o = o.select((F.col("li_ua_price_value") / 10000).alias(C.LABEL_COL), *[c.cast("double").alias(n) for n, c in sides.items()])
    return features.assemble(o, list(sides)), list(sides)


def _fitted(estimator, points):
    """The model of an estimator of trees; it reads the rows several times, so they are stored until it is fitted."""
    rows = training.kept(points.select(C.LABEL_COL, C.FEATURES_COL))
    try:
        return estimator.fit(rows)
    finally:
        rows.unpersist()


def q_forest_trees_as_table(spark, sf_dir):
    """Every tree of a forest of single splits, read from its table of nodes: by feature and side, the rows that reach the
    leaf, what the trees that chose the feature say there, and rows where table and model differ. (No bootstrap, one feature
    drawn a tree: the leaves are the features' group means, and every feature is drawn.)"""
    from pyspark.ml.regression import RandomForestRegressor

    from .ensembles import TreeTable

    points, names = _price_by_sides(spark, sf_dir)
    forest = _fitted(RandomForestRegressor(numTrees=24, maxDepth=1, featureSubsetStrategy="1", bootstrap=False, seed=SEED), points)
    table = TreeTable.of(spark, forest)
    roots = table.nodes.where("left >= 0 and id = 0").select(F.col("tree").alias("t"), "feature")
    scored = table.score(forest.transform(points).withColumnRenamed(C.PREDICTION_COL, "own"), trees_col="says")
    off = (F.abs(F.col("own") - F.col(C.PREDICTION_COL)) > 1e-9).cast("int")
    # rows that agree in all that follows are counted before they unfold into one row a tree (`outer`: no tree is missing, and
    # a filter on the array would score every row again)
    alike = scored.groupBy(*names, off.alias("off"), "says").agg(F.count(F.lit(1)).alias("n"))
    says = alike.select(*names, "off", "n", F.posexplode_outer("says").alias("t", "says")).join(F.broadcast(roots), "t")
    feature = F.array(*[F.lit(n) for n in names])[F.col("feature")]
    side = F.element_at(F.array(*names), F.col("feature") + 1)
    per_tree = says.groupBy("t", feature.alias("feature"), side.alias("side")).agg(
        F.sum("n").alias("n"), F.min("says").alias("least"), F.max("says").alias("most"), F.sum(F.col("off") * F.col("n")).alias("off"))
    return _round_doubles(per_tree.groupBy("feature", "side").agg(
        F.max("n").alias("n_rows"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("off").alias("differing")), 5)


def q_boosted_chain_as_table(spark, sf_dir):
    """A chain of three single splits with step 0.5, read from its table of nodes: what it says after every tree for each
    combination of sides, and rows where table and model differ."""
    from pyspark.ml.regression import GBTRegressor

    from .ensembles import TreeTable

    points, names = _price_by_sides(spark, sf_dir)
    chain = _fitted(GBTRegressor(maxIter=3, maxDepth=1, stepSize=0.5, seed=SEED), points)
    scored = TreeTable.of(spark, chain).score(chain.transform(points).withColumnRenamed(C.PREDICTION_COL, "own"), trees_col="says")
    off = (F.abs(F.col("own") - F.col(C.PREDICTION_COL)) > 1e-9).cast("int")
    first, second, third = (F.get("says", F.lit(i)) for i in range(3))
    steps = {"after_1": first, "after_2": first + 0.5 * second, "after_3": first + 0.5 * second + 0.5 * third}
    return _round_doubles(scored.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(n) for n, c in steps.items()], F.sum(off).alias("differing")), 5)


def q_linear_grid_one_pass(spark, sf_dir):
    """All 192 linear cells of the original search space on price by quantity, from one pass: rmse on the validation rows."""
    from ..functions.exprs import word_below

    o = _obs(spark, sf_dir)
    o = o.select("obs_key", (F.col("li_ua_price_value") / 10000).alias(C.LABEL_COL), "li_ua_quantity_value")
    points = features.assemble(o, ["li_ua_quantity_value"]).withColumn(training.VALID_COL, ~word_below(_held_flag(), 0.8))
    tm = training.train_family(points.select(C.LABEL_COL, C.FEATURES_COL, training.VALID_COL), "regression", "linear")
    names = [("reg_param", "regParam", "double"), ("elastic_net", "elasticNetParam", "double"), ("fit_intercept", "fitIntercept", "boolean")]
    return _round_doubles(training.cells_frame(spark, [tm]).select(
        "cell", *[F.get_json_object("params", f"$.{p}").cast(t).alias(c) for c, p, t in names], F.col("metric").alias("rmse")))


def _slices(spark, sf_dir):
    """Training rows (up to the split date, without some entities and one flag) and all later rows."""
    o = _obs(spark, sf_dir).drop("li_ua_discount_value", "li_ua_unit_value")
    early, late = split.split_by_date(o, SPLIT_MS)
    return early.where((F.col(C.ID_COL).cast("int") % 5 != 0) & (F.col("li_ua_flag_value") != "R")), late


def q_serve_features_on_new_rows(spark, sf_dir):
    """A featuriser fitted on early rows measures later ones: their flag by the early index (an unseen one goes last), their
    numbers by the early ranges of their entity (of all rows for an unseen one)."""
    from .featuriser import fit_featuriser

    early, late = _slices(spark, sf_dir)
    fz = fit_featuriser(early, "li_ua_quantity_status", keep=("obs_key",))
    return fz.apply(late, keep=("obs_key",)).expanded(ROUND)


def q_serve_on_new_rows(spark, sf_dir):
    """A line of price over time, fitted on early rows and stored, scores later ones from the registry; means by entity."""
    early, late = _slices(spark, sf_dir)
    grid = _one_cell("regression", "linear", regParam=0.0, solver="normal")
    config = jobs.JobConfig(train=training.TrainConfig(grid=grid), registry_root=_registry(spark).root)
    jobs.train_for(early, "time_series", "li_ua_price", ["linear"], config)
    again = jobs.train_for(late, "time_series", "li_ua_price", ["linear"], config, force_train=False)      # loads, fits nothing
    served = jobs.serve_for(late, "time_series", "li_ua_price", ["linear"], config)
    return served.groupBy(C.ID_COL, "model").agg(
        F.count(C.PREDICTION_COL).alias("n"), F.round(F.avg(C.PREDICTION_COL), 1).alias("mean_prediction"),
        F.lit(len(again.trained)).cast("bigint").alias("fitted_again"))


CATEGORICAL_FEATURES = ["li_ua_linenumber_value", "li_ua_tax_value", "li_ua_quantity_value", "li_ua_price_value"]


def q_categorical_map(spark, sf_dir):
    """VectorIndexer category maps (features with at most 32 distinct values) as the trees' indexer learns them, straight from the scan."""
    o = features.to_double_all(_obs(spark, sf_dir).select(*CATEGORICAL_FEATURES, F.lit(0.0).alias(C.LABEL_COL)), keep=())
    vec = features.assemble(o, CATEGORICAL_FEATURES)
    vi: VectorIndexer = training.fit_indexer(vec)
    rows = [(int(fi), CATEGORICAL_FEATURES[fi], float(v), int(c))
            for fi, m in vi.categoryMaps.items() for v, c in m.items()]
    return spark.createDataFrame(rows, "feature_index int, feature string, value double, category int")


def _registry(spark):
    from ..sources.registry import ModelRegistry, default_root

    return ModelRegistry(spark, f"{default_root(spark)}/{uuid.uuid4().hex}")


def q_registry_roundtrip(spark, sf_dir):
    """Save a fitted pipeline, load it back by key and score all rows with both: rows whose predictions differ."""
    points = _status_points(spark, sf_dir, ["li_ua_quantity_value", "li_ua_price_value", "li_ua_tax_value"])
    cfg = training.TrainConfig(grid=QUICK)
    tm = training.train_family(points, "classification", "decision_tree", cfg)
    reg = _registry(spark)
    key = ("classification", "li_ua_price", "decision_tree", cfg.hash("classification", "decision_tree"))
    reg.save(tm.model, *key, metric=tm.validation_metric)
    both = tm.model.transform(points).select(C.LABEL_COL, C.FEATURES_COL, F.col(C.PREDICTION_COL).alias("saved"))
    both = reg.load(*key).transform(both)
    return both.groupBy(C.LABEL_COL).agg(F.count(F.lit(1)).alias("n"),
                                         F.sum((F.col("saved") != F.col(C.PREDICTION_COL)).cast("int")).alias("differing"))


def q_registry_listing(spark, sf_dir):
    """What the index lists after three saves of two keys: latest version of each, with the rows it was trained on."""
    points = _price_on_quantity(spark, sf_dir)
    reg = _registry(spark)
    n = points.count()
    for attribute, times in (("li_ua_price", 2), ("li_ua_tax", 1)):
        tm = _train(points, "regression", "linear", regParam=0.0)
        for _ in range(times):
            reg.save(tm.model, "regression", attribute, "linear", "key", metric=float(n), features=["li_ua_quantity_value"])
    return reg.list_models().groupBy("task", "attribute", "family").agg(
        F.max("version").alias("version"), F.max("metric").cast("bigint").alias("trained_rows"),
        F.max("features").alias("features"))


def _job_config():
    return jobs.JobConfig(train=training.TrainConfig(grid=_QUICK_EXACT))


def q_evaluate_classification(spark, sf_dir):
    """Classify a noisy status from the raw table (attribute form of the job), split by the row key."""
    o = fixtures.noisy(spark, sf_dir).drop("li_ua_y_value")        # y knows the noise
    return _round_doubles(jobs.evaluate_classification_for(o, "li_ua_b", (0.8, 0.2), SEED, config=_job_config(),
                                                           key_cols=["obs_key"]), 3)


def q_evaluate_regression(spark, sf_dir):
    """Regress a noisy value on the others, split by date. (A forest's bagged means are near the true ones: one digit.)"""
    o = fixtures.noisy(spark, sf_dir).drop("obs_key", "quantity")
    report = jobs.evaluate_regression_for(o, "li_ua_y", SPLIT_MS, config=_job_config())
    metrics = ("mse", "rmse", "r2", "mae")
    return report.withColumns({m: F.when(F.col("model") == "random_forest", F.round(m, 1)).otherwise(F.round(m, 3)) for m in metrics})


def q_evaluate_time_series(spark, sf_dir):
    """Regress a value on time alone, split by date: the rows scored per model, and whether it has its metrics."""
    o = fixtures.learnable(spark, sf_dir).drop("obs_key")
    report = jobs.evaluate_time_series_for(o, "li_ua_y", SPLIT_MS, config=_job_config())
    return report.select("model", "n_rows", "dropped_labels", "error",
                         (F.col("rmse").isNotNull() & (F.col("mae") <= F.col("rmse") + 1e-9)).alias("scored"))


for _task, _fams in (("classification", training.CLASSIFIERS), ("regression", training.REGRESSORS)):
    for _fam in _fams:
        globals()[f"q_train_{_task}_{_fam}"] = _train_query(_task, _fam)


def _with_ckpt(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def registered() -> dict:
    table = {"flagship_entity_label_means": flagship}
    for name, fn in list(globals().items()):
        if name.startswith("q_") and callable(fn):
            table[name[2:]] = fn
    return {k: _with_ckpt(v) for k, v in table.items()}
