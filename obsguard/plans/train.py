"""Grid-search training of the twelve model families on a train/validation split.

The split is drawn by the rows' content, not by partition as MLlib's TrainValidationSplit does, so that the
chosen model does not depend on how the rows lie. Tree families share one VectorIndexer (fitted before the
search), which is stored with the chosen model in one PipelineModel, so scoring sees the same categorical
features as training. Isotonic regression is fitted on pooled rows (one per feature value).
"""

from __future__ import annotations

import hashlib
import json
import logging
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml import classification as mc
from pyspark.ml import regression as mr
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from . import gram, nested
from .grids import grid_for
from .isotonic import isotonic_steps, step_ends
from .ledger import CellLedger, cell_name, fingerprint, search_key

log = logging.getLogger(__name__)

CLASSIFIERS = ("decision_tree", "random_forest", "gbt", "mlp", "logistic", "naive_bayes")
REGRESSORS = ("linear", "glm", "decision_tree", "random_forest", "gbt", "isotonic")
TREE_FAMILIES = ("decision_tree", "random_forest", "gbt")
INDEXED = C.FEATURES_COL + "_indexed"

# --- fixed values: registry names of the families in the original reports ------------------
DISPLAY_NAMES = {
    ("classification", "decision_tree"): "decision tree classification",
    ("classification", "random_forest"): "random forest classification",
    ("classification", "gbt"): "gradient boosted trees classification",
    ("classification", "mlp"): "multilayer perceptron classification",
    ("classification", "logistic"): "logistic regression classification",
    ("classification", "naive_bayes"): "naive bayes classification",
    ("regression", "linear"): "linear regression",
    ("regression", "glm"): "generalized linear regression",
    ("regression", "decision_tree"): "decision tree regression",
    ("regression", "random_forest"): "random forest regression",
    ("regression", "gbt"): "gradient boosted trees regression",
    ("regression", "isotonic"): "isotonic regression",
}


@dataclass(frozen=True)
class TrainConfig:
    """Search settings. The grid is the original search space unless the caller names a smaller one."""

    grid: object = "full"
    train_ratio: float = C.DEFAULT_TRAIN_RATIO
    classification_metric: str = C.DEFAULT_CLASSIFICATION_METRIC
    regression_metric: str = C.DEFAULT_REGRESSION_METRIC
    max_categories: int = C.DEFAULT_MAX_CATEGORIES
    seed: int = 42
    parallelism: int = 4
    ledger: str | None = None       # folder of finished cells: a search that was stopped fits only the rest

    def cells(self, task: str, family: str, n_features: int = 3) -> list:
        """The grid's cells as plain (parameter, value) lists."""
        maps = grid_for(self.grid, task, family)(make_estimator(task, family), n_features)
        return [sorted((p.name, v) for p, v in m.items()) for m in maps]

    def hash(self, task: str, family: str, context: dict | None = None) -> str:
        """Identity of what would be trained: the resolved cells, the settings and the caller's context (task
        form, feature names, as-of date, threshold and the like)."""
        blob = json.dumps([task, family, self.cells(task, family), self.train_ratio, self.classification_metric,
                           self.regression_metric, self.max_categories, self.seed, context or {}],
                          sort_keys=True, default=str)
        return hashlib.sha256(blob.encode()).hexdigest()


@dataclass
class TrainedModel:
    task: str
    family: str
    model: PipelineModel
    params: dict = field(default_factory=dict)
    validation_metric: float | None = None
    metric_name: str = ""
    grid_cells: int = 0
    cell_metrics: list = field(default_factory=list)   # ({parameter: value}, validation metric or None, error)
    chosen: int = -1                                   # the cell of the final fit

    @property
    def name(self) -> str:
        return DISPLAY_NAMES[(self.task, self.family)]


def make_estimator(task: str, family: str, features_col: str = C.FEATURES_COL):
    kw = {"featuresCol": features_col, "labelCol": C.LABEL_COL}
    if task == "classification":
        table = {
            "decision_tree": mc.DecisionTreeClassifier, "random_forest": mc.RandomForestClassifier,
            "gbt": mc.GBTClassifier, "mlp": mc.MultilayerPerceptronClassifier,
            "logistic": mc.LogisticRegression, "naive_bayes": mc.NaiveBayes,
        }
    elif task == "regression":
        table = {
            "linear": mr.LinearRegression, "glm": mr.GeneralizedLinearRegression,
            "decision_tree": mr.DecisionTreeRegressor, "random_forest": mr.RandomForestRegressor,
            "gbt": mr.GBTRegressor, "isotonic": mr.IsotonicRegression,
        }
    else:
        raise ValueError("task must be classification or regression")
    if family not in table:
        raise ValueError(f"unknown {task} family {family!r}")
    return table[family](**kw)


def feature_count(df: DataFrame, features_col: str = C.FEATURES_COL) -> int:
    """Vector width from the column metadata, else from one row (dense or sparse alike)."""
    meta = df.schema[features_col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    row = df.select(F.size(vector_to_array(F.col(features_col))).alias("n")).first()
    if row is None:
        raise ValueError("cannot size the feature vector of an empty frame")
    return int(row["n"])


def _valid_cells(task: str, family: str, cells: list, stats: dict) -> list:
    """Leave out grid cells MLlib is known to reject for this data (instead of losing the family)."""
    out = []
    for pm in cells:
        values = {p.name: v for p, v in pm.items()}
        if family == "glm" and values.get("family") == "gamma" and not stats.get("label_positive", True):
            continue
        out.append(pm)
    return out


VALID_COL = "_validation"


def _content(df: DataFrame, seed: int):
    """Hash of a row by all its columns."""
    cols = [vector_to_array(F.col(f"`{f.name}`")) if isinstance(f.dataType, VectorUDT) else F.col(f"`{f.name}`")
            for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return F.xxhash64(*cols, F.lit(seed))


def draw_validation(df: DataFrame, config: TrainConfig, by_place: bool = False) -> DataFrame:
    """`df` with a flag for the rows that validate, drawn by a hash of all its columns: the same rows validate
    whatever the partitioning. Equal rows then stand on one side; `by_place` draws them apart, by their place in the scan
    as well."""
    bits = _content(df, config.seed)
    if by_place:
        bits = F.xxhash64(bits, F.monotonically_increasing_id())
    return df.withColumn(VALID_COL, F.pmod(bits, F.lit(1 << 32)) >= F.lit(int(config.train_ratio * (1 << 32))))


def few_kinds(df: DataFrame, seed: int) -> bool:
    """Whether rows repeat so much (each more than twice, on average) that a draw by content would be lopsided."""
    r = df.agg(F.approx_count_distinct(_content(df, seed)).alias("kinds"), F.count(F.lit(1)).alias("n")).first()
    return r["kinds"] * 2 < r["n"]


@dataclass
class TrainingSet:
    """A training frame (label, features, validation flag) that is stored once for any number of families."""

    frame: DataFrame
    stats: dict
    n_features: int
    indexer: object = None
    held: DataFrame | None = None       # the stored frame, if it is this set's own

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()


# A partition of a training frame holds at most this many numbers (a row counts its features and eight more): MLlib stores
# every row of a partition as objects and reads them all in one task, whatever the size of the table.
PART_NUMBERS = 1 << 22


def partitions_for(rows: int, n_features: int, cores: int) -> int:
    return max(cores, -(-rows * (n_features + 8) // PART_NUMBERS))


def kept(df: DataFrame) -> DataFrame:
    """The frame in storage (MEMORY_AND_DISK), computed once; an under-partitioned one (a small file read as one split, or a
    large one in few) with at least one partition per core, each of a bounded number of rows. The partitions are counted where
    they are stored, so nothing runs twice."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    rows = cached.count()
    width = feature_count(cached) if rows and C.FEATURES_COL in df.columns else len(df.columns)
    parts = partitions_for(rows, width, df.sparkSession.sparkContext.defaultParallelism)
    if cached.rdd.getNumPartitions() >= parts:
        return cached
    wide = cached.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
    wide.count()
    cached.unpersist()
    return wide


def store_drawn(df: DataFrame, config: TrainConfig) -> DataFrame:
    """The frame in storage with the flag of its validation rows; the caller unpersists it."""
    plain = kept(df)
    if VALID_COL in df.columns or not few_kinds(plain, config.seed):
        # the caller's flag, or one that follows from the stored columns: no second copy
        return plain
    drawn = draw_validation(plain, config, by_place=True).persist(StorageLevel.MEMORY_AND_DISK)
    drawn.count()
    plain.unpersist()
    return drawn


def training_set(df: DataFrame, config: TrainConfig = TrainConfig(), families=(), persisted: bool = False) -> TrainingSet:
    """Prepare (label, features) for the families: flag, statistics, width, one VectorIndexer for all trees.

    With `persisted` the caller keeps the frame in storage already; otherwise it is stored here until
    `release()`."""
    held = df if persisted else store_drawn(df.select(*[c for c in (C.LABEL_COL, C.FEATURES_COL, VALID_COL) if c in df.columns]), config)
    try:
        frame = held if VALID_COL in held.columns else draw_validation(held, config)
        n_features = feature_count(frame)
        return TrainingSet(frame, label_stats(frame), n_features, fit_indexer(frame, config) if any(f in TREE_FAMILIES for f in families) else None,
                           None if persisted else held)
    except Exception:
        if not persisted:
            held.unpersist()
        raise


def fit_indexer(df: DataFrame, config: TrainConfig = TrainConfig()):
    """The category map of the feature vectors: features with few distinct values are categorical."""
    return VectorIndexer(inputCol=C.FEATURES_COL, outputCol=INDEXED, maxCategories=config.max_categories, handleInvalid="keep").fit(df)


WEIGHT_COL = "_weight"


def pooled(df: DataFrame, increasing: bool = True) -> DataFrame:
    """The isotonic fit of the first feature as rows: the ends of its steps, with their value and weight. MLlib, which
    pools in one place, gets the same model from these rows, and they are as many as the model has boundaries."""
    rows = df.select(vector_to_array(F.col(C.FEATURES_COL))[0].alias("x"), F.col(C.LABEL_COL).alias("y"))
    ends = step_ends(isotonic_steps(rows, "x", "y", increasing=increasing))
    return ends.select(F.col("value").alias(C.LABEL_COL), array_to_vector(F.array("x")).alias(C.FEATURES_COL), F.col("weight").alias(WEIGHT_COL))


# A boosted chain passes over its rows many times. Rows with one feature vector (a classifier's: and one label) always share a
# leaf, so their number and mean label say all that a split asks of them. Small frames are fitted as they are.
POOL_FROM = 1 << 17
POOL_GAIN = 4           # rows a pool, on average, that make pooling worth its shuffle
POOL_PLAIN = {"subsamplingRate": 1.0, "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "lossType": ("squared", "logistic")}


def _may_pool(est, cells: list) -> bool:
    """Whether no setting of the grid tells a pool from its rows: no rows are drawn or counted, and the loss is one that
    sums of labels decide."""
    def usual(name, value):
        want = POOL_PLAIN[name]
        return value in want if isinstance(want, tuple) else value == want

    for name in POOL_PLAIN:
        param = est.getParam(name)
        if not all(usual(name, c.get(param, est.getOrDefault(param))) for c in cells):
            return False
    return not est.isSet("validationIndicatorCol") and not est.isSet("weightCol")


def pooled_points(data: DataFrame, est, cells: list, task: str, features_col: str) -> DataFrame | None:
    """(label, features, weight, validation flag): one row for equal feature vectors on either side of the draw; where they are
    fewer than twice a feature's bins, in as many parts as it has bins (MLlib wants that many rows). Stored, the caller unpersists
    it. None if rows repeat too little, or the grid asks for single rows."""
    if not _may_pool(est, cells):
        return None
    x, y = F.col("x"), F.col("y")
    rows = data.select(vector_to_array(F.col(features_col)).alias("x"), F.col(C.LABEL_COL).cast("double").alias("y"), VALID_COL)
    keys = ["x", VALID_COL] + (["y"] if task == "classification" else [])
    bins = est.getParam("maxBins")
    most = max(c.get(bins, est.getOrDefault(bins)) for c in cells)
    kind = F.xxhash64(*keys)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(kind).alias("kinds"),
                    F.approx_count_distinct(F.when(~F.col(VALID_COL), kind)).alias("fitted")).first()
    deal = most if size["fitted"] < 2 * most else 1
    if size["n"] < POOL_FROM or size["kinds"] * deal * POOL_GAIN > size["n"]:
        return None
    # a null label stays one, for the fit to refuse
    mean = y if task == "classification" else F.when(F.count(y) == F.count(F.lit(1)), F.avg(y))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(deal)).alias("part")
    pools = rows.select("*", part).groupBy(*keys, "part").agg(F.count(F.lit(1)).cast("double").alias(WEIGHT_COL),
                                                              *([] if task == "classification" else [mean.alias("y")]))
    return kept(pools.select(y.alias(C.LABEL_COL), array_to_vector(x).alias(features_col, metadata=data.schema[features_col].metadata),
                             WEIGHT_COL, VALID_COL))


def _isotonic_rows(df: DataFrame, values: dict) -> DataFrame:
    return pooled(df, values.get("isotonic", True))


def _measured(evaluator, scored: DataFrame) -> float:
    """The evaluator's metric. A classifier's, but for the log loss, follows from the numbers of (label, prediction) pairs, which
    one aggregate counts; the evaluator itself would take every row out of Spark SQL."""
    if not isinstance(evaluator, MulticlassClassificationEvaluator) or evaluator.getMetricName() == "logLoss":
        return evaluator.evaluate(scored)
    label, prediction = evaluator.getLabelCol(), evaluator.getPredictionCol()
    counts = scored.groupBy(F.col(label).cast("double").alias(label), F.col(prediction).cast("double").alias(prediction)).agg(
        F.count(F.lit(1)).cast("double").alias(WEIGHT_COL))
    return evaluator.copy({evaluator.weightCol: WEIGHT_COL}).evaluate(counts.coalesce(1))


def _search(est, cells: list, data: DataFrame, evaluator, config: TrainConfig, task: str, family: str, features_col: str,
            n_features: int, shape=lambda df, values: df, ledger: CellLedger | None = None, source: DataFrame | None = None) -> list:
    """Every cell's validation metric: (metric or None, error). Cells that share a pass over the data, or a fit, are
    answered together (`gram`, `nested`); the others are fitted one by one. `source` holds the rows to fit on, if not `data`."""
    train, valid = (data if source is None else source).where(~F.col(VALID_COL)), data.where(F.col(VALID_COL))
    metric = evaluator.getMetricName()
    values = [{p.name: v for p, v in c.items()} for c in cells]
    out: list = [None] * len(cells)
    if ledger is not None:
        known = ledger.finished()
        out = [(known[name], None) if (name := cell_name(v)) in known else None for v in values]
    if task == "regression" and metric in gram.METRICS and n_features <= gram.MAX_FEATURES:
        some = [i for i, v in enumerate(values) if out[i] is None and gram.solvable(family, v)]
        if some:
            for i, got in zip(some, gram.search(data, F.col(VALID_COL), family, [values[i] for i in some], metric, features_col), strict=True):
                out[i] = got
            if ledger is not None:
                ledger.enter([(cell_name(values[i]), out[i][0]) for i in some if out[i][0] is not None])
    rest = [i for i in range(len(cells)) if out[i] is None]
    groups = [[i] for i in rest]
    if nested.can_nest(task, family, metric):
        groups = [[rest[k] for k in g] for g in nested.groups_of(family, [values[i] for i in rest])]

    def one(i):
        try:
            value = _measured(evaluator, est.fit(shape(train, values[i]), cells[i]).transform(valid))
            return (value, None) if value == value else (None, "the metric is not a number")
        except Exception as e:  # noqa: BLE001 - a failing cell must not lose the family
            return None, f"{type(e).__name__}: {e}"

    def answers(some):
        if len(some) > 1:
            try:
                return nested.score_group(est, [cells[i] for i in some], train, valid, task, family, metric, features_col)
            except Exception as e:  # noqa: BLE001 - one bad cell must not lose its group
                log.warning("one fit for %d cells of %s failed (%s); fitting them one by one", len(some), family, e)
        return [one(i) for i in some]

    def group(some):
        got = answers(some)
        if ledger is not None:
            ledger.enter([(cell_name(values[i]), g[0]) for i, g in zip(some, got, strict=True) if g[0] is not None])
        return got

    if groups:
        with ThreadPool(max(1, min(config.parallelism, len(groups)))) as pool:
            for some, got in zip(groups, pool.map(inheritable_thread_target(data.sparkSession)(group), groups), strict=True):
                for i, g in zip(some, got, strict=True):
                    out[i] = g
    return out


def _ledger(ts: TrainingSet, task: str, family: str, config: TrainConfig) -> CellLedger | None:
    if not config.ledger:
        return None
    rows = ts.frame.select(C.LABEL_COL, C.FEATURES_COL, VALID_COL)
    key = search_key(task, family, config.train_ratio, config.classification_metric, config.regression_metric, config.max_categories,
                     fingerprint(rows, _content(rows, config.seed)))
    return CellLedger(ts.frame.sparkSession, config.ledger, key)


def train_family(df: DataFrame | TrainingSet, task: str, family: str, config: TrainConfig = TrainConfig()) -> TrainedModel:
    """Search the family's grid on a train/validation split, then fit the best cell on all rows.

    `df` holds (label, features), or is a prepared `TrainingSet` shared by several families. The validation rows
    are drawn by their content, so the outcome does not depend on the partitioning. Ties go to the first cell.
    """
    own = not isinstance(df, TrainingSet)
    ts = training_set(df, config, (family,)) if own else df
    pools = None
    try:
        if family == "naive_bayes" and not ts.stats.get("features_nonnegative", True):
            raise ValueError("naive Bayes needs non-negative features")
        stages, data, features_col = [], ts.frame, C.FEATURES_COL
        if family in TREE_FAMILIES:
            stages, data, features_col = [ts.indexer], ts.indexer.transform(data), INDEXED
        est = make_estimator(task, family, features_col)
        shape = _isotonic_rows if family == "isotonic" else lambda frame, values: frame
        if family == "isotonic":
            est = est.setWeightCol(WEIGHT_COL)
        cells = _valid_cells(task, family, grid_for(config.grid, task, family)(est, ts.n_features), ts.stats)
        if not cells:
            raise ValueError(f"no grid cell of {family} fits this data")
        if task == "classification":
            metric = config.classification_metric
            evaluator = MulticlassClassificationEvaluator(metricName=metric, labelCol=C.LABEL_COL)
        else:
            metric = config.regression_metric
            evaluator = RegressionEvaluator(metricName=metric, labelCol=C.LABEL_COL)
        if family == "gbt" and (pools := pooled_points(data, est, cells, task, features_col)) is not None:
            est = est.setWeightCol(WEIGHT_COL)
        scored = _search(est, cells, data, evaluator, config, task, family, features_col, ts.n_features, shape,
                         _ledger(ts, task, family, config), pools)
        sign = 1 if evaluator.isLargerBetter() else -1
        usable = [(sign * v, -i) for i, (v, _) in enumerate(scored) if v is not None]
        if not usable:
            raise RuntimeError(f"every grid cell of {family} failed; the first said: {scored[0][1]}")
        at = -max(usable)[1]
        best = est.fit(shape(data if pools is None else pools, {p.name: v for p, v in cells[at].items()}), cells[at])
        params = {p.name: v for p, v in best.extractParamMap().items() if not p.name.endswith("Col")}
        named = [({p.name: v for p, v in c.items()}, v, e) for c, (v, e) in zip(cells, scored, strict=True)]
        return TrainedModel(task, family, PipelineModel(stages + [best]), params, scored[at][0], metric, len(cells), named, at)
    finally:
        if pools is not None:
            pools.unpersist()
        if own:
            ts.release()


def label_stats(df: DataFrame) -> dict:
    """Facts that decide valid grid cells: one small aggregate."""
    r = df.agg(F.min(C.LABEL_COL).alias("lmin"),
               F.min(F.array_min(vector_to_array(F.col(C.FEATURES_COL)))).alias("fmin")).first()
    return {"label_positive": r["lmin"] is not None and r["lmin"] > 0,
            "features_nonnegative": r["fmin"] is None or r["fmin"] >= 0}


def cells_frame(spark, trained: list) -> DataFrame:
    """Every grid cell with its validation metric: (task, family, cell, params, metric_name, metric, error, chosen)."""
    rows = []
    for t in trained:
        for i, (params, value, error) in enumerate(t.cell_metrics):
            rows.append((t.task, t.family, i, json.dumps(params, sort_keys=True, default=str), t.metric_name,
                         None if value is None else float(value), error, i == t.chosen))
    return spark.createDataFrame(rows, "task string, family string, cell int, params string, metric_name string, "
                                       "metric double, error string, chosen boolean")


def params_frame(spark, trained: list) -> DataFrame:
    """Chosen parameters per model: (family, param, value, metric_name, validation_metric, grid_cells)."""
    rows = []
    for t in trained:
        for k in sorted(t.params):
            rows.append((t.task, t.family, k, json.dumps(t.params[k], default=str), t.metric_name,
                         None if t.validation_metric is None else float(t.validation_metric), t.grid_cells))
    schema = ("task string, family string, param string, value string, metric_name string, "
              "validation_metric double, grid_cells int")
    return spark.createDataFrame(rows, schema)
