"""Parameter grids per model family: the original search space (`full`) and a fast preset (`smoke`).

A grid is a callable (estimator, n_features) -> list[ParamMap], so callers can plug in their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.param import Param
from pyspark.ml.tuning import ParamGridBuilder

# --- fixed values: the original search space -------------------------------------------------
MIN_INFO_GAIN = [1.0, 0.5, 0.1, 0.0]
IMPURITY = ["gini", "entropy"]
MAX_BINS = [32]
MAX_DEPTH = [3, 5, 7, 9]
NUM_TREES = [5, 10, 15, 20]
GBT_MAX_ITER = [20, 40, 60]
MLP_HIDDEN = [[16], [32], [32, 16], [16, 32], [16, 32, 16], [32, 16, 32]]
MLP_MAX_ITER = [20, 40, 60]
MLP_BLOCK_SIZE = [128]
LINEAR_MAX_ITER = [25, 50, 75, 100]
ELASTIC_NET = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
REG_PARAM = [0.0, 0.1, 0.01, 0.001]
FIT_INTERCEPT = [True, False]
NB_SMOOTHING = [0.0, 1.0, 2.0]
GLM_FAMILY = ["gaussian", "gamma"]
GLM_LINK = ["identity", "log", "inverse"]
ISOTONIC = [True, False]

GridFn = Callable[[object, int], list]


def _grid(est, axes: dict) -> list:
    b = ParamGridBuilder()
    for name, values in axes.items():
        param: Param = est.getParam(name)
        b = b.addGrid(param, list(values))
    return b.build()


def _layers(n_features: int, hidden, classes: int = 2) -> list:
    return [[n_features, *h, classes] for h in hidden]


FULL: dict[str, dict[str, GridFn]] = {
    "classification": {
        "decision_tree": lambda e, n: _grid(e, {"minInfoGain": MIN_INFO_GAIN, "impurity": IMPURITY,
                                                "maxBins": MAX_BINS, "maxDepth": MAX_DEPTH}),
        "random_forest": lambda e, n: _grid(e, {"minInfoGain": MIN_INFO_GAIN, "impurity": IMPURITY,
                                                "maxBins": MAX_BINS, "maxDepth": MAX_DEPTH,
                                                "numTrees": NUM_TREES}),
        # GBT classifiers accept only the variance impurity in Spark 4, so that axis is left out.
        "gbt": lambda e, n: _grid(e, {"minInfoGain": MIN_INFO_GAIN, "maxBins": MAX_BINS, "maxDepth": MAX_DEPTH,
                                      "maxIter": GBT_MAX_ITER}),
        "mlp": lambda e, n: _grid(e, {"layers": _layers(n, MLP_HIDDEN), "maxIter": MLP_MAX_ITER,
                                      "blockSize": MLP_BLOCK_SIZE}),
        "logistic": lambda e, n: _grid(e, {"maxIter": LINEAR_MAX_ITER, "elasticNetParam": ELASTIC_NET,
                                           "regParam": REG_PARAM, "fitIntercept": FIT_INTERCEPT}),
        "naive_bayes": lambda e, n: _grid(e, {"smoothing": NB_SMOOTHING}),
    },
    "regression": {
        "linear": lambda e, n: _grid(e, {"maxIter": LINEAR_MAX_ITER, "elasticNetParam": ELASTIC_NET,
                                         "regParam": REG_PARAM, "fitIntercept": FIT_INTERCEPT}),
        "glm": lambda e, n: _grid(e, {"maxIter": LINEAR_MAX_ITER, "regParam": REG_PARAM, "family": GLM_FAMILY,
                                      "link": GLM_LINK, "fitIntercept": FIT_INTERCEPT}),
        "decision_tree": lambda e, n: _grid(e, {"minInfoGain": MIN_INFO_GAIN, "maxBins": MAX_BINS,
                                                "maxDepth": MAX_DEPTH}),
        "random_forest": lambda e, n: _grid(e, {"minInfoGain": MIN_INFO_GAIN, "maxBins": MAX_BINS,
                                                "maxDepth": MAX_DEPTH, "numTrees": NUM_TREES}),
        "gbt": lambda e, n: _grid(e, {"minInfoGain": MIN_INFO_GAIN, "maxBins": MAX_BINS, "maxDepth": MAX_DEPTH,
                                      "maxIter": GBT_MAX_ITER}),
        "isotonic": lambda e, n: _grid(e, {"isotonic": ISOTONIC}),
    },
}

SMOKE: dict[str, dict[str, GridFn]] = {
    "classification": {
        "decision_tree": lambda e, n: _grid(e, {"minInfoGain": [0.0], "impurity": ["gini"], "maxDepth": [3, 5]}),
        "random_forest": lambda e, n: _grid(e, {"minInfoGain": [0.0], "maxDepth": [5], "numTrees": [5]}),
        "gbt": lambda e, n: _grid(e, {"minInfoGain": [0.0], "maxDepth": [3], "maxIter": [20]}),
        "mlp": lambda e, n: _grid(e, {"layers": _layers(n, [[16]]), "maxIter": [20]}),
        "logistic": lambda e, n: _grid(e, {"maxIter": [25], "regParam": [0.0, 0.01], "elasticNetParam": [0.0]}),
        "naive_bayes": lambda e, n: _grid(e, {"smoothing": [0.0, 1.0]}),
    },
    "regression": {
        "linear": lambda e, n: _grid(e, {"maxIter": [25], "regParam": [0.0, 0.01], "elasticNetParam": [0.0]}),
        "glm": lambda e, n: _grid(e, {"maxIter": [25], "regParam": [0.0], "family": ["gaussian"],
                                      "link": ["identity"]}),
        "decision_tree": lambda e, n: _grid(e, {"minInfoGain": [0.0], "maxDepth": [3, 5]}),
        "random_forest": lambda e, n: _grid(e, {"minInfoGain": [0.0], "maxDepth": [5], "numTrees": [5]}),
        "gbt": lambda e, n: _grid(e, {"minInfoGain": [0.0], "maxDepth": [3], "maxIter": [20]}),
        "isotonic": lambda e, n: _grid(e, {"isotonic": ISOTONIC}),
    },
}

PRESETS = {"full": FULL, "smoke": SMOKE}


def grid_for(preset, task: str, family: str) -> GridFn:
    table = PRESETS[preset] if isinstance(preset, str) else preset
    return table[task][family]


def grid_size(preset, task: str, family: str, n_features: int = 3) -> int:
    from .train import make_estimator

    return len(grid_for(preset, task, family)(make_estimator(task, family), n_features))
