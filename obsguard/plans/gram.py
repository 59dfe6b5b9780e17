"""Elastic-net cells of linear regression from one pass over the data.

One aggregate gives, for the training and the validation rows apart, the Gram matrix of (1, features, label) about a
shift. Everything a cell needs follows from it on the driver, whatever the number of rows: the fit (coordinate
descent on the standardised moments, in the scaling MLlib uses: features and label by their population deviation)
and the squared-error metrics of the validation rows. The matrix has (features + 2) ** 2 numbers; a partition sends one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

MAX_FEATURES = 512
METRICS = ("rmse", "mse", "r2")
_TURNS, _STILL = 100_000, 1e-13


@dataclass
class Moments:
    """Sums of products of z = (1, features, label) - shift over some rows."""

    products: np.ndarray
    shift: np.ndarray

    @property
    def rows(self) -> float:
        return float(self.products[0, 0])

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.products + other.products, self.shift)

    def means(self) -> np.ndarray:
        return self.products[0, 1:] / self.rows + self.shift

    def covariance(self) -> np.ndarray:
        """Population covariances of (features, label)."""
        mean = self.products[0, 1:] / self.rows
        return self.products[1:, 1:] / self.rows - np.outer(mean, mean)

    def raw(self) -> np.ndarray:
        """Mean products of (features, label), not centred."""
        mean = self.means()
        return self.covariance() + np.outer(mean, mean)


def moments(data: DataFrame, part: Column, features_col: str = C.FEATURES_COL, label_col: str = C.LABEL_COL) -> dict[bool, Moments]:
    """The moments of the rows where `part` is true and where it is false, from one aggregate over the data."""
    rows = data.select(part.alias("part"), vector_to_array(F.col(features_col)).alias("x"), F.col(label_col).cast("double").alias("y"))
    head = rows.first()
    if head is None:
        raise ValueError("an empty frame has no moments")
    shift = np.array([*head["x"], head["y"]])          # any row: it only keeps the sums small
    width = len(shift) + 1
    names = [f"x{i}" for i in range(len(shift) - 1)]
    # one number a column: Arrow hands them over as they lie, and no row becomes an array of its own
    rows = rows.select("part", *[F.col("x")[i].alias(c) for i, c in enumerate(names)], "y")

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {False: np.zeros((width, width)), True: np.zeros((width, width))}
        for f in frames:
            if not len(f):
                continue
            z = np.column_stack([np.ones(len(f)), *[f[c].to_numpy() for c in names], f["y"].to_numpy()])
            z[:, 1:] -= shift
            for side in (False, True):
                own = z[f["part"].to_numpy() == side]
                sums[side] += own.T @ own
        yield pd.DataFrame({"part": list(sums), "sums": [s.ravel() for s in sums.values()]})

    per_task = rows.mapInPandas(partial, "part boolean, sums array<double>")
    added = per_task.select("part", F.posexplode("sums").alias("at", "v")).groupBy("part", "at").agg(F.sum("v").alias("v"))
    out = {side: np.zeros(width * width) for side in (False, True)}
    for r in added.collect():                           # 2 * width ** 2 numbers
        out[r["part"]][r["at"]] = r["v"]
    return {side: Moments(v.reshape(width, width), shift) for side, v in out.items()}


def elastic_net(m: Moments, reg: float = 0.0, mix: float = 0.0, intercept: bool = True) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) minimising mean squared error / 2 plus reg * (mix * L1 + (1 - mix) / 2 * L2), the
    penalty on standardised features and label."""
    cov, mean, raw = m.covariance(), m.means(), m.raw()
    n = len(mean) - 1
    dev = np.sqrt(np.maximum(np.diag(cov), 0.0))
    dev[dev < 1e-12 * np.maximum(1.0, np.abs(mean))] = 0.0
    y_dev = dev[n]
    if y_dev == 0.0:
        if intercept or mean[n] == 0.0:
            return np.zeros(n), float(mean[n])
        if reg > 0.0:
            raise ValueError("a constant label without intercept cannot be regularised")
        y_dev = abs(mean[n])
    use = np.flatnonzero(dev[:n] > 0)
    moment = cov if intercept else raw
    scale = dev[use]
    a = moment[np.ix_(use, use)] / np.outer(scale, scale)
    b = moment[use, n] / (scale * y_dev)
    lam = reg / y_dev
    l1, l2 = lam * mix, lam * (1.0 - mix)
    a = a + l2 * np.eye(len(use))
    if l1 == 0.0:
        w = np.linalg.lstsq(a, b, rcond=None)[0]
    else:
        w = np.zeros(len(use))
        for _ in range(_TURNS):
            most = 0.0
            for j in range(len(use)):
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                new = np.sign(rest) * max(abs(rest) - l1, 0.0) / a[j, j]
                most = max(most, abs(new - w[j]))
                w[j] = new
            if most < _STILL:
                break
    out = np.zeros(n)
    out[use] = w * y_dev / scale
    return out, float(mean[n] - out @ mean[:n]) if intercept else 0.0


def squared_error(m: Moments, coefficients: np.ndarray, intercept: float) -> float:
    """Mean squared error on the rows of the moments."""
    cov, mean = m.covariance(), m.means()
    w = np.append(coefficients, -1.0)
    off = float(w @ mean) + intercept
    return max(0.0, float(w @ cov @ w)) + off * off


def metric_of(m: Moments, coefficients: np.ndarray, intercept: float, name: str) -> float:
    """rmse, mse or r2 (about the mean, as Spark's evaluator) on the rows of the moments."""
    mse = squared_error(m, coefficients, intercept)
    if name == "mse":
        return mse
    if name == "rmse":
        return mse ** 0.5
    var = float(m.covariance()[-1, -1])
    return 1.0 - mse / var if var > 0 else float("nan")


def solvable(family: str, values: dict) -> bool:
    """Whether a cell's fit follows from the moments."""
    return family == "linear" or (family == "glm" and values.get("family") == "gaussian" and values.get("link") == "identity")


def search(data: DataFrame, valid: Column, family: str, cells: list[dict], metric: str, features_col: str = C.FEATURES_COL) -> list:
    """(metric or None, error) of every cell, from one pass. Cells that differ only in the number of iterations agree:
    the fit is exact."""
    both = moments(data, valid, features_col)
    train, held = both[False], both[True]
    done: dict = {}
    out = []
    for values in cells:
        key = (values.get("regParam", 0.0), values.get("elasticNetParam", 0.0) if family == "linear" else 0.0, values.get("fitIntercept", True))
        if key not in done:
            try:
                if not train.rows or not held.rows:
                    raise ValueError("no rows to train on, or none to validate on")
                value = metric_of(held, *elastic_net(train, *key), metric)
                done[key] = (value, None) if value == value else (None, "the metric is not a number")
            except Exception as e:  # noqa: BLE001 - a failing cell must not lose the family
                done[key] = (None, f"{type(e).__name__}: {e}")
        out.append(done[key])
    return out
