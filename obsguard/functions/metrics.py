"""Classification and regression metrics as one conditional aggregate per model (closed forms).

For hard 0/1 predictions the ROC and PR curves have one inner point, so MLlib's areas reduce to
AUROC = (1 + TPR - FPR) / 2 and AUPR = TPR·Prec + (1 - TPR)·(Prec + P/n) / 2 (P actual positives,
n rows; Prec falls back to P/n when nothing is predicted positive). One job for all models; the
driver receives one row per model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _div(a: Column, b: Column) -> Column:
    """a / b as double, null when b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def _both(label: str, prediction: str) -> tuple[Column, Column]:
    """Label and prediction as doubles, both null where one is: every term of a metric sees the same rows."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    whole = y.isNotNull() & p.isNotNull()
    return F.when(whole, y), F.when(whole, p)


def confusion_matrix(pred: DataFrame, group_by=("model",), label: str = C.LABEL_COL,
                     prediction: str = C.PREDICTION_COL) -> DataFrame:
    keys = [k for k in group_by if k in pred.columns]
    return pred.groupBy(*keys, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(pred: DataFrame, group_by=("model",), label: str = C.LABEL_COL,
                          prediction: str = C.PREDICTION_COL, positive: float = C.LABEL_SUSPECT,
                          area_positive: float = 1.0, legacy_swap: bool = False, with_rows: bool = False) -> DataFrame:
    """Accuracy, precision, TPR, FPR, TNR, FNR, F1 for class `positive` (0.0 = suspect) and the
    areas under ROC and PR for class `area_positive`, one row per group.

    Class-wise metrics are null when class `positive` never occurs as a label (the original's
    "n/a"); a precision with nothing predicted positive is 0.0 and F1 with P+R = 0 is 0.0.
    `legacy_swap=True` feeds (prediction, label) in swapped roles, reproducing the old report.
    A row with a null label or prediction takes no part in any metric; with none left all are null. `with_rows` adds
    n_rows, the rows of the group, those included.
    """
    keys = [k for k in group_by if k in pred.columns]
    y, p = _both(label, prediction)
    if legacy_swap:
        y, p = p, y
    pos, apos = F.lit(float(positive)), F.lit(float(area_positive))
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(y).alias("n"),
        _cnt(y == p).alias("correct"),
        _cnt((y == pos) & (p == pos)).alias("tp"),
        _cnt((y != pos) & (p == pos)).alias("fp"),
        _cnt((y == pos) & (p != pos)).alias("fn"),
        _cnt((y != pos) & (p != pos)).alias("tn"),
        _cnt((y == apos) & (p == apos)).alias("atp"),
        _cnt((y != apos) & (p == apos)).alias("afp"),
        _cnt(y == apos).alias("ap"),
    )
    n, tp, fp, fn, tn = (F.col(c) for c in ("n", "tp", "fp", "fn", "tn"))
    atp, afp, ap = F.col("atp"), F.col("afp"), F.col("ap")
    actual_pos = tp + fn
    has_class = actual_pos > 0
    precision = F.when(has_class, F.coalesce(_div(tp, tp + fp), F.lit(0.0)))
    tpr = F.when(has_class, _div(tp, actual_pos))
    fpr = F.when(has_class, _div(fp, fp + tn))
    f1 = F.when(has_class, F.when(precision + tpr == 0, F.lit(0.0))
                .otherwise(F.lit(2.0) * precision * tpr / (precision + tpr)))
    an = n - ap
    a_tpr = _div(atp, ap)
    a_fpr = _div(afp, an)
    a_prec = F.coalesce(_div(atp, atp + afp), _div(ap, n))
    base_rate = _div(ap, n)
    auroc = (F.when(n == 0, F.lit(None)).when(ap == 0, F.lit(0.0)).when(an == 0, F.lit(1.0))
             .otherwise((F.lit(1.0) + a_tpr - a_fpr) / F.lit(2.0)))
    aupr = (F.when(n == 0, F.lit(None)).when(ap == 0, F.lit(0.0)).when(an == 0, F.lit(1.0))
            .otherwise(a_tpr * a_prec + (F.lit(1.0) - a_tpr) * (a_prec + base_rate) / F.lit(2.0)))
    return agg.select(
        *keys,
        _div(F.col("correct"), n).alias("accuracy"),
        precision.alias("precision"),
        tpr.alias("true_positive_rate"),
        fpr.alias("false_positive_rate"),
        (F.lit(1.0) - fpr).alias("true_negative_rate"),
        (F.lit(1.0) - tpr).alias("false_negative_rate"),
        f1.alias("f1"),
        auroc.alias("area_under_roc"),
        aupr.alias("area_under_pr"),
        *(["n_rows"] if with_rows else []),
    )


def regression_report(pred: DataFrame, group_by=("model",), label: str = C.LABEL_COL,
                      prediction: str = C.PREDICTION_COL, with_rows: bool = False) -> DataFrame:
    """mse, rmse, r2 (1 - SSres/SStot) and mae per group in one aggregate, all over the rows that have both a label
    and a prediction. `with_rows` adds n_rows, the rows of the group."""
    keys = [k for k in group_by if k in pred.columns]
    y, p = _both(label, prediction)
    err = p - y
    agg = pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.var_pop(y).alias("_var"),
    )
    return agg.select(
        *keys,
        F.col("mse"),
        F.sqrt(F.col("mse")).alias("rmse"),
        (F.lit(1.0) - _div(F.col("mse"), F.col("_var"))).alias("r2"),
        F.col("mae"),
        *(["n_rows"] if with_rows else []),
    )
