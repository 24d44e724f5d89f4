"""Logistic regression: losses as expressions, the estimator with the same L2 meaning."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP = 1e-15
L2 = 0.01
EPOCHS = 1000


def logistic_regression(l2: float = L2, max_iter: int = EPOCHS) -> LogisticRegression:
    """Multinomial, no L1 part, weights not rescaled: the gradient of the penalty is l2 * w."""
    return LogisticRegression(family="multinomial", regParam=l2, elasticNetParam=0.0, maxIter=max_iter,
                              standardization=False)


def one_hot_encoder(column: str, out: str) -> OneHotEncoder:
    return OneHotEncoder(inputCols=[column], outputCols=[out], dropLast=False)


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


def binary_cross_entropy(p: Column, label: Column) -> Column:
    p = _clipped(p)
    return -(label * F.log(p) + (1 - label) * F.log(1 - p))


def cross_entropy(probabilities: Column, label: Column) -> Column:
    """- log of the probability given to the true class."""
    return -F.log(_clipped(F.get(probabilities, label.cast("int"))))


def mean_loss(df: DataFrame, loss: Column, l2: float = 0.0, squared_weights: float = 0.0,
              weight: Column | None = None) -> DataFrame:
    """One row (loss): the mean of (class-weighted) row losses plus l2 * sum(w^2)."""
    row = loss if weight is None else weight * loss
    return df.agg((F.avg(row) + F.lit(l2 * squared_weights)).alias("loss"))


def class_weight(label: Column, weights: dict) -> Column:
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(label == F.lit(value), F.lit(float(weight))).otherwise(out)
    return out
