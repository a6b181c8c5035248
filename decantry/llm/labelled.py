"""Training rows and calibration for the two scoring operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(fold_of(doc_id, folds) == F.lit(fold), F.lit(False))


def training_labels(labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """``doc_id, y``: at most ``most`` labelled ids outside the held-out fold, the first by hash.

    Ids labelled both ways, null ids and null labels are left out.
    """
    agreed = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id")
              .agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z and y in (0, 1)"))
    return (agreed.where(~held_out(F.col("doc_id"), folds, fold))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("y").cast("int").alias("y")))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) of P(y = 1 | x) by Newton steps; x is scaled inside.

    With one class only, or without rows, the slope is 0 and the intercept the prior's.
    """
    n, ones = len(y), float(np.sum(y))
    prior = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    if n == 0 or ones in (0.0, float(n)) or float(np.std(x)) == 0.0:
        return 0.0, prior
    mean, scale = float(np.mean(x)), float(np.std(x))
    a = np.column_stack([(x - mean) / scale, np.ones(n)])
    w = np.array([0.0, prior])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * n * np.array([w[0], 0.0])
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge * n, 1e-9])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if float(np.abs(step).max()) < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def logistic(x: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * x + intercept, -30, 30)))
