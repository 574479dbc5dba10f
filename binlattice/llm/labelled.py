"""Bounded labelled samples and a small logistic fit, shared by the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, *, folds: int, held: int, each: int) -> DataFrame:
    """(doc_id, text, label) of at most each rows a class, outside the held-out fold: those of the least hashed doc_id.

    Rows without a label or doc_id are left out; of several labels of one
    document the largest counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where((remainder(folds) != held) & F.col("label").isin(0, 1))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = [rows.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.join(F.broadcast(picked[0].union(picked[1])), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Newton's method with a ridge on all but the last weight, which is the intercept.

    Both classes weigh the same in sum, as a sample bounded by class says nothing about their shares.
    """
    each = np.where(y > 0.5, 1 / max(1, (y > 0.5).sum()), 1 / max(1, (y <= 0.5).sum())) * len(y) / 2
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (each * p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (each * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return w
