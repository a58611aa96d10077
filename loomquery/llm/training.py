"""Bounded training samples, and small solvers shared by the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Hash space of sampling.
SPACE = 1 << 30
#: Partitions of a sample: it is bounded, so these are too.
PARTITIONS = 12


def sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table ``id, text, label`` of about ``max_rows`` labelled rows at most, the same rows every time.

    Rows are kept by a hash threshold over id and text, set from the number of
    allowed labelled rows, so the sample's expected size is bounded at any
    input size; equal rows count once.  Ids with null or several labels: nulls
    are left out and the largest label holds.
    """
    own = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(allowed & F.col("label").isNotNull() & F.col("id").isNotNull())
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows by their number of equal ids, without the texts.
    n = rows.select("id").join(own, "id").count()
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(SPACE))  # by text too: a hot id must not enter as a whole
    kept = draw < int(SPACE * min(1.0, max_rows / max(n, 1)))
    chosen = rows.where(kept).join(own, "id").select("id", "text", "label")
    # Equal rows are drawn together; they count once, so that copies cannot exceed the bound.
    return durable(chosen.dropDuplicates(["id", "text"]).repartition(PARTITIONS), "sample")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept of an L2-regularised logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        d = np.linalg.solve(h, g)
        w -= d / max(1.0, np.abs(d).max() / 4)
        if np.abs(d).max() < 1e-6:
            break
    return w


def sparse_logistic(rows: list[list[int]], y: np.ndarray, width: int, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """The same weights for rows that are given as lists of the features that are 1; the intercept is last.

    Newton steps by conjugate gradients: memory grows with the ones alone.
    """
    n = len(rows)
    size = np.asarray([len(r) for r in rows], np.int64)
    at = np.repeat(np.arange(n), size)
    col = np.asarray([c for r in rows for c in r], np.int64)
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-3

    def times(v: np.ndarray) -> np.ndarray:
        return np.bincount(at, v[col], n) + v[-1]

    def gathered(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(col, u[at], width), u.sum())

    w = np.zeros(width + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        g = gathered(p - y) + penalty * w
        curve = p * (1 - p) + 1e-9
        scale = gathered(curve) + penalty  # the diagonal, as preconditioner
        d, r = np.zeros_like(w), g.copy()
        z = r / scale
        q, rz = z.copy(), float(r @ z)
        first = rz
        for _ in range(200):
            if rz <= 1e-12 * max(first, 1e-300):
                break
            hq = gathered(curve * times(q)) + penalty * q
            step = rz / float(q @ hq)
            d += step * q
            r -= step * hq
            z = r / scale
            rz, old = float(r @ z), rz
            q = z + rz / old * q
        w -= d / max(1.0, np.abs(d).max() / 4)
        if np.abs(d).max() < 1e-6:
            break
    return w


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half; for tests and reports."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    rank = np.empty(len(s))
    edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rank[order[a:b]] = (a + b + 1) / 2
    n1 = int(label.sum())
    n0 = len(label) - n1
    return float((rank[label == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0))
