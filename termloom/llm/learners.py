"""Small learners for bounded samples, and the sampling itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import materialize


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, seed: str
) -> DataFrame:
    """``doc_id, text, y, weight``: about ``rows`` labelled documents of each class, whole texts.

    Labels other than 0 and 1, and rows without a number, are passed over; a document with both
    labels counts as 1. ``weight`` is the number of documents that a sampled one stands for.
    """
    y = F.col(label).cast("int")
    known = (
        labels.filter(F.col("doc_id").isNotNull() & y.isin(0, 1))
        .groupBy("doc_id").agg(F.max(y).alias("y"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    )
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for value, count in counts.items():
        share = F.when(F.col("y") == value, F.lit(min(1.0, rows / count))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)
    chosen = known.filter(draw < share).select("doc_id", "y", (1 / F.greatest(share, F.lit(1e-12))).alias("weight"))
    # About rows per class, so small enough to send everywhere.
    found = docs.select("doc_id", "text").join(F.broadcast(materialize(chosen, "chosen")), "doc_id")
    return materialize(found, "labelled")


def class_share(labels: DataFrame, label: str) -> float:
    """Share of ones among the labels; a half without any."""
    value = labels.select(F.avg(F.when(F.col(label).isin(0, 1), F.col(label)).cast("double"))).first()[0]
    return 0.5 if value is None else float(value)


def dual_coordinate_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray,
    rounds: int = 30, tolerance: float = 1e-3, seed: int = 7,
) -> np.ndarray:
    """Weights of a linear hinge-loss model; a row is its feature numbers and values.

    One dual variable at a time is set to its best value between 0 and its cost; rounds end when
    no variable is far from its optimum. The last weight is the bias.
    """
    weights = np.zeros(size + 1)
    dual = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            at, value = rows[i]
            slope = y[i] * (weights[at] @ value + weights[size]) - 1
            step = slope
            if dual[i] <= 0:
                step = min(slope, 0.0)
            elif dual[i] >= cost[i]:
                step = max(slope, 0.0)
            worst = max(worst, abs(step))
            if step:
                before = dual[i]
                dual[i] = min(max(before - slope / norms[i], 0.0), cost[i])
                change = (dual[i] - before) * y[i]
                weights[at] += change * value
                weights[size] += change
        if worst < tolerance:
            break
    return weights


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Coefficients and intercept (last) of a logistic regression, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    penalty = np.full(len(beta), ridge)
    penalty[-1] = 1e-6

    def loss(b):
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + penalty @ (b * b) / 2)

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (weight * (p - y)) + penalty * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return beta


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
