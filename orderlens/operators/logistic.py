"""Logistic regression by Newton steps from summed normal equations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LogisticFit:
    coefficients: np.ndarray
    intercept: float
    steps: int

    def score(self, features: list[Column]) -> Column:
        """Probability of class 1."""
        z = sum((c * float(w) for c, w in zip(features, self.coefficients)), F.lit(float(self.intercept)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _sums(beta: np.ndarray):
    """Per task: gradient and Hessian of the weighted loss at `beta`, as (cell, value) rows."""
    def run(batches):
        n = len(beta)
        total = np.zeros(n + n * n)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.column_stack([np.ones(len(x)), x])
            y, w = (batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("y", "w"))
            p = 1.0 / (1.0 + np.exp(-(x @ beta)))
            total[:n] += x.T @ (w * (p - y))
            total[n:] += (x.T @ (x * (w * p * (1.0 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "value"])
    return run


def newton_logistic(df: DataFrame, features: list[str], label: str, weight: str | None = None, c: float = 1.0,
                    tolerance: float = 1e-10, most_steps: int = 30) -> LogisticFit:
    """The optimum of half the squared coefficients plus `c` times the weighted log loss.

    The intercept is not penalised. `features` are numeric columns; rows with a null in any column take
    no part. `df` is read once a step, so it should be a stored table. A step sums one gradient and one
    Hessian per task, cell by cell; the driver gets their totals and solves one small system. A full step
    that does not shrink the gradient is halved.
    """
    parts = [F.col(f).cast("double") for f in features]
    used = [*parts, F.col(label), *([F.col(weight)] if weight else [])]
    whole = used[0].isNotNull()
    for u in used[1:]:
        whole &= u.isNotNull()
    rows = df.filter(whole).select(F.array(*parts).alias("x"), F.col(label).cast("double").alias("y"),
                                   (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    n = len(features) + 1
    penalty = np.ones(n)
    penalty[0] = 0.0

    def at(beta):
        cells = rows.mapInArrow(_sums(beta), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("v"))
        total = np.zeros(n + n * n)
        for r in cells.collect():
            total[r["cell"]] = r["v"]
        return c * total[:n] + penalty * beta, c * total[n:].reshape(n, n) + np.diag(penalty)
    beta = np.zeros(n)
    gradient, hessian = at(beta)
    for step in range(1, most_steps + 1):
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        size = 1.0
        while True:
            found = at(beta - size * move)
            if np.linalg.norm(found[0]) <= np.linalg.norm(gradient) or size < 1e-3:
                break
            size /= 2
        beta, (gradient, hessian) = beta - size * move, found
        if np.abs(size * move).max() < tolerance:
            break
    return LogisticFit(beta[1:], float(beta[0]), step)
