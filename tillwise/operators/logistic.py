"""Logistic regression by Newton steps.

One pass over the rows gives the loss, its slope and its curvature at a point; the step that
these call for is solved on the driver, on as many numbers as there are pairs of features. A
step that does not lower the loss is halved. So a fit takes a handful of passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, functions as F

from tillwise.operators.statistics import Batch, summed

#: The steepest slope of the mean loss at which the fit has come to its end.
FLAT = 1e-9
HALVINGS = 30


@dataclass(frozen=True)
class LogisticFit:
    coefficients: DenseVector
    intercept: float
    #: Passes over the rows.
    passes: int
    #: The steepest slope of the penalised mean loss at the end.
    slope: float

    def probability(self, point: Column) -> Column:
        """The chance of label 1 at ``point``, an array column."""
        terms = F.zip_with(point, F.lit([float(b) for b in self.coefficients]), lambda a, b: a * b)
        z = F.aggregate(terms, F.lit(self.intercept), lambda total, t: total + t)
        return 1 / (1 + F.exp(-z))


def _moments(beta: np.ndarray):
    """Loss, slope and curvature of the summed weighted loss at ``beta``, in one vector."""

    def partial(batch: Batch) -> np.ndarray:
        x = np.concatenate([batch["x"], np.ones((len(batch["label"]), 1))], axis=1)
        y, weight = batch["label"], batch["weight"]
        z = x @ beta
        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
        loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
        slope = x.T @ (weight * (p - y))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x
        return np.concatenate([[loss], slope, bend.ravel()])

    return partial


def fit_logistic(rows: DataFrame, n_features: int, n_rows: int, max_passes: int, tasks: int) -> LogisticFit:
    """Minimises the mean weighted loss of ``rows`` (x, label, weight) with a penalty of 1/rows.

    The penalty is half the squared coefficients, without the constant, over the rows; it makes
    the curvature positive, so there is one optimum. ``rows`` should be cached; ``tasks`` is the
    most partitions it has.
    """
    ridge = np.append(np.ones(n_features), 0.0)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        total = summed(rows, _moments(beta), tasks)
        m = n_features + 1
        loss = total[0] + 0.5 * (ridge * beta**2).sum()
        slope = total[1 : 1 + m] + ridge * beta
        # The curvature along a feature without spread is the penalty's alone.
        bend = total[1 + m :].reshape(m, m) + np.diag(ridge) + 1e-12 * np.eye(m)
        return loss, slope, bend

    beta = np.zeros(n_features + 1)
    loss, slope, bend = at(beta)
    passes, halved = 1, 0
    step = np.linalg.solve(bend, slope)
    while passes < max_passes and np.abs(slope).max() / n_rows > FLAT and halved < HALVINGS:
        tried = at(beta - step)
        passes += 1
        if tried[0] <= loss + 1e-12 * abs(loss):
            beta, halved = beta - step, 0
            loss, slope, bend = tried
            step = np.linalg.solve(bend, slope)
        else:
            step, halved = step / 2, halved + 1
    return LogisticFit(Vectors.dense(beta[:-1]), float(beta[-1]), passes, float(np.abs(slope).max() / n_rows))
