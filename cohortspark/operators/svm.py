"""Linear support vector machine with L1 penalty and squared hinge loss, calibrated out of fold.

The optimum of ``|w|_1 + C * sum max(0, 1 - y * (w x))^2`` (the intercept is the
weight of a constant 1, penalised like the others) is found by proximal Newton
steps. A step takes two passes over the data: one sums the loss, its gradient
and its Hessian over the rows inside the margin, one the loss at a few step
lengths along the direction. The sums are as many numbers as the features have
pairs; the L1 problem on them is solved on the driver by coordinate descent.

Calibration follows cross-validation: per fold one machine is fitted on the
other folds and a logistic curve on its margins of the held-out fold, so no row
calibrates a machine that learnt from it. The probability is the folds' mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.folds import stratified_folds
from cohortspark.operators.spd import NotSettled

STEPS = tuple(0.5**k for k in range(12))
MOST_FEATURES = 2000  # pairs of features are summed: 32 MB


def _rows(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(features with the constant, labels -1 or 1) of a batch."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, size)
    return np.hstack([flat, np.ones((batch.num_rows, 1))]), np.where(batch.column("y").to_numpy() > 0.5, 1.0, -1.0)


def _summed(data: DataFrame, part, length: int) -> np.ndarray:
    """Element-wise sum of ``part(batch)`` over all batches: first in each task, then by element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                total += part(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    sums = data.mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
    out = np.zeros(length)
    for r in sums.collect():  # `length` rows
        out[r["k"]] = r["s"]
    return out


def _descent(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rounds: int = 1000, tol: float = 1e-12) -> np.ndarray:
    """The ``d`` that minimises ``g d + d H d / 2 + |w + d|_1``, one coordinate after another."""
    d, at = np.zeros_like(w), gradient.copy()
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            bend = hessian[j, j]
            z, slope = w[j] + d[j], at[j]
            new = np.sign(z - slope / bend) * max(abs(z - slope / bend) - 1 / bend, 0.0)
            if new != z:
                at += hessian[:, j] * (new - z)
                d[j] += new - z
                most = max(most, abs(new - z))
        if most < tol:
            break
    return d


class L1SVC:
    """Fit on ``features`` (vector) and ``label`` (0 / 1); ``weights`` and ``intercept`` after ``fit``."""

    def __init__(self, c: float = 0.78, tol: float = 1e-7, max_iter: int = 60) -> None:
        self.c, self.tol, self.max_iter = c, tol, max_iter

    def fit(self, train: DataFrame) -> "L1SVC":
        data = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
        first = data.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to fit")
        size, c = first[0], self.c
        if size > MOST_FEATURES:
            raise ValueError(f"{size} features, at most {MOST_FEATURES}")
        n = size + 1
        upper = np.triu_indices(n)

        def moments(w):
            def part(batch):
                x, y = _rows(batch, size)
                room = 1 - y * (x @ w)
                inside = room > 0
                x, y, room = x[inside], y[inside], room[inside]
                return np.concatenate([[c * (room**2).sum()], -2 * c * (x.T @ (y * room)), 2 * c * (x.T @ x)[upper]])

            return part

        def losses(w, d):
            def part(batch):
                x, y = _rows(batch, size)
                a, b = y * (x @ w), y * (x @ d)
                return np.array([c * (np.maximum(0, 1 - a - t * b) ** 2).sum() for t in STEPS])

            return part

        w = np.zeros(n)
        for _ in range(self.max_iter):
            sums = _summed(data, moments(w), 1 + n + len(upper[0]))
            loss, gradient, hessian = sums[0], sums[1 : n + 1], np.zeros((n, n))
            hessian[upper] = sums[n + 1 :]
            hessian = hessian + np.triu(hessian, 1).T + 1e-10 * max(1.0, sums[n + 1 :].max(initial=0)) * np.eye(n)
            d = _descent(w, gradient, hessian)
            # at the optimum the smallest subgradient is zero
            smallest = np.where(w != 0, np.abs(gradient + np.sign(w)), np.maximum(np.abs(gradient) - 1, 0)).max()
            self.subgradient = smallest
            if smallest <= self.tol * max(1.0, c) or np.abs(d).max() <= 1e-14:
                self.weights, self.intercept = w[:-1], float(w[-1])
                return self
            now = loss + np.abs(w).sum()
            gain = gradient @ d + np.abs(w + d).sum() - np.abs(w).sum()
            after = _summed(data, losses(w, d), len(STEPS)) + np.array([np.abs(w + t * d).sum() for t in STEPS])
            fit = [t for t, v in zip(STEPS, after) if v <= now + 0.01 * t * gain]
            if not fit:  # no step gains within rounding: this is the optimum as far as doubles tell
                self.weights, self.intercept = w[:-1], float(w[-1])
                return self
            w = w + fit[0] * d
        raise NotSettled(f"L1 machine: subgradient of {smallest:.3g} after {self.max_iter} steps")

    def margin(self, df: DataFrame, out: str = "margin") -> DataFrame:
        products = F.zip_with(vector_to_array("features"), F.lit(self.weights.tolist()).cast("array<double>"), lambda x, w: x * w)
        return df.withColumn(out, F.aggregate(products, F.lit(self.intercept), lambda a, x: a + x))


class CalibratedL1SVC:
    """L1 machines calibrated out of fold; ``transform`` adds ``p1`` and ``prediction``."""

    def __init__(self, key: str, c: float = 0.78, folds: int = 3) -> None:
        self.key, self.c, self.folds = key, c, folds

    def fit(self, train: DataFrame) -> "CalibratedL1SVC":
        folded = stratified_folds(train.select(self.key, "features", "label"), "label", [self.key], self.folds)
        self.parts: list[tuple[L1SVC, float, float]] = []
        for k in range(self.folds):
            machine = L1SVC(self.c).fit(folded.where(F.col("fold") != k))
            held = machine.margin(folded.where(F.col("fold") == k)).select(array_to_vector(F.array("margin")).alias("m"), "label")
            curve = LogisticRegression(featuresCol="m", regParam=0.0, standardization=False).fit(held)
            self.parts.append((machine, float(curve.coefficients[0]), float(curve.intercept)))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for k, (machine, _, _) in enumerate(self.parts):
            df = machine.margin(df, f"_margin_{k}")
        each = [1 / (1 + F.exp(-(F.lit(a) * F.col(f"_margin_{k}") + F.lit(b)))) for k, (_, a, b) in enumerate(self.parts)]
        total = each[0]
        for p in each[1:]:
            total = total + p
        out = df.withColumn("p1", total / len(each))
        return out.withColumn("prediction", (F.col("p1") > 0.5).cast("double")).drop(*[f"_margin_{k}" for k in range(len(self.parts))])
