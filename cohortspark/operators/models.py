"""Classifiers, validation and matrix-geometry models.

Standard classifiers are Spark ML estimators, but the forest (``forest.py``). Matrix-geometry models (mean
of SPD matrices, tangent space, minimum distance to class mean) run as
distributed iterations: each iteration maps every matrix with vectorised
numpy inside an Arrow-batched pandas UDF and reduces to a [VOI × VOI]
average; only that small average comes back to the driver. Inputs of an
iteration loop are written once as a table in the session's checkpoint
folder, so a lost executor re-reads that table, not the raw inputs.

Not built: k-nearest neighbours under the Riemannian metric (all train ×
test pairs; see README).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators import metrics as M
from cohortspark.operators.forest import RandomForest
from cohortspark.operators.spd import NotSettled
from cohortspark.session import materialise as _materialise

LABEL = "label"
FEATURES = "features"


# ---------------------------------------------------------------------------
# Feature frames

def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage before iterative fitting: the frame is written once as a table in
    the session's checkpoint folder (shared storage on a cluster), so repeated
    passes and lost executors read it instead of recomputing the upstream plan."""
    return _materialise(df, "model-input")


def assemble(df: DataFrame, cols: Sequence[str], label: str, missing: float = -1.0) -> DataFrame:
    """Vector of numeric columns (missing → ``missing``) and a 0/1 double label."""
    filled = df.na.fill(missing, subset=list(cols))
    va = VectorAssembler(inputCols=list(cols), outputCol=FEATURES)
    return va.transform(filled).withColumn(LABEL, F.col(label).cast("double"))


def array_features(df: DataFrame, col: str, label: str) -> DataFrame:
    """Vector from an ``array<double>`` column and a 0/1 double label."""
    return df.withColumn(FEATURES, array_to_vector(col)).withColumn(LABEL, F.col(label).cast("double"))


# ---------------------------------------------------------------------------
# Estimators with the reference's settings

def logistic(c: float = 0.9, n_train: int | None = None) -> LogisticRegression:
    """L2 logistic regression. ``C`` penalises a summed loss, Spark's regParam a
    mean loss: regParam = 1 / (C · n)."""
    reg = 1.0 / (c * n_train) if n_train else 1.0 / c
    return LogisticRegression(regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=200)


MAX_DEPTH = 30  # Spark's limit; the reference bounds its trees by leaf size only


def decision_tree(min_leaf: int = 50, depth: int = MAX_DEPTH) -> DecisionTreeClassifier:
    """At most ``depth`` levels of splits."""
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=min_leaf, seed=42)


def random_forest(trees: int = 200, min_leaf: int = 50, depth: int = MAX_DEPTH) -> RandomForest:
    """Trees of at most ``depth`` levels of splits."""
    return RandomForest(trees, min_leaf, depth, seed=42, features=FEATURES, label=LABEL)


def boosting(rounds: int = 200, min_leaf: int = 50, depth: int = 3) -> GBTClassifier:
    """``depth`` is the reference library's default for boosting."""
    return GBTClassifier(maxIter=rounds, maxDepth=depth, minInstancesPerNode=min_leaf, seed=42)


class CalibratedSVC:
    """Linear SVM (L2; Spark has no L1 SVM) with a logistic calibration of its margin."""

    def __init__(self, c: float = 0.78, n_train: int | None = None) -> None:
        self.svc = LinearSVC(regParam=1.0 / (c * n_train) if n_train else 1.0 / c, maxIter=200)

    def fit(self, train: DataFrame) -> "CalibratedSVC":
        self.svc_model = self.svc.fit(train)
        margin = self._margin(self.svc_model.transform(train))
        self.cal = without_summary(LogisticRegression(featuresCol="_m", regParam=0.0).fit(margin))
        return self

    @staticmethod
    def _margin(pred: DataFrame) -> DataFrame:
        raw = vector_to_array("rawPrediction")
        return pred.drop("prediction", "probability").withColumn(
            "_m", array_to_vector(F.array(raw[1] - raw[0]))
        ).drop("rawPrediction")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.cal.transform(self._margin(self.svc_model.transform(df))).drop("_m")


def positive_probability(pred: DataFrame) -> DataFrame:
    """Add ``p1`` = probability of class 1 from a Spark ML prediction frame (a model may have added it already)."""
    return pred if "p1" in pred.columns else pred.withColumn("p1", vector_to_array("probability")[1])


# ---------------------------------------------------------------------------
# Validation (M5, M6)

Fitter = Callable[[DataFrame], object]


def _fit(est: Estimator | CalibratedSVC, train: DataFrame):
    return without_summary(est.fit(train))


def without_summary(model):
    """A fitted logistic regression without its training summary.

    The summary holds the session, and a session in which a query was observed
    (``DataFrame.observe``) cannot be sent to tasks with the model.
    """
    java = getattr(model, "_java_obj", None)
    if java is not None and getattr(model, "hasSummary", False):
        java.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def validate(est, train: DataFrame, valid: DataFrame) -> DataFrame:
    """M6: fit on ``train``, score ``valid``: one row (n, accuracy, auc)."""
    model = _fit(est, train)
    pred = positive_probability(model.transform(valid))
    return M.accuracy_auc(pred, F.col("prediction") == F.lit(1.0), "p1", F.col(LABEL) == F.lit(1.0))


PARALLEL_FITS = 4  # fits that the driver starts side by side; each is a Spark job of its own


def _side_by_side(tasks: Sequence[Callable[[], object]]) -> list:
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return list(pool.map(lambda t: t(), tasks))


def predictions(models: dict[str, Callable[[DataFrame], object]], folds: Sequence[tuple[int, DataFrame, DataFrame]], key: str) -> DataFrame:
    """M5 / M7: one long table (model, fold, key, label, prediction, p1) of every model on every fold.

    ``models``: name → a function that fits on a training frame and returns
    something with ``transform``. ``folds``: (number, training rows, rows to
    predict). Models and folds are fitted side by side.
    """

    def scored(name: str, fit: Callable[[DataFrame], object], fold: int, train: DataFrame, test: DataFrame) -> DataFrame:
        out = without_summary(fit(train)).transform(test)
        return positive_probability(out).select(
            F.lit(name).alias("model"), F.lit(fold).alias("fold"), F.col(key), F.col(LABEL).cast("double").alias(LABEL), F.col("prediction").cast("double").alias("prediction"), "p1"
        )

    frames = _side_by_side([lambda n=n, f=f, x=x: scored(n, f, *x) for n, f in models.items() for x in folds])
    long = frames[0]
    for f in frames[1:]:
        long = long.unionByName(f)
    return _materialise(long, "predictions")


def fold_pairs(df: DataFrame, fold_col: str, k: int) -> list[tuple[int, DataFrame, DataFrame]]:
    """(fold, all other rows, its rows) of a stored frame."""
    return [(f, df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)) for f in range(k)]


def evaluation(long: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """M6 / M7: n, accuracy and AUC of each model (or model and fold) of a table of predictions."""
    return M.accuracy_auc(long, F.col("prediction") == 1.0, "p1", F.col(LABEL) == 1.0, by)


def model_roc(long: DataFrame) -> DataFrame:
    """M7: ROC points of each model of a table of predictions."""
    return M.roc_points(long, "p1", F.col(LABEL) == 1.0, ["model"])


def cross_val_accuracy(est, df: DataFrame, fold_col: str = "fold", k: int = 5) -> DataFrame:
    """M5: refit on all folds but one, accuracy on the held-out fold; one row per fold.

    The folds are fitted side by side; the loop is over k fits, not over data.
    """
    df = materialise(df)

    def held_out(f: int, train: DataFrame, test: DataFrame) -> tuple[int, float]:
        return f, M.accuracy(_fit(est, train).transform(test), "prediction", LABEL).first()["accuracy"]

    rows = _side_by_side([lambda x=x: held_out(*x) for x in fold_pairs(df, fold_col, k)])
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


# ---------------------------------------------------------------------------
# SPD matrix geometry

def _sym_fn(mats: np.ndarray, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Apply a scalar function to the eigenvalues of a stack of symmetric matrices."""
    w, v = np.linalg.eigh(mats)
    return (v * fn(w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def logm(m):
    return _sym_fn(m, np.log)


def expm(m):
    return _sym_fn(m, np.exp)


def sqrtm(m):
    return _sym_fn(m, np.sqrt)


def invsqrtm(m):
    return _sym_fn(m, lambda w: 1.0 / np.sqrt(w))


def _stack(s: pd.Series, nv: int) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in s]).reshape(-1, nv, nv)


def _flat(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("_flat", F.flatten(col))


def _elementwise_mean(df: DataFrame, col: str, by: str | None = None) -> dict:
    """Average of an array column element by element (partial aggregation) → {group: np.array}."""
    keys = [by] if by else []
    # outer form: no inferred size() filter that would evaluate the producing UDF twice
    ex = df.select(*keys, F.posexplode_outer(col).alias("_k", "_x")).where(F.col("_k").isNotNull())
    res = ex.groupBy(*keys, "_k").agg(F.avg("_x").alias("_m")).collect()  # groups × VOI² rows
    out: dict = {}
    for r in res:
        g = r[by] if by else None
        out.setdefault(g, {})[r["_k"]] = r["_m"]
    return {g: np.array([d[k] for k in sorted(d)]) for g, d in out.items()}


def _map_matrices(df: DataFrame, col: str, nv: int, fn: Callable[[np.ndarray, pd.DataFrame], np.ndarray],
                  extra: Sequence[str] = ()) -> DataFrame:
    """Add ``_out`` (flattened matrices) = fn(stack of matrices, batch) via an Arrow-batched UDF."""

    @F.pandas_udf("array<double>")
    def udf(flat: pd.Series, batch: pd.DataFrame) -> pd.Series:
        mats = _stack(flat, nv)
        out = fn(mats, batch)
        return pd.Series(list(out.reshape(len(mats), -1)))

    extra_col = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(0).alias("_none"))
    return df.withColumn("_out", udf(F.col(col), extra_col))


def riemann_mean(df: DataFrame, col: str, nv: int, tol: float = 1e-8, max_iter: int = 50) -> np.ndarray:
    """Riemannian (affine-invariant) mean of SPD matrices ``col`` (flattened rows).

    Raises ``NotSettled`` if the last of ``max_iter`` rounds still moves by ``tol`` or more.
    """
    m = _elementwise_mean(df, col)[None].reshape(nv, nv)
    for _ in range(max_iter):
        isq = invsqrtm(m)
        mapped = _map_matrices(df, col, nv, lambda mats, _b, isq=isq: logm(isq @ mats @ isq))
        j = _elementwise_mean(mapped, "_out")[None].reshape(nv, nv)
        sq = sqrtm(m)
        m = sq @ expm(j) @ sq
        if np.linalg.norm(j) < tol:
            return m
    raise NotSettled(f"Riemannian mean: step of {np.linalg.norm(j):.3g} after {max_iter} rounds, tolerance {tol:g}")


def tangent_space(df: DataFrame, cov: str, nv: int, out: str = "tangent", mean: np.ndarray | None = None):
    """Map each matrix to the tangent space at the mean (upper triangle, √2 off the diagonal).

    Returns (frame with ``out`` array<double>, reference matrix).
    """
    base = materialise(_flat(df, cov))  # iterations read this, not the upstream plan
    ref = riemann_mean(base, "_flat", nv) if mean is None else mean
    isq = invsqrtm(ref)
    # a symmetric matrix has the length of the vector of its diagonal and sqrt 2 times what is above it
    places = [(i, j) for i in range(nv) for j in range(i, nv)]
    rows, cols = np.array(places).T
    weight = np.array([1.0 if i == j else 2.0**0.5 for i, j in places])
    res = _map_matrices(base, "_flat", nv, lambda mats, _b: logm(isq @ mats @ isq)[:, rows, cols] * weight)
    return res.withColumnRenamed("_out", out).drop("_flat"), ref


def wasserstein_class_means(df: DataFrame, col: str, label: str, nv: int, tol: float = 1e-3, max_iter: int = 50) -> dict:
    """Wasserstein (Bures) mean per class by the fixed-point iteration K ← sqrt(mean sqrt(K C K)).

    Raises ``NotSettled`` as ``riemann_mean`` does.
    """
    means = {g: v.reshape(nv, nv) for g, v in _elementwise_mean(df, col, label).items()}
    ks = {g: sqrtm(m) for g, m in means.items()}
    for _ in range(max_iter):
        kmap = dict(ks)

        def step(mats, batch, kmap=kmap):
            k = np.stack([kmap[g] for g in batch[label]])
            return sqrtm(k @ mats @ k)

        mapped = _map_matrices(df, col, nv, step, extra=[label])
        js = {g: v.reshape(nv, nv) for g, v in _elementwise_mean(mapped, "_out", label).items()}
        new = {g: sqrtm(js[g]) for g in js}
        crit = max(np.linalg.norm(new[g] - ks[g]) for g in new)
        ks = new
        if crit < tol:
            return {g: k @ k for g, k in ks.items()}
    raise NotSettled(f"Wasserstein mean: step of {crit:.3g} after {max_iter} rounds, tolerance {tol:g}")


def wasserstein_distance2(mats: np.ndarray, ref: np.ndarray) -> np.ndarray:
    r = sqrtm(ref)
    inner = sqrtm(r @ mats @ r)
    d2 = np.trace(mats, axis1=-2, axis2=-1) + np.trace(ref) - 2 * np.trace(inner, axis1=-2, axis2=-1)
    return np.maximum(d2, 0.0)


def nearest_mean(train: DataFrame, test: DataFrame, cov: str, label: str, nv: int) -> DataFrame:
    """Minimum distance to class mean (Wasserstein metric); probabilities = softmax(−d²).

    Adds ``prediction`` (class with the nearest mean) and ``p1``.
    """
    base = materialise(_flat(train, cov))
    means = wasserstein_class_means(base, "_flat", label, nv)
    classes = sorted(means)

    def score(mats, _b):
        d2 = np.stack([wasserstein_distance2(mats, means[c]) for c in classes], axis=1)
        z = -d2 - (-d2).max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        return p

    res = _map_matrices(_flat(test, cov), "_flat", nv, lambda mats, b: score(mats, b))
    probs = F.col("_out")
    pos = classes.index(True) if True in classes else len(classes) - 1
    pred_idx = F.array_position(probs, F.array_max(probs)) - 1
    cls = F.element_at(F.array(*[F.lit(c) for c in classes]), (pred_idx + 1).cast("int"))
    return res.withColumn("prediction", cls.cast("double")).withColumn("p1", probs[pos]).drop("_out", "_flat")
