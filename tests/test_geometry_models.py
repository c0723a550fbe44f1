"""Closed-form 2 x 2 geometry, neighbours, the L1 machine, and evaluation of several models."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortspark.operators import folds as FO
from cohortspark.operators import models as MO
from cohortspark.operators import neighbours as NB
from cohortspark.operators import spd as SPD
from cohortspark.operators import svm as SV


def random_spd(rng, n, size):
    a = rng.normal(size=(n, size, size + 2))
    return a @ np.swapaxes(a, 1, 2) / size + 0.1 * np.eye(size)


def frame(spark, mats, labels=None):
    rows = [(i, m.tolist(), bool(labels[i]) if labels is not None else False) for i, m in enumerate(mats)]
    return spark.createDataFrame(rows, "case_id long, cov array<array<double>>, dead boolean")


def pairs(df):
    return df.select("case_id", "dead", SPD.Sym.of(F.col("cov")).struct().alias("m"))


# ---------------------------------------------------------------------------
# 2 x 2 geometry


def test_functions_of_matrices(spark):
    rng = np.random.default_rng(1)
    mats = np.concatenate([random_spd(rng, 30, 2), [np.eye(2), 5 * np.eye(2), np.diag([1e-6, 1e6]), [[1, 1 - 1e-9], [1 - 1e-9, 1]]]])
    df = pairs(frame(spark, mats))
    m = SPD.Sym.column("m")
    got = df.select("case_id", F.array(*SPD.log(m)).alias("log"), F.array(*SPD.sqrt(m)).alias("root")).orderBy("case_id").collect()
    for r, x in zip(got, mats):
        for name, f in (("log", MO.logm), ("root", MO.sqrtm)):
            want = f(x)
            np.testing.assert_allclose(r[name], [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-6, atol=1e-7)


def test_closed_form_agrees_with_decomposition(spark):
    rng = np.random.default_rng(2)
    labels = np.arange(80) % 2 == 0
    mats = random_spd(rng, 80, 2) * np.where(labels, 1.0, 3.0)[:, None, None]
    df = frame(spark, mats, labels)
    flat = MO._flat(df, "cov")
    mean = SPD.affine_mean(pairs(df), "m")
    want = MO.riemann_mean(flat, "_flat", 2)
    np.testing.assert_allclose(mean, [want[0, 0], want[0, 1], want[1, 1]], rtol=1e-7)
    t, _ = MO.tangent_space(df, "cov", 2, mean=want)
    ours = {r.case_id: r.tangent for r in SPD.tangent(pairs(df), "m", mean).collect()}
    for r in t.collect():
        np.testing.assert_allclose(ours[r.case_id], r.tangent, atol=1e-6)
    means = SPD.wasserstein_means(pairs(df), "m", "dead")
    for g, w in MO.wasserstein_class_means(flat, "_flat", "dead", 2, tol=1e-10).items():
        np.testing.assert_allclose(means[g], [w[0, 0], w[0, 1], w[1, 1]], rtol=1e-6)
    a = {r.case_id: (r.prediction, r.p1) for r in SPD.nearest_mean(pairs(df), pairs(df), "m", "dead").collect()}
    for r in MO.nearest_mean(df, df, "cov", "dead", 2).collect():
        assert a[r.case_id][0] == r.prediction and a[r.case_id][1] == pytest.approx(r.p1, abs=1e-3)


def test_means_that_do_not_settle_raise(spark):
    df = frame(spark, random_spd(np.random.default_rng(3), 20, 2))
    flat = MO._flat(df, "cov")
    for mean in (
        lambda: SPD.affine_mean(pairs(df), "m", max_iter=1),
        lambda: SPD.wasserstein_means(pairs(df), "m", "dead", max_iter=1),
        lambda: MO.riemann_mean(flat, "_flat", 2, max_iter=1),
        lambda: MO.wasserstein_class_means(flat, "_flat", "dead", 2, tol=1e-9, max_iter=1),
    ):
        with pytest.raises(SPD.NotSettled):
            mean()


# ---------------------------------------------------------------------------
# Neighbours


def plain_distance(a, b):
    w = np.linalg.eigvals(np.linalg.solve(a, b)).real
    return np.sqrt((np.log(w) ** 2).sum())


@pytest.mark.parametrize("size, block", [(2, 1 << 20), (4, 400)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, size, block):
    rng = np.random.default_rng(4)
    centres = random_spd(rng, 6, size) * rng.uniform(0.2, 20, 6)[:, None, None]
    noise = random_spd(rng, 240, size) * 0.05
    mats = centres[rng.integers(6, size=240)] + noise
    labels = rng.random(240) < 0.5
    df = frame(spark, mats, labels).repartition(3)
    report = {}
    got = NB.nearest_neighbours(df, df.where("case_id < 40"), "cov", "case_id", "dead", size, 5, block_bytes=block, report=report)
    found = {}
    for r in got.orderBy("case_id", "rank").collect():
        found.setdefault(r.case_id, []).append((r.neighbour, r.distance, r.neighbour_label))
    for q in range(40):
        want = sorted((plain_distance(mats[q], mats[x]), x) for x in range(240) if x != q)[:5]
        assert [n for n, _, _ in found[q]] == [x for _, x in want]
        np.testing.assert_allclose([d for _, d, _ in found[q]], [d for d, _ in want], rtol=1e-6)
        assert [lab for _, _, lab in found[q]] == [int(labels[x]) for _, x in want]
    assert len(found) == 40 and 0 < report["compared"] < 0.7 * report["pairs"]
    votes = {r.case_id: (r.prediction, r.p1) for r in NB.neighbour_vote(got, "case_id").collect()}
    assert all(votes[q] == (float(sum(x[2] for x in found[q]) > 2), sum(x[2] for x in found[q]) / 5) for q in range(40))
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_few_equal_and_broken_rows(spark):
    eye = np.eye(2).tolist()
    rows = [(1, eye, True), (2, eye, False), (3, [[2.0, None], [None, 1.0]], True), (4, None, False), (5, [[2.0, 0.0], [0.0, 2.0]], True)]
    df = spark.createDataFrame(rows, "case_id long, cov array<array<double>>, dead boolean")
    got = NB.nearest_neighbours(df, df, "cov", "case_id", "dead", 2, 5).orderBy("case_id", "rank").collect()
    assert [(r.case_id, r.neighbour) for r in got] == [(1, 2), (1, 5), (2, 1), (2, 5), (5, 1), (5, 2)]
    assert NB.nearest_neighbours(df.limit(0), df, "cov", "case_id", "dead", 2).count() == 0


def test_copies_of_a_matrix_are_not_compared_with_each_other(spark):
    rng = np.random.default_rng(8)
    mats = random_spd(rng, 420, 3)
    mats[20:] = mats[3]
    labels = rng.random(420) < 0.5
    df, report = frame(spark, mats, labels).repartition(3), {}
    got = NB.nearest_neighbours(df, df.where("case_id < 4 or case_id >= 380"), "cov", "case_id", "dead", 3, 5, report=report)
    found = {}
    for r in got.orderBy("case_id", "rank").collect():
        found.setdefault(r.case_id, []).append(r.neighbour)
    assert all(found[q] == [3, 20, 21, 22, 23] for q in range(380, 420)) and found[3] == [20, 21, 22, 23, 24]
    for q in (0, 1, 2):
        want = sorted((round(plain_distance(mats[q], mats[x]), 9), x) for x in range(420) if x != q)[:5]
        assert found[q] == [x for _, x in want]
    # each copy asks the first copies only, not all 400; before: most of all pairs
    assert report["compared"] < 0.1 * report["pairs"]


# ---------------------------------------------------------------------------
# L1 machine


def machine_frame(spark, x, y):
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "case_id long, x array<double>, label double")
    return df.withColumn("features", array_to_vector("x")).repartition(3)


def objective(w, x, y, c):
    x1 = np.hstack([x, np.ones((len(x), 1))])
    return np.abs(w).sum() + c * (np.maximum(0, 1 - np.where(y > 0, 1, -1) * (x1 @ w)) ** 2).sum()


def plain_optimum(x, y, c, rounds=200_000):
    """Accelerated proximal gradient steps until nothing moves."""
    x1, s = np.hstack([x, np.ones((len(x), 1))]), np.where(y > 0, 1.0, -1.0)
    bend = 2 * c * np.linalg.eigvalsh(x1.T @ x1).max()
    w = z = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(rounds):
        g = -2 * c * x1.T @ (s * np.maximum(0, 1 - s * (x1 @ z)))
        v = z - g / bend
        new = np.sign(v) * np.maximum(np.abs(v) - 1 / bend, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, moved = new + (t - 1) / t2 * (new - w), np.abs(new - w).max()
        w, t = new, t2
        if moved < 1e-13:
            break
    return w


@pytest.mark.parametrize("c", [0.005, 0.05, 0.78])
def test_machine_reaches_the_optimum(spark, c):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6)) * [1, 1, 1, 0.3, 2, 1]
    y = (x[:, 0] - 0.7 * x[:, 1] + 0.3 * rng.normal(size=150) > 0.2).astype(float)
    machine = SV.L1SVC(c).fit(machine_frame(spark, x, y))
    ours, best = np.append(machine.weights, machine.intercept), plain_optimum(x, y, c)
    assert objective(ours, x, y, c) == pytest.approx(objective(best, x, y, c), rel=1e-8)
    np.testing.assert_allclose(ours, best, atol=1e-4)
    if c < 0.01:
        assert (ours == 0).sum() >= 3  # the penalty leaves features out
    margins = {r.case_id: r.margin for r in machine.margin(machine_frame(spark, x, y)).collect()}
    np.testing.assert_allclose([margins[i] for i in range(150)], x @ machine.weights + machine.intercept, rtol=1e-9)


def test_machine_is_calibrated_out_of_fold(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + rng.normal(size=240) > 0).astype(float)
    df = machine_frame(spark, x, y)
    seen = []
    fit = SV.L1SVC.fit
    monkeypatch.setattr(SV.L1SVC, "fit", lambda self, rows: seen.append({r.case_id for r in rows.select("case_id").collect()}) or fit(self, rows))
    model = SV.CalibratedL1SVC("case_id", 0.78, 3).fit(df)
    folds = {r.case_id: r.fold for r in FO.stratified_folds(df.select("case_id", "label"), "label", ["case_id"], 3).collect()}
    assert [s for s in seen] == [{i for i, f in folds.items() if f != k} for k in range(3)]
    out = model.transform(df).select("label", "p1", "prediction").toPandas()
    assert abs(out["p1"].mean() - y.mean()) < 0.05 and ((out["p1"] > 0.5) == (out["prediction"] == 1)).all()
    # as good as the rule that made the labels, but for the noise
    assert (out["prediction"] == out["label"]).mean() > ((x[:, 0] > 0) == (y == 1)).mean() - 0.05
    assert MO.validate(model_of(model), df, df).first().auc > 0.75


def model_of(fitted):
    class Fitted:
        def fit(self, _):
            return fitted

    return Fitted()


# ---------------------------------------------------------------------------
# Evaluation of several models


def test_predictions_and_evaluation_of_several_models(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=150) > 0).astype(float)
    df = MO.materialise(machine_frame(spark, x, y).withColumn("fold", (F.col("case_id") % 3).cast("int")))
    long = MO.predictions({"a": MO.logistic(1.0, 100).fit, "b": MO.decision_tree(10).fit}, MO.fold_pairs(df, "fold", 3), "case_id")
    assert long.count() == 300 and long.where("case_id % 3 != fold").count() == 0
    rows = long.toPandas()
    for r in MO.evaluation(long).collect():
        own = rows[rows["model"] == r.model]
        pos, neg = own[own["label"] == 1]["p1"].to_numpy(), own[own["label"] == 0]["p1"].to_numpy()
        auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert r.n == 150 and r.auc == pytest.approx(auc) and r.accuracy == pytest.approx((own["prediction"] == own["label"]).mean())
    assert MO.evaluation(long, ["model", "fold"]).count() == 6
    roc = MO.model_roc(long).toPandas()
    assert set(roc["model"]) == {"a", "b"} and roc.groupby("model")["tpr"].max().eq(1).all()
