import numpy as np
import pytest

from cohortspark.operators import models as MO


def _diag_frame(spark, diags, labels=None):
    rows = []
    for i, d in enumerate(diags):
        m = np.diag(d).tolist()
        rows.append((i, m, bool(labels[i]) if labels is not None else False))
    return spark.createDataFrame(rows, "case_id long, cov array<array<double>>, dead boolean")


def test_riemann_mean_of_diagonals_is_geometric_mean(spark):
    rnd = np.random.default_rng(1)
    diags = rnd.uniform(0.5, 3.0, size=(40, 3))
    df = _diag_frame(spark, diags)
    t, ref = MO.tangent_space(df, "cov", 3)
    np.testing.assert_allclose(np.diag(ref), np.exp(np.log(diags).mean(axis=0)), rtol=1e-7)
    # tangent vectors at the mean average to ~0
    vecs = np.array([r.tangent for r in t.collect()])
    assert vecs.shape == (40, 6)
    np.testing.assert_allclose(vecs.mean(axis=0), 0, atol=1e-6)


def test_wasserstein_means_and_nearest_mean(spark):
    rnd = np.random.default_rng(2)
    a = rnd.uniform(0.5, 1.0, size=(30, 2))
    b = rnd.uniform(3.0, 4.0, size=(30, 2))
    diags = np.vstack([a, b])
    labels = [False] * 30 + [True] * 30
    df = _diag_frame(spark, diags, labels)
    flat = MO._flat(df, "cov")
    means = MO.wasserstein_class_means(flat, "_flat", "dead", 2, tol=1e-10)
    np.testing.assert_allclose(np.diag(means[False]), np.sqrt(a).mean(axis=0) ** 2, rtol=1e-6)
    np.testing.assert_allclose(np.diag(means[True]), np.sqrt(b).mean(axis=0) ** 2, rtol=1e-6)
    pred = MO.nearest_mean(df, df, "cov", "dead", 2).collect()
    assert all((r.prediction == 1.0) == r.dead for r in pred)
    assert all((r.p1 > 0.5) == r.dead for r in pred)


def test_cross_val_and_validate(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(200, 2))
    y = (x[:, 0] + 0.1 * rnd.normal(size=200)) > 0
    df = spark.createDataFrame([(i, float(a), float(b), bool(t), i % 5) for i, ((a, b), t) in enumerate(zip(x, y))],
                               "id long, a double, b double, y boolean, fold int")
    feats = MO.assemble(df, ["a", "b"], "y")
    accs = MO.cross_val_accuracy(MO.logistic(1.0, 160), feats, "fold", 5).collect()
    assert len(accs) == 5 and min(r.accuracy for r in accs) > 0.8
    r = MO.validate(MO.logistic(1.0, 160), feats.where("fold != 0"), feats.where("fold = 0")).first()
    assert r.n == 40 and r.auc > 0.9


def test_trees_grow_until_leaves_are_small(spark):
    """32 alternating steps of 100 rows: five levels of greedy splits do not separate them, leaves of 50 rows do."""
    df = spark.createDataFrame([(i, float(i % 32), i % 2 == 1) for i in range(3200)], "id long, a double, y boolean")
    feats = MO.assemble(df, ["a"], "y").cache()
    tree, forest = MO.decision_tree(50).fit(feats), MO.random_forest(3, 50).fit(feats)
    assert tree.depth > 5 and max(t.depth for t in forest.trees) > 5
    wrong = tree.transform(feats).where("prediction != label").count()
    assert wrong < MO.decision_tree(50, depth=5).fit(feats).transform(feats).where("prediction != label").count()
    assert MO.decision_tree(50, depth=2).fit(feats).depth == 2
    assert MO.boosting(2).getMaxDepth() == 3


def test_identity_matrices(spark):
    df = _diag_frame(spark, np.ones((8, 3)))
    t, ref = MO.tangent_space(df, "cov", 3)
    np.testing.assert_allclose(ref, np.eye(3), atol=1e-12)
    assert all(np.allclose(r.tangent, 0.0) for r in t.collect())
