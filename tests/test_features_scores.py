from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import features as FE
from cohortspark.operators import scores as SC
from cohortspark.functions import scalar as FX


def test_minmax_per_point_and_covariance(spark):
    rnd = np.random.default_rng(0)
    X = rnd.normal(size=(3, 5, 20))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(3)], "case_id long, series array<array<double>>")
    out = FE.add_covariance(FE.scale_points(df), "scaled", "cov", ddof=0, alpha=1.0).orderBy("case_id").collect()
    for i, r in enumerate(out):
        mn, mx = X[i].min(axis=0), X[i].max(axis=0)
        sc = (X[i] - mn) / (mx - mn)
        np.testing.assert_allclose(np.array(r.scaled), sc, atol=1e-12)
        np.testing.assert_allclose(np.array(r.cov), np.cov(sc, bias=True) + np.eye(5), atol=1e-12)
        c = np.array(r.cov)
        assert np.allclose(c, c.T) and (np.diag(c) >= 0).all()


def test_constant_point_and_nulls(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0, None], [1.0, 4.0, 3.0]])], "case_id long, series array<array<double>>")
    r = FE.add_covariance(FE.scale_points(df), "scaled", "cov", ddof=1).first()
    assert r.scaled == [[0.0, 0.0, None], [0.0, 1.0, 0.0]]
    # pairs with a null are skipped: two points left for (0, 1)
    assert r.cov[0][1] == pytest.approx(np.cov([0.0, 0.0], [0.0, 1.0])[0, 1])


def test_form_matrix_key_wildcard_and_duplicates(spark):
    rows = [
        (1, "123", "int_esc_age", "5", None, date(2024, 1, 2)),
        (1, "123", "int_igs2", "40", None, date(2024, 1, 2)),
        (2, "4_5", "int_esc_age", "7", date(2024, 3, 1), date(2024, 3, 2)),
        (2, "4_5", "int_esc_age", "9", date(2024, 3, 1), date(2024, 3, 2)),  # duplicate field
        (3, "9", "intXescXage", "1", None, date(2024, 1, 1)),  # matches 'int_esc%' through the '_' wildcard
        (4, "9", "other", "1", None, date(2024, 1, 1)),
    ]
    forms = spark.createDataFrame(rows, "id_form long, id_nda string, champ_formulaire string, value_field string, j1 date, dt_ins date")
    m = {r.id_form_ndaj1: r for r in SC.form_matrix(forms, ["int_esc_age", "int_igs2"]).collect()}
    assert set(m) == {"1232024-01-02_1", "4_52024-03-01_2", "92024-01-01_3"}
    assert m["4_52024-03-01_2"].id_ndaj1 == "4_52024-03-01"  # greedy prefix before the last '_'
    assert m["1232024-01-02_1"].int_igs2 == "40"
    dups = SC.form_duplicates(SC.form_long(forms)).collect()
    assert [(d.id_form_ndaj1, d.n) for d in dups] == [("4_52024-03-01_2", 2)]
    key = spark.createDataFrame([("4_52024-03-01",)], "k string")
    assert key.select(SC.stay_of_case_key("k").alias("s")).first().s == "4_5"


def test_severity_and_label_order(spark):
    df = spark.createDataFrame([("a", "40", None), ("b", "0", date(2024, 1, 1))], "id_ndaj1 string, int_igs2 string, dt_deces date")
    r = {x.id_ndaj1: x for x in SC.severity_score(df).collect()}
    logit = -7.7631 + 0.0737 * 40 + 0.9971 * np.log(41)
    assert r["a"].pr == pytest.approx(np.exp(logit) / (1 + np.exp(logit)))
    assert r["b"].y_true is True and r["a"].y_pred is False
    cat = spark.createDataFrame([("X", 1, "0"), ("X", 2, "10"), ("X", 3, "2")], "PARENT string, index int, saps2weight string")
    codes = {x.label: x.code for x in SC.catalogue_codes(cat).collect()}
    assert codes == {"0": 0, "10": 1, "2": 2}  # text order
    assert [r["index"] for r in SC.sorted_catalogue(cat).collect()] == [1, 2, 3]


def test_case_key_split_rules(spark):
    df = spark.createDataFrame([("12345672015-09-06",), ("762015-09-06",), ("bad",)], "k string")
    strict = df.select(*FX.split_case_key("k")).collect()
    assert strict[0].id_nda == "1234567" and strict[0].j1 == "2015-09-06"
    assert strict[1].id_nda is None and strict[2].j1 is None
    loose = df.select(*FX.split_case_key("k", id_digits=None)).collect()
    assert loose[1].id_nda == "76"
