import pytest

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.schema.simpleString() == (
        "struct<n_cases:bigint,n_present:bigint,n_counted:bigint,n_aged:bigint,n_dead_aged:bigint,"
        "n_long:bigint,n_dead_long:bigint,pct_dead_aged:double,pct_dead_long:double>"
    )
    r = rows[0]
    assert r.n_cases >= r.n_present >= r.n_counted and r.n_long <= r.n_aged


def test_registry_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


@pytest.mark.parametrize("name", ["cohort_funnel", "wave_matrix", "accuracy_auc", "case_covariance", "label_encode"])
def test_oracle_small(spark, name):
    import oracle_compare as OC

    r = OC.compare(spark, name, E.queries()[name], E.oracle_sql().get(name), "/root/testdata/sf0.001")
    assert r["status"] == "match", r
