"""Strict pivot, label maps, one-pass histogram, stable covariance, block-wise dataset."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortspark.operators import features as FE
from cohortspark.operators import folds as FO
from cohortspark.operators import profile as P
from cohortspark.operators import scores as SC
from cohortspark.sources import io as IO

FORMS = "id_form long, id_nda string, champ_formulaire string, value_field string, j1 date, dt_ins date"


def test_strict_pivot_raises_on_duplicates(spark):
    import datetime as dt

    day = dt.date(2024, 1, 1)
    rows = [(1, "7", "int_esc_age", "a", day, day), (1, "7", "int_esc_uree", "b", day, day)]
    ok = spark.createDataFrame(rows, FORMS)
    assert SC.form_matrix(ok, ["int_esc_age", "int_esc_uree"], strict=True).first().int_esc_uree == "b"
    twice = spark.createDataFrame([*rows, (1, "7", "int_esc_age", "c", day, day)], FORMS)
    with pytest.raises(PySparkException, match="int_esc_age has several rows in form 1"):
        SC.form_matrix(twice, ["int_esc_age"], strict=True).collect()
    assert SC.form_matrix(twice, ["int_esc_age"]).first().int_esc_age == "c"
    # the field with duplicates is not asked for: nothing is ambiguous
    assert SC.form_matrix(twice, ["int_esc_uree"], strict=True).first().int_esc_uree == "b"
    assert SC.form_duplicates(SC.form_long(twice)).collect()[0].n == 2


def test_long_form_of_a_stored_matrix_gives_the_same_catalogue(spark):
    import datetime as dt

    day, fields = dt.date(2024, 1, 1), ["int_esc_age", "int_esc_uree", "int_igs2"]
    rows = [(f, "7", name, v, None, day) for f in (1, 2, 3) for name, v in zip(fields, (f"a{f % 2}", None if f == 2 else "b", str(f)))]
    forms = spark.createDataFrame([*rows, (4, None, "int_esc_age", "only here", day, day)], FORMS)
    matrix = SC.form_matrix(forms, fields, strict=True)
    long = SC.form_long(None, matrix=matrix, fields=fields)
    want = {tuple(r) for r in SC.form_long(forms).where("value_field is not null").collect()}
    assert {tuple(r) for r in long.collect()} == want and len(want) == 9 and long.count() == 9
    codes = lambda x: {tuple(r) for r in SC.catalogue_codes(SC.catalogue_from_values(x)).collect()}
    assert codes(long) == codes(SC.form_long(forms)) and ("int_esc_age", "only here", 2) in codes(long)


def test_model_data_compute_the_forms_once(spark, monkeypatch, tmp_path):
    """Before, the catalogue computed the forms' rows a second time and the target the outcome a second time."""
    import datetime as dt

    from cohortspark.plans import registry as R

    day = dt.date(2024, 1, 1)
    rows = [(i, str(i), f, str((i * k) % 5), day, day) for i in range(12) for k, f in enumerate(R.FIELDS, 1)]
    monkeypatch.setattr(R.SI, "forms", lambda *_: spark.createDataFrame(rows, FORMS))
    monkeypatch.setattr(R.SI, "movements", lambda *_: spark.createDataFrame([(str(i), i) for i in range(12)], "id_nda string, ids_pat long"))
    monkeypatch.setattr(R.SI, "patients", lambda *_: spark.createDataFrame([(i, day if i % 2 else None) for i in range(12)], "ids_pat long, dt_deces date"))
    calls = []
    form_rows = SC.form_rows
    monkeypatch.setattr(SC, "form_rows", lambda forms: calls.append(1) or form_rows(forms))
    train, valid = R._form_dataset(spark, "")
    assert train.count() + valid.count() == 12 and len(calls) == 1


CATALOGUE = [("AGE", 1, "<40"), ("AGE", 2, "40-59"), ("AGE", 3, ">=60"), ("AGE", 4, "<40"), ("UREE", 1, "0"), ("UREE", 2, None), ("PAO2/FIO2", 1, "x")]


@pytest.mark.parametrize("limit", [20_000, 2])
def test_label_encode_and_unseen_texts(spark, monkeypatch, limit):
    """The same codes by map and, for a catalogue over the limit, by join; unseen texts null, counted, or raised."""
    monkeypatch.setattr(SC, "MAP_CATEGORIES", limit)
    catalogue = spark.createDataFrame(CATALOGUE, "PARENT string, index int, saps2weight string")
    rows = [("f1", "<40", "0", "x"), ("f2", ">=60", None, "y"), ("f3", "new", "0", None), ("f4", "40-59", "new", "x")]
    m = spark.createDataFrame(rows, "key string, int_esc_age string, int_esc_uree string, int_esc_pao2 string")
    m = SC.rename_fields(m)
    assert m.columns == ["key", "AGE", "UREE", "PAO2/FIO2"]
    seen = Observation()
    got = {tuple(r) for r in SC.label_encode(m, "key", m.columns[1:], catalogue, report=seen).collect()}
    # codes by the order of the texts: 40-59 < <40 < >=60
    assert got == {("f1", 1, 0, 0), ("f2", 2, None, None), ("f3", None, 0, None), ("f4", 0, None, 0)}
    assert seen.get == {"AGE": 1, "UREE": 1, "PAO2/FIO2": 1}
    assert {tuple(r) for r in SC.unseen_texts(m, m.columns[1:], catalogue).collect()} == {("AGE", "new", 1), ("UREE", "new", 1), ("PAO2/FIO2", "y", 1)}
    with pytest.raises(PySparkException, match="the catalogue has no"):
        SC.label_encode(m, "key", m.columns[1:], catalogue, unseen="error").collect()
    known = SC.label_encode(m.where("key = 'f1'"), "key", m.columns[1:], catalogue, unseen="error")
    assert tuple(known.first()) == ("f1", 1, 0, 0)


def test_label_map_shuffles_no_rows(spark):
    catalogue = spark.createDataFrame(CATALOGUE, "PARENT string, index int, saps2weight string")
    m = spark.range(10).select(F.col("id").cast("string").alias("key"), F.lit("<40").alias("AGE"))
    plan = SC.label_encode(m, "key", ["AGE"], catalogue)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main and "Generate" not in main


def test_histogram_one_branch_and_counts(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), None if i % 9 == 0 else int(b), 5) for i, (a, b) in enumerate(zip(rng.normal(size=400), rng.integers(0, 30, 400)))]
    df = spark.createDataFrame(rows, "a double, b int, c int")
    h = P.equal_width_histogram(df, ["a", "b", "c"], 10)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Join" not in plan and plan.count("Exchange") <= 4
    got = {(r.variable, r.bin): r for r in h.collect()}
    for k, c in enumerate("abc"):
        x = np.array([r[k] for r in rows if r[k] is not None], float)
        if c == "c":
            assert got[("c", 1)].n == 400 and got[("c", 1)].lower == got[("c", 1)].upper == 5
            continue
        n, edges = np.histogram(x, 10)
        assert [got[(c, b + 1)].n if (c, b + 1) in got else 0 for b in range(10)] == n.tolist()
        for b in range(10):
            if (c, b + 1) in got:
                assert got[(c, b + 1)].lower == pytest.approx(edges[b]) and got[(c, b + 1)].upper == pytest.approx(edges[b + 1])


def test_covariance_with_large_means(spark):
    rng = np.random.default_rng(2)
    x = 1e9 + rng.normal(size=(3, 40))
    df = spark.createDataFrame([(1, x.tolist())], "id long, series array<array<double>>")
    got = np.array(FE.add_covariance(df, ddof=1).first().cov)
    np.testing.assert_allclose(got, np.cov(x), rtol=1e-6)
    assert FE.add_covariance(spark.createDataFrame([(1, [])], df.schema)).first().cov == []


def test_folds_do_not_join_on_class(spark):
    d = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).alias("dead"))
    f = FO.stratified_folds(d, "dead", ["id"], 7)
    assert "sizes" not in f.columns and set(f.columns) == {"id", "dead", "fold"}
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(dead" not in plan
    want = {}
    for r in f.orderBy("id").collect():
        want.setdefault(r.dead, []).append(r.fold)
    for folds in want.values():
        sizes = [folds.count(k) for k in range(7)]
        assert folds == sorted(folds) and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_blocks_are_rebuilt_alone(spark, tmp_path):
    path = str(tmp_path / "blocks")
    d = spark.range(200).select(F.col("id"), (F.col("id") % 5).cast("int").alias("block"), F.array(F.col("id").cast("double")).alias("series"))
    asked = []

    def build(numbers):
        asked.append(numbers)
        return d.where(F.col("block").isin(numbers))

    assert IO.missing_blocks(spark, path, 5) == [0, 1, 2, 3, 4]
    assert IO.build_blocks(spark, path, 5, build) == [0, 1, 2, 3, 4]
    assert IO.build_blocks(spark, path, 5, build) == [] and asked == [[0, 1, 2, 3, 4]]
    kept = {f.name for f in (tmp_path / "blocks" / "block=1").iterdir()}
    (tmp_path / "blocks" / "block=3").rename(tmp_path / "lost")  # a block is lost
    assert IO.missing_blocks(spark, path, 5) == [3]
    assert IO.build_blocks(spark, path, 5, build) == [3]
    assert {f.name for f in (tmp_path / "blocks" / "block=1").iterdir()} == kept
    key = lambda df: sorted(tuple(r) for r in df.select("id", "block", "series").collect())
    assert key(spark.read.parquet(path)) == key(d)
