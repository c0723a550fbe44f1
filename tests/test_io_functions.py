import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortspark.functions import codes as K
from cohortspark.functions import scalar as FX
from cohortspark.operators import cohort as C
from cohortspark.sources import io as IO


def test_parquet_modes_and_catalog(spark):
    base = tempfile.mkdtemp(prefix="cohortspark-io-", dir="/tmp")
    path = os.path.join(base, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    IO.write_parquet(df, path)  # S4
    with pytest.raises(AnalysisException):
        IO.write_parquet(df, path, mode="errorifexists")  # S5
    IO.write_parquet(df.limit(1), path, mode="ignore")  # S8: left as is
    assert IO.scan(spark, path).count() == 2  # S3
    IO.case_view(df, "tmp_cases")  # S13
    assert IO.run_sql(spark, "select count(*) as n from tmp_cases where k > :m", args={"m": 1}).first().n == 1  # S1
    assert IO.table_exists(spark, "tmp_cases")  # S7
    IO.drop_table(spark, "no_such_table_xyz")  # S9: missing is fine
    assert IO.distributed_count(spark, ["scala", "java", "spark"]) == 3  # S14
    assert [r.k for r in IO.preview(df, ["k"], 1, last=True).collect()] == [2]  # S15


def test_codes_and_in_list(spark):
    assert K.voi_codes(["ABPS", "HR"]) == [11, 14, 10102, 10280, 10281]
    text = K.codes_in_list_text(K.voi_codes(["RR"]))
    assert text == "(10120,10285)" and FX.in_list_text_to_codes(text) == [10120, 10285]
    assert K.bounded_vois(["HR", "BT"]) == ["HR"]
    with pytest.raises(KeyError):
        K.voi_codes(["XX"])
    d = K.dictionary_frame(spark).where("code = 'BT'").first()
    assert d.measure_codes == [4]


def test_latin1_and_case_lookup(spark):
    df = spark.createDataFrame([(bytearray("Fréquence".encode("latin-1")),)], "b binary")
    assert df.select(FX.decode_latin1_bytes("b").alias("s")).first().s == "Fréquence"
    cases = spark.createDataFrame([("7603491", "2015-09-06"), ("1", "2015-09-07")], "id_nda string, j1 string")
    hit = C.case_lookup(cases, "76034912015-09-06").collect()
    assert len(hit) == 1 and hit[0].id_nda == "7603491"


def test_tables_and_saved_outputs(spark):
    from datetime import date

    from cohortspark.plans.cohort_selection import CohortPlan

    df = spark.createDataFrame([(1, "a")], "k int, v string")
    IO.drop_table(spark, "cs_test_t")
    IO.create_table_as(df, "cs_test_t")  # S6
    assert IO.table_exists(spark, "cs_test_t") and IO.scan(spark, "cs_test_t").count() == 1
    assert not IO.create_if_absent(spark, "cs_test_t", df)
    IO.drop_table(spark, "cs_test_t")
    assert not IO.table_exists(spark, "cs_test_t")

    base = tempfile.mkdtemp(prefix="cohortspark-io-", dir="/tmp")
    p = CohortPlan.from_test_tables(spark, "/root/testdata/sf0.001")
    IO.save_cohort(p.cohort(), base + "/nda_j1_deces", list(p.vois))  # S11
    back = IO.scan(spark, base + "/nda_j1_deces")
    assert back.count() == p.cohort().count()
    assert back.columns == ["id_nda", "j1", *p.vois, "dt_deces", "dt_min", "dt_max", "stay_len"]
    ds = spark.createDataFrame([("1", date(2024, 1, 1), [[1.0, None], [2.0, 3.0]], True)],
                               "id_nda string, j1 date, series array<array<double>>, dead boolean")
    IO.save_dataset(ds, base + "/dataset")  # S12
    assert IO.scan(spark, base + "/dataset").first().series == [[1.0, None], [2.0, 3.0]]


def test_intermediate_tables_are_removed(spark):
    import os

    from cohortspark.operators import storage as ST
    from cohortspark.session import ensure_checkpoint_dir, intermediate_tables, materialise

    folder = f"{ensure_checkpoint_dir(spark)}/cohortspark-tables"
    kept = materialise(spark.range(3).toDF("id"), "kept")
    before = set(os.listdir(folder))
    with intermediate_tables(spark):
        first = materialise(spark.range(5).toDF("id"), "gone")
        with intermediate_tables(spark):
            inner = ST.bucketed(first, "gone", ["id"], 2)
            name = inner.inputFiles()[0].split("/")[-2]
            assert inner.count() == 5 and spark.catalog.tableExists(name)
        assert not spark.catalog.tableExists(name) and first.count() == 5
    assert set(os.listdir(folder)) == before and kept.count() == 3
