"""Stand-in tables reproduce the sizes recorded in FIXTURES.md §2 (sf0.01)."""

from datetime import timedelta

from pyspark.sql import functions as F

from cohortspark.operators import staging as S
from cohortspark.sources import stand_ins as SI

D = "/root/testdata/sf0.01"


def test_stand_in_sizes(spark):
    moves = SI.movements(spark, D)
    icu = S.icu_movements(moves, SI.icu_units(spark, D))
    assert icu.count() == 1197
    assert icu.select("id_nda").distinct().count() == 150
    r = SI.readings(spark, D)
    assert r.count() == 7983
    assert r.where(S.not_cancelled()).count() == 7599
    p = SI.patients(spark, D)
    assert p.count() == 1500
    assert p.where(F.col("dt_deces").isNotNull()).count() == 303
    assert p.where(F.col("age") >= 18).count() == 1194
    f = SI.forms(spark, D)
    assert f.count() == 60575
    assert f.select("id_form").distinct().count() == 14743
    assert f.where(F.col("j1").isNotNull()).count() == 19957
    one_day = S.window_readings(r, moves, timedelta(days=1)).where(S.not_cancelled())
    assert one_day.count() == 3341
    e = SI.embedding_series(spark, D)
    assert e.count() == 500
    assert SI.table(spark, D, "embeddings").select("label").distinct().count() == 10
