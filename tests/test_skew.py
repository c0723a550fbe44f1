"""A stay holding a third of all readings: results stay whole and AQE splits the hot join partition."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cohortspark.operators import profile as P
from cohortspark.operators import staging as S


def test_hot_stay_is_split_and_complete(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "32",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        base = datetime(2024, 1, 1)
        n = 150_000
        r = spark.range(n).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000 + 1).alias("id_nda"),
            F.lit(10102).cast("int").alias("id_measure_type"),
            (
                F.lit(base).cast("timestamp_ntz")
                + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 80000).cast("decimal(18,6)"))
            ).alias("dt_insert"),
            F.lit(1.0).alias("value_numeric"),
            F.lit("").alias("dt_cancel"),
        )
        m = spark.range(2001).select(
            F.col("id").cast("string").alias("id_nda"),
            F.lit(1).alias("ids_ufr"),
            F.col("id").alias("ids_pat"),
            F.lit(base).cast("timestamp_ntz").alias("dt_deb_mouv_ufr"),
            F.lit(base).cast("timestamp_ntz").alias("dt_fin_mouv_ufr"),
        )
        staged = S.window_readings(r, m, timedelta(days=1))
        qe = staged._jdf.queryExecution()
        assert qe.toRdd().count() == n  # every reading kept, none dropped or capped
        assert "skew=true" in qe.executedPlan().toString()
        prof = P.case_profile(staged, [10102])
        hot = prof.where("id_nda = '0'").first()
        assert hot.n_10102 == n // 3 + (1 if n % 3 else 0)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_stays_are_dealt_over_slots(spark):
    """Slots so small that stays have several: same readings, same waves as without a stored table."""
    from cohortspark.operators import waves as W
    from cohortspark.plans import cohort_selection as CS

    sf = "/root/testdata/sf0.01"
    plain = CS.CohortPlan.from_test_tables(spark, sf)
    stored = CS.CohortPlan.from_test_tables(spark, sf, store=("staged", "cohort", "useful"), slot_rows=20)
    hot = stored.hot_stays()
    assert hot is not None and hot.where("slots > 1").count() > 0
    assert stored.stored_staged().select("slot").distinct().count() > 1
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(stored.useful()) == rows(plain.useful())
    vois = list(CS.TEST_VOIS)
    a = W.resample_and_interpolate(spark, stored.wave_readings(), stored.cohort(), vois, hot=hot)
    b = W.resample_and_interpolate(spark, plain.wave_readings(), plain.cohort(), vois)
    key = lambda df: sorted((r.id_nda, r.j1, r.voi, r.i, r.n_readings, None if r.y is None else round(r.y, 9)) for r in df.collect())
    assert key(a) == key(b) and len(key(a)) > 0


def test_hot_stays_stay_in_their_buckets(spark):
    """With slots too, the joins of the stored readings move only the cases."""
    from test_plans import _exchanges_above_scan

    from cohortspark.operators import waves as W
    from cohortspark.plans import cohort_selection as CS

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = CS.CohortPlan.from_test_tables(spark, "/root/testdata/sf0.01", store=("staged", "cohort", "useful"), slot_rows=20)
        grid = W.resample(spark, p.wave_readings(), p.cohort(), list(CS.TEST_VOIS), hot=p.hot_stays())
        plan = grid._jdf.queryExecution().executedPlan().toString()
        assert "slot" in plan and "cohortspark_useful" in plan and not _exchanges_above_scan(plan, "cohortspark_useful")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
