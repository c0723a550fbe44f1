"""The minimal slice of SURVEY §7.2 on sf0.01 reproduces the five counts recorded there.

(No unit join, 7-day window, VOIs view / click / purchase+error, count > 3, stay >= 72 h.)
"""

from datetime import timedelta

from pyspark.sql import functions as F

from cohortspark.operators import profile as P
from cohortspark.operators import staging as S
from cohortspark.sources import stand_ins as SI


def test_minimum_slice_counts(spark):
    d = "/root/testdata/sf0.01"
    staged = S.window_readings(SI.readings(spark, d), SI.movements(spark, d), timedelta(days=7))
    prof = P.case_profile(staged, [10102, 10120, 14, 15])
    groups = [[10102], [10120], [14, 15]]

    def n(cs):
        return sum(F.col(f"n_{c}") for c in cs)

    def first(cs):
        return F.least(*[F.col(f"first_{c}") for c in cs]) if len(cs) > 1 else F.col(f"first_{cs[0]}")

    def last(cs):
        return F.greatest(*[F.col(f"last_{c}") for c in cs]) if len(cs) > 1 else F.col(f"last_{cs[0]}")

    present = F.lit(True)
    counted = F.lit(True)
    for g in groups:
        present = present & (n(g) > 0)
        counted = counted & (n(g) > 3)
    secs = P.seconds_between(F.greatest(*[first(g) for g in groups]), F.least(*[last(g) for g in groups]))
    r = prof.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(present).alias("present"),
        F.count_if(present & counted).alias("counted"),
        F.count_if(present & counted & (secs >= 72 * 3600)).alias("long"),
        F.count_if(secs < 0).alias("negative"),
    ).first()
    assert (r.cases, r.present, r.counted, r.long, r.negative) == (1583, 1332, 287, 111, 531)
