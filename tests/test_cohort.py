from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from cohortspark.operators import cohort as C
from cohortspark.operators import profile as P
from cohortspark.sources.schemas import STAGED_SCHEMA

T0 = datetime(2024, 1, 1, 0, 0)
D = date(2024, 1, 1)


def staged_rows(case, spec):
    """spec: list of (code, minutes offset)."""
    return [(D, case, code, T0 + timedelta(minutes=m), 1.0, "") for code, m in spec]


def test_profile_presence_count_and_bt(spark):
    vois = ["HR", "ABPS", "BT"]
    rows = []
    rows += staged_rows("a", [(10102, i) for i in range(11)] + [(14, i) for i in range(11)])  # all present, 11 each
    rows += staged_rows("b", [(10280, i) for i in range(10)] + [(11, i) for i in range(20)])  # HR through 2nd code, 10 = threshold
    rows += staged_rows("c", [(4, 1)])  # BT only
    rows += staged_rows("d", [(10102, 1), (10281, 2)])
    st = spark.createDataFrame(rows, STAGED_SCHEMA)
    from cohortspark.functions.codes import voi_codes

    prof = P.case_profile(st, voi_codes(vois))
    present = {r.id_nda for r in C.presence_filter(prof, vois).collect()}
    assert present == {"a", "b", "d"}
    counted = {r.id_nda for r in C.count_filter(C.presence_filter(prof, vois), vois, 10).collect()}
    assert counted == {"a"}  # b has exactly 10 readings of HR: strictly above is required
    m = {r.id_nda: r for r in P.counter_matrix(prof, voi_codes(vois)).collect()}
    assert m["c"]["n_4"] == 1 and m["c"]["n_10102"] is None


def test_bounds_negative_and_exact_stay(spark):
    vois = ["HR", "RR"]
    rows = []
    rows += staged_rows("neg", [(10102, 0), (10102, 60), (10120, 120), (10120, 180)])  # HR ends before RR starts
    rows += staged_rows("exact", [(10102, 0), (10102, 180), (10120, 0), (10120, 180)])
    rows += staged_rows("one", [(10102, 30), (10120, 30)])
    st = spark.createDataFrame(rows, STAGED_SCHEMA)
    from cohortspark.functions.codes import voi_codes

    prof = P.case_profile(st, voi_codes(vois))
    b = {r.id_nda: r for r in C.stay_bounds(prof, vois).collect()}
    assert b["neg"].dt_min == T0 + timedelta(minutes=120) and b["neg"].dt_max == T0 + timedelta(minutes=60)
    assert b["neg"].stay_len < timedelta(0)
    assert b["one"].stay_len == timedelta(0)
    kept = {r.id_nda for r in C.stay_bounds(prof, vois).where(C.stay_condition(3.0)).collect()}
    assert kept == {"exact"}


def test_funnel_counts_never_rise(spark):
    from cohortspark.plans.cohort_selection import CohortPlan

    p = CohortPlan.from_test_tables(spark, "/root/testdata/sf0.001")
    f = p.funnel().first()
    seq = [f.n_cases, f.n_present, f.n_counted]
    assert seq == sorted(seq, reverse=True)
    assert f.n_long <= f.n_aged
    assert p.cohort().count() == f.n_long


def test_paired_rules(spark):
    rows = staged_rows("p", [(10102, 0), (10102, 400), (10120, 0), (10120, 400), (14, 0), (14, 400), (15, 0), (15, 400)])
    rows += staged_rows("q", [(10102, 0), (10120, 0), (11, 0)])
    st = spark.createDataFrame(rows, STAGED_SCHEMA)
    prof = P.case_profile(st, [10102, 10120, 11, 12, 14, 15])
    r = {
        x.id_nda: x
        for x in prof.select(
            "id_nda", C.paired_presence().alias("a"), C.paired_count(2).alias("b"), C.paired_duration(6).alias("c")
        ).collect()
    }
    assert (r["p"].a, r["p"].b, r["p"].c) == (True, True, True)
    assert (r["q"].a, r["q"].b, r["q"].c) == (False, False, False)


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    h = {r.bin: r.n for r in P.equal_width_histogram(df, ["x"], 50).collect()}
    assert sum(h.values()) == 101 and max(h) == 50 and h[50] == 3
