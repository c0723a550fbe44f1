"""Wave normalisation against a pandas statement of the reference algorithm."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from cohortspark.operators import waves as W

NB = 96


def pandas_wave(times, values, dt_min, dt_max, nb_pts=NB, limit=30):
    ms = int((pd.Timestamp(dt_max) - pd.Timestamp(dt_min)) / pd.Timedelta(milliseconds=1))
    delay = int(np.round(ms / 1e3 / nb_pts / 60))
    s = pd.Series(values, index=pd.DatetimeIndex(times), dtype=float).sort_index()
    s = pd.concat([pd.Series([np.nan], index=[pd.Timestamp(dt_min)]), s, pd.Series([np.nan], index=[pd.Timestamp(dt_max)])])
    s = s.resample(f"{delay}min").mean()
    while len(s) < nb_pts:
        s = pd.concat([s, pd.Series([np.nan], index=[s.index[-1] + pd.Timedelta(seconds=1)])])
    if len(s) > nb_pts:
        s = s.iloc[:nb_pts]
    s = s.interpolate(method="time", limit=limit).ffill().bfill()
    return s.to_numpy()


def run_spark(spark, cases, vois=("HR",)):
    """cases: dict case_id -> (dt_min, dt_max, [(code, time, value)])."""
    rrows, crows = [], []
    j1 = date(2024, 1, 1)
    for cid, (dmin, dmax, rs) in cases.items():
        crows.append((cid, j1, dmin, dmax, None))
        rrows += [(cid, j1, code, t, v) for code, t, v in rs]
    readings = spark.createDataFrame(
        rrows, "id_nda string, j1 date, id_measure_type int, dt_insert timestamp_ntz, value_numeric double"
    )
    ranges = spark.createDataFrame(crows, "id_nda string, j1 date, dt_min timestamp_ntz, dt_max timestamp_ntz, dt_deces date")
    ds = W.build_dataset(spark, readings, ranges, list(vois), NB)
    return {r.id_nda: r.series for r in ds.collect()}


def _random_case(rnd, base):
    dmin = base + timedelta(minutes=rnd.randrange(0, 600), seconds=rnd.randrange(60))
    hours = rnd.uniform(6, 30)
    dmax = dmin + timedelta(hours=hours)
    n = rnd.randrange(1, 200)
    rs = []
    for _ in range(n):
        # some readings before dt_min and after dt_max
        off = rnd.uniform(-2, hours + 2) * 3600
        rs.append((10102, dmin + timedelta(seconds=off), rnd.uniform(40, 140)))
    if rnd.random() < 0.5:  # carve a long gap
        a, b = sorted(rnd.uniform(0, hours) for _ in range(2))
        rs = [x for x in rs if not (dmin + timedelta(hours=a) <= x[1] <= dmin + timedelta(hours=b))]
        if not rs:
            rs = [(10102, dmin, 70.0)]
    return dmin, dmax, rs


def test_random_cases_match_pandas(spark):
    rnd = random.Random(42)
    base = datetime(2024, 1, 1)
    cases = {f"c{i}": _random_case(rnd, base) for i in range(30)}
    got = run_spark(spark, cases)
    for cid, (dmin, dmax, rs) in cases.items():
        want = pandas_wave([t for _, t, _ in rs], [v for _, _, v in rs], dmin, dmax)
        np.testing.assert_allclose(np.array(got[cid][0], dtype=float), want, rtol=0, atol=1e-9, err_msg=cid)


@pytest.mark.parametrize("gap", [29, 30, 31, 32])
def test_gap_edges(spark, gap):
    # 96 points of 15 minutes (24 h); known points at 0..9 and after a gap of `gap` empty points
    dmin = datetime(2024, 1, 1, 0, 0)
    dmax = dmin + timedelta(hours=24)
    step = timedelta(minutes=15)
    known = list(range(0, 10)) + list(range(10 + gap, 96))
    rs = [(10102, dmin + k * step + timedelta(minutes=1), float(k % 7) * 3 + 50) for k in known]
    got = run_spark(spark, {"g": (dmin, dmax, rs)})["g"][0]
    want = pandas_wave([t for _, t, _ in rs], [v for _, _, v in rs], dmin, dmax)
    np.testing.assert_allclose(np.array(got, dtype=float), want, atol=1e-9)


def test_leading_gap_single_reading_and_empty_wave(spark):
    dmin = datetime(2024, 1, 1, 6, 0)
    dmax = dmin + timedelta(hours=12)
    rs = [(10102, dmin + timedelta(hours=5), 77.0), (10120, dmin + timedelta(hours=3), 20.0),
          (10120, dmin + timedelta(hours=9), 26.0)]
    got = run_spark(spark, {"x": (dmin, dmax, rs)}, vois=("HR", "RR", "SPO2"))["x"]
    assert len(got) == 3 and all(len(w) == NB for w in got)
    assert set(got[0]) == {77.0}  # one reading: held everywhere
    assert got[1][0] == 20.0 and got[1][-1] == 26.0  # leading back-filled, trailing held
    assert all(v is None for v in got[2])  # no reading: stays null
    want = pandas_wave([dmin + timedelta(hours=3), dmin + timedelta(hours=9)], [20.0, 26.0], dmin, dmax)
    np.testing.assert_allclose(np.array(got[1], dtype=float), want, atol=1e-9)


def test_too_short_stay_is_dropped(spark):
    dmin = datetime(2024, 1, 1, 6, 0)
    got = run_spark(spark, {"s": (dmin, dmin + timedelta(minutes=20), [(10102, dmin, 1.0)])})
    assert got == {}


def test_rejected_cases_are_all_that_steps_leave_out(spark):
    dmin, j1 = datetime(2024, 1, 1, 6, 0), date(2024, 1, 1)
    ends = {"short": timedelta(minutes=20), "long": timedelta(hours=6), "back": timedelta(hours=-3), "none": None}
    rows = [(c, j1, dmin, None if d is None else dmin + d, None) for c, d in ends.items()]
    ranges = spark.createDataFrame([*rows, rows[0]], "id_nda string, j1 date, dt_min timestamp_ntz, dt_max timestamp_ntz, dt_deces date")
    ids = lambda df: sorted(r.id_nda for r in df.collect())
    assert ids(W.case_steps(ranges, NB)) == ["long"] and ids(W.rejected_cases(ranges, NB)) == ["back", "none", "short"]
    # above 720 points a six-hour stay rounds to no minute a point
    assert ids(W.case_steps(ranges, 721)) == [] and ids(W.rejected_cases(ranges, 721)) == ["back", "long", "none", "short"]


def test_cubic_keeps_known_points_and_length(spark):
    dmin = datetime(2024, 1, 1, 0, 0)
    dmax = dmin + timedelta(hours=24)
    rs = [(10102, dmin + timedelta(minutes=15 * k + 1), float(np.sin(k / 5.0))) for k in range(0, 96, 3)]
    readings = spark.createDataFrame(
        [("c", date(2024, 1, 1), c, t, v) for c, t, v in rs],
        "id_nda string, j1 date, id_measure_type int, dt_insert timestamp_ntz, value_numeric double",
    )
    ranges = spark.createDataFrame([("c", date(2024, 1, 1), dmin, dmax, None)],
                                   "id_nda string, j1 date, dt_min timestamp_ntz, dt_max timestamp_ntz, dt_deces date")
    f = W.resample_and_interpolate(spark, readings, ranges, ["HR"], NB, method="cubic").orderBy("i").collect()
    assert len(f) == NB
    for r in f:
        if r.y_mean is not None:
            assert r.y == pytest.approx(r.y_mean)
    # a smooth curve: cubic error at the gaps is small
    err = max(abs(r.y - np.sin(r.i / 5.0)) for r in f if r.i < 94)
    assert err < 0.01


def dense_spline(x, y, at):
    """Not-a-knot cubic by a dense solve of its conditions, one wave at a time."""
    n, h = len(x), np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for k in range(1, n - 1):
        a[k, k - 1 : k + 2] = h[k - 1], 2 * (h[k - 1] + h[k]), h[k]
        r[k] = 6 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, r)
    s = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t0, t1, w = x[s + 1] - at, at - x[s], h[s]
    return m[s] * t0**3 / (6 * w) + m[s + 1] * t1**3 / (6 * w) + (y[s] / w - m[s] * w / 6) * t0 + (y[s + 1] / w - m[s + 1] * w / 6) * t1


def plain_cubic(y, limit):
    i, known = np.arange(len(y)), ~np.isnan(y)
    if known.sum() == 0:
        return y
    xk, yk, out = i[known].astype(float), y[known], y.copy()
    inside = ~known & (i > xk[0]) & (i < xk[-1])
    last = np.maximum.accumulate(np.where(known, i, -1))
    e = np.minimum(i, last + limit)[inside].astype(float)
    out[inside] = dense_spline(xk, yk, e) if known.sum() >= 4 else np.interp(e, xk, yk)
    out[i < xk[0]], out[i > xk[-1]] = yk[0], yk[-1]
    return out


def test_cubic_batches_equal_single_dense_solves():
    rnd = np.random.default_rng(4)
    waves = rnd.normal(50, 20, (300, 96))
    for k, w in enumerate(waves):
        w[rnd.random(96) < rnd.random()] = np.nan
    waves[0], waves[1] = np.nan, np.r_[np.full(95, np.nan), 7.0]
    waves[2] = np.nan
    waves[2, [0, 1, 2, 95]] = 1, 2, 5, 0  # four knots, a gap of 92
    waves[3] = np.nan
    waves[3, [10, 60, 70]] = 1, 2, 3  # three knots: the linear rule
    got = W.cubic_waves(waves, 30)
    for w, g in zip(waves, got):
        np.testing.assert_allclose(g, plain_cubic(w, 30), rtol=1e-9, atol=1e-9)


def test_cubic_reproduces_cubics():
    rnd = np.random.default_rng(4)
    x = np.sort(rnd.choice(np.arange(0, 96), size=12, replace=False))
    c = rnd.normal(size=4) * [1, 1e-1, 1e-3, 1e-4]
    poly = c[0] + c[1] * np.arange(96) + c[2] * np.arange(96.0) ** 2 + c[3] * np.arange(96.0) ** 3
    wave = np.full((1, 96), np.nan)
    wave[0, x] = poly[x]
    inside = slice(x[0], x[-1] + 1)
    np.testing.assert_allclose(W.cubic_waves(wave, 96)[0, inside], poly[inside], rtol=1e-8, atol=1e-8)


def test_all_readings_past_the_cut_leave_a_null_wave(spark):
    dmin = datetime(2024, 1, 1, 0, 0)
    dmax = dmin + timedelta(hours=24)
    rs_hr = [(10102, dmin + timedelta(hours=h), 60.0 + h) for h in (1, 5, 20)]
    rs_rr = [(10120, dmin + timedelta(hours=h), 15.0) for h in (30, 31)]  # bins 120 and 124: cut
    got = run_spark(spark, {"c": (dmin, dmax, rs_hr + rs_rr)}, vois=("HR", "RR"))["c"]
    want_rr = pandas_wave([t for _, t, _ in rs_rr], [v for _, _, v in rs_rr], dmin, dmax)
    assert np.isnan(want_rr).all()
    assert all(v is None for v in got[1])
    want_hr = pandas_wave([t for _, t, _ in rs_hr], [v for _, _, v in rs_hr], dmin, dmax)
    np.testing.assert_allclose(np.array(got[0], dtype=float), want_hr, atol=1e-9)
