"""Property checks of the gap-limited fill on many random grids (one Spark job)."""

from datetime import date

import numpy as np
import pandas as pd

from cohortspark.operators import waves as W

NB = 96


def _patterns(n=300, seed=0):
    rnd = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        y = rnd.normal(80, 15, NB)
        mask = np.ones(NB, bool)
        for _ in range(rnd.integers(0, 4)):  # carve gaps of 1..70 points
            a = rnd.integers(0, NB)
            mask[a : a + rnd.integers(1, 71)] = False
        mask &= rnd.random(NB) > rnd.uniform(0, 0.6)  # plus sparse drop-outs
        out.append(np.where(mask, y, np.nan))
    return out


def test_fill_matches_pandas_and_properties(spark):
    pats = _patterns()
    rows = [
        (str(k), date(2024, 1, 1), "HR", 0, False, i, None if np.isnan(v) else float(v), 0)
        for k, p in enumerate(pats)
        for i, v in enumerate(p)
    ]
    grid = spark.createDataFrame(
        rows, "id_nda string, j1 date, voi string, voi_idx int, dead boolean, i int, y_mean double, n_readings long"
    )
    got = {}
    for r in W.fill(grid).select("id_nda", "i", "y").collect():
        got.setdefault(r.id_nda, [None] * NB)[r.i] = r.y
    for k, p in enumerate(pats):
        g = np.array([np.nan if v is None else v for v in got[str(k)]])
        assert len(g) == NB
        want = pd.Series(p).interpolate(method="index", limit=30).ffill().bfill().to_numpy()
        np.testing.assert_allclose(g, want, atol=1e-9, equal_nan=True)
        if np.isnan(p).all():
            assert np.isnan(g).all()
        else:
            lo, hi = np.nanmin(p), np.nanmax(p)
            assert (g >= lo - 1e-9).all() and (g <= hi + 1e-9).all()
