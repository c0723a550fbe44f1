"""Wave normalisation: resample each (case, VOI) series to ``nb_pts`` points.

T1–T17, W1, W2, U1, U3. All cases are processed in one plan.

Semantics (per case, per VOI wave):

1. ``step`` = whole minutes, ``60 * bround((dt_max - dt_min)_s / nb_pts / 60)``;
   cases whose step is 0 cannot be resampled: the wave functions leave them
   out, ``rejected_cases`` returns them.
2. ``start`` = earliest of dt_min and the wave's first reading (ticks at
   dt_min and dt_max widen the series; readings outside are kept).
3. Bins are ``[origin + k*step, origin + (k+1)*step)`` with origin = midnight
   of ``start``'s day; grid point ``i`` is bin ``bin(start) + i``.
4. Only ``i`` in ``0..nb_pts-1`` is kept (tail cut before filling; missing
   tail points are padding).
5. Empty points: linear in time between the last known point ``p`` and the
   next known point ``n``, at most ``gap_limit`` points past ``p`` (then
   held), else last known value, else next known value, else null.

Scale: readings are reduced per (case, VOI, point) with partial
aggregation before any shuffle, so a case holding many readings does not
become one task. After binning a wave has at most ``nb_pts`` rows, so the
fill windows and the packing are bounded per group. From a table bucketed by
case the whole way from the readings to the packed series has no exchange but
those of the cohort's few rows a case.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.functions import codes as K
from cohortspark.functions.scalar import seeded
from cohortspark.operators import storage as ST

CASE = ["id_nda", "j1"]
DEFAULT_NB_PTS = 96
DEFAULT_GAP_LIMIT = 30


def route_to_voi(spark: SparkSession, readings: DataFrame, vois: Sequence[str]) -> DataFrame:
    """Attach the VOI (and its order) to each reading; other codes drop out.

    The routing table is the constant VOI dictionary (a few dozen rows), so
    it is broadcast.
    """
    return readings.join(F.broadcast(K.routing_frame(spark, vois)), "id_measure_type")


def _all_steps(ranges: DataFrame, nb_pts: int) -> DataFrame:
    """One row per case with dt_min, dt_max, the target and the step (µs), whatever it is."""
    per_case = ranges.groupBy(*CASE).agg(
        F.min("dt_min").alias("dt_min"),
        F.min("dt_max").alias("dt_max"),
        F.max(F.col("dt_deces").isNotNull()).alias("dead"),
    )
    diff_ms = F.floor(F.timestamp_diff("MICROSECOND", F.col("dt_min"), F.col("dt_max")) / F.lit(1000))
    minutes = F.bround(diff_ms / F.lit(1000.0) / F.lit(float(nb_pts)) / F.lit(60.0), 0)
    return per_case.withColumn("step_us", (minutes * F.lit(60_000_000)).cast("long"))


def case_steps(ranges: DataFrame, nb_pts: int = DEFAULT_NB_PTS) -> DataFrame:
    """T4 + T14: one row per case with dt_min, dt_max, step (µs) and the target.

    ``ranges`` may repeat a case (the age join can fan out); a case is dead
    when any of its rows has a death date. Cases without a positive step are
    in ``rejected_cases``.
    """
    return _all_steps(ranges, nb_pts).where(F.col("step_us") > 0)


def rejected_cases(ranges: DataFrame, nb_pts: int = DEFAULT_NB_PTS) -> DataFrame:
    """The cases ``case_steps`` leaves out: the range rounds to no positive step, or one of its ends is null."""
    return _all_steps(ranges, nb_pts).where(F.coalesce(F.col("step_us") <= 0, F.lit(True)))


def _micros(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def wave_bases(routed: DataFrame, steps: DataFrame, vois: Sequence[str]) -> DataFrame:
    """One row per case with ``waves``: per VOI, in order, the origin (midnight of the wave start) and the start bin ``b0``.

    The array has a fixed length, the number of VOIs, so readings join a case
    once and pick their wave by index.
    """
    firsts = [F.min(F.when(F.col("voi_idx") == i, F.col("dt_insert"))).alias(f"_first_{i}") for i in range(len(vois))]
    joined = steps.join(routed.groupBy(*CASE).agg(*firsts), CASE, "left")

    def wave(i: int, v: str) -> Column:
        start = F.least(F.col("dt_min"), F.col(f"_first_{i}"))
        origin = F.to_date(start).cast("timestamp_ntz")
        b0 = F.floor(_micros(origin, start) / F.col("step_us"))
        return F.struct(F.lit(v).alias("voi"), F.lit(i).alias("voi_idx"), origin.alias("origin"), b0.alias("b0"))

    return joined.select(*CASE, "step_us", "dead", F.array(*[wave(i, v) for i, v in enumerate(vois)]).alias("waves"))


def resample(
    spark: SparkSession,
    readings: DataFrame,
    ranges: DataFrame,
    vois: Sequence[str],
    nb_pts: int = DEFAULT_NB_PTS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """T2 + T3 + T5 + T6: mean per grid point, every point ``0..nb_pts-1`` present.

    ``readings``: (id_nda, j1, id_measure_type, dt_insert, value_numeric), and
    ``slot`` if they come from a table bucketed by it too; ``hot`` then names
    the stays of several slots (``storage.hot_stays``).
    ``ranges``: (id_nda, j1, dt_min, dt_max, dt_deces).
    Returns (id_nda, j1, voi, voi_idx, i, y_mean, n_readings, dead).
    """
    slot = [ST.SLOT] if ST.SLOT in readings.columns else []
    routed = route_to_voi(spark, readings.select(*CASE, *slot, "id_measure_type", "dt_insert", "value_numeric"), vois)
    steps = case_steps(ranges, nb_pts)
    bases = wave_bases(routed, steps, vois)
    wave = F.element_at("waves", F.col("voi_idx") + 1)
    idx = F.floor(_micros(wave["origin"], F.col("dt_insert")) / F.col("step_us")) - wave["b0"]
    points = (
        routed.join(ST.over_slots(bases, hot) if slot else bases, [*CASE, *slot])
        .select(*CASE, "voi_idx", idx.cast("int").alias("i"), F.col("value_numeric").alias("v"))
        .where((F.col("i") >= 0) & (F.col("i") < nb_pts))
        .groupBy(*CASE, "voi_idx", "i")
        .agg(F.avg("v").alias("y"), F.count("v").alias("n"))
    )
    # a case's points, at most nb_pts a VOI, meet its grid as one value: the grid itself is never shuffled
    waves = points.groupBy(*CASE, "voi_idx").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("y", "n")))).alias("pts"))
    cases = waves.groupBy(*CASE).agg(F.map_from_entries(F.collect_list(F.struct("voi_idx", "pts"))).alias("waves"))
    names = F.array(*[F.struct(F.lit(v).alias("voi"), F.lit(i).alias("voi_idx")) for i, v in enumerate(vois)])
    each = F.transform(names, lambda w: F.struct(w["voi"].alias("voi"), w["voi_idx"].alias("voi_idx"), F.try_element_at("waves", w["voi_idx"]).alias("pts")))
    wave_rows = steps.join(cases, CASE, "left").select(*CASE, "dead", F.explode(each).alias("w"))
    at = F.sequence(F.lit(0), F.lit(nb_pts - 1))
    grid = F.transform(at, lambda i: F.struct(i.alias("i"), F.try_element_at(F.col("w.pts"), i).alias("p")))
    rows = wave_rows.select(*CASE, F.col("w.voi").alias("voi"), F.col("w.voi_idx").alias("voi_idx"), "dead", F.explode(grid).alias("g"))
    return rows.select(
        *CASE, "voi", "voi_idx", F.col("g.i").alias("i"), F.col("g.p.y").alias("y_mean"), F.coalesce("g.p.n", F.lit(0).cast("long")).alias("n_readings"), "dead"
    )


def grid_times(
    spark: SparkSession,
    readings: DataFrame,
    ranges: DataFrame,
    vois: Sequence[str],
    nb_pts: int = DEFAULT_NB_PTS,
) -> DataFrame:
    """The time of every grid point, ``t`` = the start of its bin: (id_nda, j1, voi, i, t).

    One row a case until the last step, which lays out the points row by row.
    """
    routed = route_to_voi(spark, readings.select(*CASE, "id_measure_type", "dt_insert"), vois)
    bases = wave_bases(routed, case_steps(ranges, nb_pts), vois)
    waves = bases.select(*CASE, "step_us", F.explode("waves").alias("w"))
    points = waves.select(*CASE, "step_us", "w.voi", "w.origin", "w.b0", F.explode(F.sequence(F.lit(0), F.lit(nb_pts - 1))).alias("i"))
    return points.select(*CASE, "voi", "i", F.timestamp_add("MICROSECOND", (F.col("b0") + F.col("i")) * F.col("step_us"), F.col("origin")).alias("t"))


def fill_column(
    y: str = "y_mean", order: str = "i", part: Sequence[str] = (*CASE, "voi"), gap_limit: int = DEFAULT_GAP_LIMIT
) -> Column:
    """T7 + T9 (W1, W2): capped linear fill, then forward, then backward fill."""
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.col(y).isNotNull()
    p = F.last(F.when(known, F.col(order)), ignorenulls=True).over(before)
    vp = F.last(F.col(y), ignorenulls=True).over(before)
    n = F.first(F.when(known, F.col(order)), ignorenulls=True).over(after)
    vn = F.first(F.col(y), ignorenulls=True).over(after)
    e = F.least(F.col(order), p + F.lit(gap_limit))
    return (
        F.when(known, F.col(y))
        .when(p.isNotNull() & n.isNotNull(), vp + (vn - vp) * (e - p) / (n - p))
        .when(p.isNotNull(), vp)
        .otherwise(vn)
    )


def fill(resampled: DataFrame, gap_limit: int = DEFAULT_GAP_LIMIT) -> DataFrame:
    """Resampled grid → filled value ``y`` per point.

    ``resample`` leaves its rows dealt by case, so neither the fill's windows
    nor the packing after them need an exchange.
    """
    return resampled.withColumn("y", fill_column(gap_limit=gap_limit))


def resample_and_interpolate(
    spark: SparkSession,
    readings: DataFrame,
    ranges: DataFrame,
    vois: Sequence[str],
    nb_pts: int = DEFAULT_NB_PTS,
    gap_limit: int = DEFAULT_GAP_LIMIT,
    method: str = "time",
    order: int = 3,
    hot: DataFrame | None = None,
) -> DataFrame:
    """T10 for all waves: (id_nda, j1, voi, voi_idx, i, y_mean, n_readings, dead, y).

    ``method``: ``'time'`` (linear in time), or ``'cubic'`` / ``'polynomial'``
    with ``order=3`` (interpolating not-a-knot cubic, T8). The smoothing
    ``'spline'`` (automatic knots) is not offered.
    """
    if method == "polynomial":
        if order != 3:
            raise ValueError("only order 3 is offered for the polynomial method")
        method = "cubic"
    if method == "spline":
        raise NotImplementedError("the smoothing spline is not built; use method='cubic' (interpolating)")
    if method not in ("time", "cubic"):
        raise ValueError(f"unknown interpolation method {method!r} (use 'time', 'cubic' or 'polynomial')")
    grid = resample(spark, readings, ranges, vois, nb_pts, hot)
    return fill(grid, gap_limit) if method == "time" else cubic_fill(grid, gap_limit)


def pack(filled: DataFrame, y: str = "y") -> DataFrame:
    """One row per case, ``series`` = [VOI][point] in VOI order, plus ``dead``."""
    waves = filled.groupBy(*CASE, "voi_idx").agg(
        F.array_sort(F.collect_list(F.struct("i", F.col(y).alias("y")))).alias("pts"),
        F.max("dead").alias("dead"),
    )
    waves = waves.select(*CASE, "voi_idx", "dead", F.transform("pts", lambda p: p["y"]).alias("wave"))
    cases = waves.groupBy(*CASE).agg(
        F.array_sort(F.collect_list(F.struct("voi_idx", "wave"))).alias("ws"),
        F.max("dead").alias("dead"),
    )
    return cases.select(*CASE, F.transform("ws", lambda w: w["wave"]).alias("series"), "dead")


def build_dataset(
    spark: SparkSession,
    readings: DataFrame,
    ranges: DataFrame,
    vois: Sequence[str],
    nb_pts: int = DEFAULT_NB_PTS,
    gap_limit: int = DEFAULT_GAP_LIMIT,
    method: str = "time",
    order: int = 3,
    hot: DataFrame | None = None,
) -> DataFrame:
    """The dataset of all cases in one plan (id_nda, j1, series, dead)."""
    return pack(resample_and_interpolate(spark, readings, ranges, vois, nb_pts, gap_limit, method, order, hot))


def id_blocks(cases: DataFrame, nb_splits: int, seed: int = 42) -> DataFrame:
    """Stable block number per case (first eight hex digits of a seeded md5), no driver loop.

    Blocks only label cases; ``build_dataset`` handles all cases at once, so
    a block is just a filter a caller may apply.
    """
    key = F.concat(F.col("id_nda"), F.col("j1").cast("string"))
    return cases.select(*CASE, (F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") % nb_splits).cast("int").alias("block"))


def plot_points(routed_or_filled: DataFrame, value: str, time_col: str) -> DataFrame:
    """Plot-ready long rows (case, VOI label, time, value)."""
    labels = F.create_map(*[x for v, lab, _ in K.VOI_DICTIONARY for x in (F.lit(v), F.lit(lab))])
    return routed_or_filled.select(
        *CASE, "voi", labels[F.col("voi")].alias("label"), F.col(time_col).alias("t"), F.col(value).alias("value")
    )


# ---------------------------------------------------------------------------
# Cubic interpolation (all waves of an Arrow batch at once)

def _second_derivatives(h: np.ndarray, d: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of not-a-knot cubics, one spline a row.

    ``h`` [n, K-1] are the knots' distances, ``d`` the slopes between them,
    ``count`` (at least 4) the knots of each row; what lies behind is ignored.
    The end conditions are solved for the outermost unknowns, which leaves a
    tridiagonal system: one sweep forward, one backward.
    """
    n, k = h.shape[0], h.shape[1] + 1
    rows, last = np.arange(n), count - 2  # the last row of the system is that of the last but one knot
    diagonal, right = np.ones((n, k)), np.zeros((n, k))
    lower, upper = np.zeros((n, k)), np.zeros((n, k))
    diagonal[:, 1:-1] = 2 * (h[:, :-1] + h[:, 1:])
    right[:, 1:-1] = 6 * (d[:, 1:] - d[:, :-1])
    lower[:, 1:-1], upper[:, 1:-1] = h[:, :-1], h[:, 1:]
    one, two = h[:, 0], h[:, 1]
    diagonal[:, 1], upper[:, 1], lower[:, 1] = (one + two) * (2 + one / two), two - one * one / two, 0
    before, after = h[rows, last - 1], h[rows, last]
    diagonal[rows, last], lower[rows, last], upper[rows, last] = (before + after) * (2 + after / before), before - after * after / before, 0
    for j in range(2, k - 1):
        share = np.where(j <= last, lower[:, j] / diagonal[:, j - 1], 0)
        diagonal[:, j] -= share * upper[:, j - 1]
        right[:, j] -= share * right[:, j - 1]
    m = np.zeros((n, k))
    for j in range(k - 2, 0, -1):
        m[:, j] = np.where(j <= last, (right[:, j] - upper[:, j] * m[:, j + 1]) / diagonal[:, j], 0)
    m[:, 0] = ((one + two) * m[:, 1] - one * m[:, 2]) / two
    m[rows, last + 1] = ((before + after) * m[rows, last] - after * m[rows, last - 1]) / before
    return m


def cubic_waves(y: np.ndarray, gap_limit: int) -> np.ndarray:
    """Waves (one a row, NaN = unknown) filled by the not-a-knot cubic through their known points.

    Points more than ``gap_limit`` past the last known point hold the value at
    that distance; outside the known points the nearest known value holds.
    Waves of fewer than four known points take the linear rule.
    """
    n, size = y.shape
    known = ~np.isnan(y)
    count = known.sum(axis=1)
    at = np.arange(size)[None, :]
    place = np.argsort(~known, axis=1, kind="stable")  # known points first, in order
    value = np.take_along_axis(y, place, axis=1)
    before = np.cumsum(known, axis=1) - 1  # number of the last known point
    after = np.minimum(before + 1, np.maximum(count - 1, 0)[:, None])
    inside = ~known & (before >= 0) & (before < count[:, None] - 1)
    low = np.maximum(before, 0)
    x0, x1 = (np.take_along_axis(place, k, axis=1) for k in (low, after))
    y0, y1 = (np.take_along_axis(value, k, axis=1) for k in (low, after))
    e = np.minimum(at, x0 + gap_limit)
    width = np.where(inside, x1 - x0, 1)
    filled = y0 + (y1 - y0) * (e - x0) / width
    cubic = np.flatnonzero(count >= 4)
    if len(cubic):
        most = int(count[cubic].max())
        knots, heights = place[cubic, :most].astype(float), value[cubic, :most]
        real = np.arange(most - 1)[None, :] < count[cubic, None] - 1
        h = np.where(real, np.diff(knots, axis=1), 1)
        m = _second_derivatives(h, np.where(real, np.diff(heights, axis=1) / h, 0), count[cubic])
        m0, m1 = (np.take_along_axis(m, k[cubic], axis=1) for k in (np.minimum(low, most - 1), np.minimum(after, most - 1)))
        w, t0, t1 = width[cubic], (x1 - e)[cubic], (e - x0)[cubic]
        filled[cubic] = (
            m0 * t0**3 / (6 * w) + m1 * t1**3 / (6 * w) + (y0[cubic] / w - m0 * w / 6) * t0 + (y1[cubic] / w - m1 * w / 6) * t1
        )
    outside = np.where(before >= 0, y0, y1)
    return np.where(known, y, np.where(inside, filled, outside))


def cubic_fill(resampled: DataFrame, gap_limit: int = DEFAULT_GAP_LIMIT) -> DataFrame:
    """Cubic interpolation. Each wave becomes one array, a batch of waves is solved at once."""
    rest = [c for c in resampled.columns if c not in (*CASE, "voi", "i", "y_mean")]
    points = F.array_sort(F.collect_list(F.struct("i", "y_mean", *rest)))
    packed = resampled.groupBy(*CASE, "voi").agg(points.alias("pts"))

    @F.pandas_udf("array<double>")
    def fill_batch(waves: pd.Series) -> pd.Series:
        size = np.array([len(w) for w in waves])
        out = np.empty(len(waves), object)
        for length in np.unique(size):
            same = np.flatnonzero(size == length)
            y = cubic_waves(np.stack([np.asarray(waves.iloc[k], float) for k in same]), gap_limit)
            for k, row in zip(same, y):
                out[k] = [None if np.isnan(v) else v for v in row]
        return pd.Series(out)

    filled = packed.withColumn("ys", fill_batch(F.transform("pts", lambda p: p["y_mean"])))
    rows = filled.select(*CASE, "voi", F.explode(F.arrays_zip("pts", "ys")).alias("r"))
    return rows.select(
        *[F.col(c) if c in (*CASE, "voi") else F.col(f"r.pts.{c}").alias(c) for c in resampled.columns], F.col("r.ys").alias("y")
    )
