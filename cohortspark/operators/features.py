"""Features of packed series: min-max scaling, covariance, diagonal loading.

A case's series is ``array<array<double>>`` [VOI][point]. Its size is fixed
by the VOI list and ``nb_pts``, so every feature here is a row-local
expression (higher-order array functions): no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.scalar import seeded


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def scale_points(df: DataFrame, series: str = "series", out: str = "scaled") -> DataFrame:
    """M1: scale each time point across VOIs to [0, 1]; zero range → 0; nulls stay null.

    (A column-wise scaler applied to a [VOI × point] matrix scales each point.)
    Per-point minima and maxima are materialised as columns first, so each is
    computed once per row.
    """
    s = F.col(series)
    pts = F.sequence(F.lit(0), F.size(F.element_at(s, 1)) - 1)
    col_at = lambda j: F.transform(s, lambda w: w[j])
    staged = df.withColumns(
        {
            "_mins": F.transform(pts, lambda j: F.array_min(col_at(j))),
            "_maxs": F.transform(pts, lambda j: F.array_max(col_at(j))),
        }
    )
    mn, mx = F.col("_mins"), F.col("_maxs")
    scaled = F.transform(
        s,
        lambda w: F.transform(
            w,
            lambda x, j: F.when(
                mx[j] > mn[j], (x - mn[j]) / (mx[j] - mn[j])
            ).otherwise(x - mn[j]),
        ),
    )
    return staged.withColumn(out, scaled).drop("_mins", "_maxs")


def _pair_cov(a: Column, b: Column, ddof: int) -> Column:
    """Covariance of two arrays over positions where both are known, in one pass.

    The means are updated point by point and products taken around them, so
    that large means do not cancel.
    """
    zero = F.lit(0.0)
    init = F.struct(zero.alias("n"), zero.alias("p"), zero.alias("q"), zero.alias("c"))

    def step(acc: Column, pq: Column) -> Column:
        p, q = pq["p"], pq["q"]
        n = acc["n"] + 1
        mean_q = acc["q"] + (q - acc["q"]) / n
        new = F.struct(
            n.alias("n"),
            (acc["p"] + (p - acc["p"]) / n).alias("p"),
            mean_q.alias("q"),
            (acc["c"] + (p - acc["p"]) * (q - mean_q)).alias("c"),
        )
        return F.when(p.isNotNull() & q.isNotNull(), new).otherwise(acc)

    def finish(acc: Column) -> Column:
        return F.when(acc["n"] - F.lit(ddof) > 0, acc["c"] / (acc["n"] - F.lit(ddof)))

    zipped = F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.aggregate(zipped, init, step, finish)


def add_covariance(
    df: DataFrame, series: str = "series", out: str = "cov", ddof: int = 0, alpha: float = 0.0
) -> DataFrame:
    """M2 + M3: [VOI × VOI] covariance over points where both waves are known, plus ``alpha`` on the diagonal.

    ``ddof=0`` divides by N (population), ``ddof=1`` by N−1. ``series`` must
    be a column (not an expression) so each wave is read, not recomputed.
    Each pair of waves is computed once, the matrix is filled from that.
    """
    s = F.col(series)
    n = F.size(s)
    idx = F.sequence(F.lit(0), n - 1)
    pairs = F.flatten(F.transform(idx, lambda a: F.transform(F.sequence(a, n - 1), lambda b: _pair_cov(s[a], s[b], ddof))))

    def entry(done: Column, a: Column, b: Column) -> Column:
        low, high = F.least(a, b), F.greatest(a, b)
        # the pairs of the first `low` waves come before
        at = (low * n - low * (low - 1) / 2 + high - low).cast("int")
        return done[at] + F.when(a == b, F.lit(alpha)).otherwise(F.lit(0.0))

    # the pairs are bound to a variable, so that no entry computes them anew
    cov = F.transform(F.array(pairs), lambda done: F.transform(idx, lambda a: F.transform(idx, lambda b: entry(done, a, b))))[0]
    return df.withColumn(out, F.when(n > 0, cov).otherwise(F.when(n == 0, F.array().cast("array<array<double>>"))))


def matrix_long(df: DataFrame, keys: list[str], matrix: str, names: tuple[str, str, str]) -> DataFrame:
    """Explode a packed matrix to long rows (keys..., row, col, value).

    The outer form is used on purpose: for a plain ``posexplode`` the optimizer
    infers a ``size(matrix) > 0`` filter and pushes it below the projections,
    which copies the whole matrix expression into that filter.
    """
    r, c, v = names
    rows = df.select(*keys, F.posexplode_outer(matrix).alias(r, "_row"))
    return rows.select(*keys, r, F.posexplode_outer("_row").alias(c, v)).where(F.col(c).isNotNull())


def sample_cases(df: DataFrame, key: str, n: int = 6, seed: int = 42) -> DataFrame:
    """A repeatable pseudo-random sample of ``n`` cases (top-k by a seeded md5)."""
    return df.orderBy(seeded(F.col(key), seed), F.col(key)).limit(n)


def covariance_samples(df: DataFrame, key: str, n: int = 6, seed: int = 42, alpha: float = 1.0) -> DataFrame:
    """Loaded covariance of a few sampled cases with their outcome, as long rows."""
    s = scale_points(sample_cases(df, key, n, seed).select(key, "dead", "series"))
    s = add_covariance(s, "scaled", "cov", 0, alpha).select(key, "dead", "cov")
    return matrix_long(s, [key, "dead"], "cov", ("v1", "v2", "cov"))
