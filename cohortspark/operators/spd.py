"""Means of symmetric positive-definite 2 x 2 matrices as column expressions.

A matrix is a struct (a, b, c): [[a, b], [b, c]]. Its eigenvalues are
``t + r`` and ``t - r`` with ``t = (a + c) / 2`` and ``r = hypot((a - c) / 2, b)``,
and any function of it is ``f(M) = p * I + q * M`` with ``q`` the slope of ``f``
between the eigenvalues. So logarithm, exponential and roots are plain
expressions: no Python, no decomposition, and whole rounds of a mean are one
aggregate over the data. Only the mean itself, three numbers a class, comes to
the driver.

A mean that does not settle within its rounds raises ``NotSettled``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotSettled(RuntimeError):
    """An iterative mean whose last step is still longer than its tolerance."""


class Sym(NamedTuple):
    """A symmetric 2 x 2 matrix of columns (or of numbers, as literals)."""

    a: Column
    b: Column
    c: Column

    @classmethod
    def of(cls, matrix: Column) -> "Sym":
        """From an ``array<array<double>>`` column of two rows."""
        return cls(matrix[0][0], matrix[0][1], matrix[1][1])

    @classmethod
    def lit(cls, values: tuple[float, float, float]) -> "Sym":
        return cls(*(F.lit(float(v)) for v in values))

    def struct(self) -> Column:
        return F.struct(self.a.alias("a"), self.b.alias("b"), self.c.alias("c"))

    @classmethod
    def column(cls, name: str) -> "Sym":
        return cls(F.col(f"{name}.a"), F.col(f"{name}.b"), F.col(f"{name}.c"))


def function(m: Sym, f: Callable[[Column], Column], slope: Callable[[Column], Column]) -> Sym:
    """``f`` of a matrix through its eigenvalues; ``slope`` is the derivative, for equal ones."""
    t, half = (m.a + m.c) / 2, (m.a - m.c) / 2
    r = F.sqrt(half * half + m.b * m.b)
    q = F.when(r > 1e-12 * F.abs(t), (f(t + r) - f(t - r)) / (2 * r)).otherwise(slope(t))
    p = (f(t + r) + f(t - r)) / 2 - q * t
    return Sym(p + q * m.a, q * m.b, p + q * m.c)


def log(m: Sym) -> Sym:
    return function(m, F.ln, lambda x: 1 / x)


def sqrt(m: Sym) -> Sym:
    return function(m, F.sqrt, lambda x: 0.5 / F.sqrt(x))


def between(k: Sym, m: Sym) -> Sym:
    """``k m k``."""
    a1, b1 = k.a * m.a + k.b * m.b, k.a * m.b + k.b * m.c
    a2, b2 = k.b * m.a + k.c * m.b, k.b * m.b + k.c * m.c
    return Sym(a1 * k.a + b1 * k.b, a1 * k.b + b1 * k.c, a2 * k.b + b2 * k.c)


# --- the same on the driver's three numbers -------------------------------------

Three = tuple[float, float, float]


def _number(m: Three, f: Callable[[float], float], slope: Callable[[float], float]) -> Three:
    a, b, c = m
    t, r = (a + c) / 2, math.hypot((a - c) / 2, b)
    q = (f(t + r) - f(t - r)) / (2 * r) if r > 1e-12 * abs(t) else slope(t)
    p = (f(t + r) + f(t - r)) / 2 - q * t
    return p + q * a, q * b, p + q * c


def root(m: Three, inverse: bool = False) -> Three:
    if inverse:
        return _number(m, lambda x: x**-0.5, lambda x: -0.5 * x**-1.5)
    return _number(m, math.sqrt, lambda x: 0.5 / math.sqrt(x))


def exp(m: Three) -> Three:
    return _number(m, math.exp, math.exp)


def _between(k: Three, m: Three) -> Three:
    a1, b1 = k[0] * m[0] + k[1] * m[1], k[0] * m[1] + k[1] * m[2]
    a2, b2 = k[1] * m[0] + k[2] * m[1], k[1] * m[1] + k[2] * m[2]
    return a1 * k[0] + b1 * k[1], a1 * k[1] + b1 * k[2], a2 * k[1] + b2 * k[2]


def _length(m: Three) -> float:
    return math.sqrt(m[0] ** 2 + 2 * m[1] ** 2 + m[2] ** 2)


def _averages(df: DataFrame, m: Sym, by: str | None = None) -> dict[object, Three]:
    """Mean matrix of each group (partial aggregation; three numbers a group)."""
    keys = [by] if by else []
    rows = df.groupBy(*keys).agg(*[F.avg(x).alias(n) for x, n in zip(m, "abc")]).collect()
    return {(r[by] if by else None): (r["a"], r["b"], r["c"]) for r in rows if r["a"] is not None}


def affine_mean(df: DataFrame, matrix: str, tol: float = 1e-8, max_iter: int = 50) -> Three:
    """Affine-invariant mean of the struct column ``matrix``: the point at which the mean logarithm vanishes."""
    start = _averages(df, Sym.column(matrix))
    if not start:
        raise ValueError("the mean of no matrices")
    mean = start[None]
    for _ in range(max_iter):
        inverse = Sym.lit(root(mean, inverse=True))
        # the congruence as columns of its own, so that it is computed once a row
        moved = df.select(between(inverse, Sym.column(matrix)).struct().alias("_m"))
        step = _averages(moved, log(Sym.column("_m")))[None]
        mean = _between(root(mean), exp(step))
        if _length(step) < tol:
            return mean
    raise NotSettled(f"affine-invariant mean: step of {_length(step):.3g} after {max_iter} rounds, tolerance {tol:g}")


def tangent(df: DataFrame, matrix: str, mean: Three, out: str = "tangent") -> DataFrame:
    """The vector (first diagonal entry, off-diagonal times sqrt 2, second) of the logarithm seen from ``mean``."""
    moved = df.withColumn("_m", between(Sym.lit(root(mean, inverse=True)), Sym.column(matrix)).struct())
    m = log(Sym.column("_m"))
    return moved.withColumn(out, F.array(m.a, m.b * math.sqrt(2), m.c)).drop("_m")


def wasserstein_means(df: DataFrame, matrix: str, label: str, tol: float = 1e-8, max_iter: int = 50) -> dict[object, Three]:
    """Wasserstein mean of each class; the root ``k`` of a mean solves ``k^2 = mean of sqrt(k m k)``."""
    roots = {g: root(m) for g, m in _averages(df, Sym.column(matrix), label).items()}
    for _ in range(max_iter):
        k = Sym(*(_by_class(label, {g: r[j] for g, r in roots.items()}) for j in range(3)))
        moved = df.select(label, between(k, Sym.column(matrix)).struct().alias("_m"))
        new = {g: root(m) for g, m in _averages(moved, sqrt(Sym.column("_m")), label).items()}
        step = max(_length(tuple(x - y for x, y in zip(new[g], roots[g]))) for g in new)
        roots = new
        if step < tol:
            return {g: _between(r, (1.0, 0.0, 1.0)) for g, r in roots.items()}
    raise NotSettled(f"Wasserstein mean: step of {step:.3g} after {max_iter} rounds, tolerance {tol:g}")


def _by_class(label: str, values: dict[object, float]) -> Column:
    col = F.lit(None).cast("double")
    for g, v in values.items():
        col = F.when(F.col(label) == F.lit(g), F.lit(float(v))).otherwise(col)
    return col


def wasserstein_squared(m: Sym, mean: Three) -> Column:
    """Squared Wasserstein distance to ``mean``: traces less twice the trace of the root between them."""
    inner = between(Sym.lit(root(mean)), m)
    # the trace of a root of a 2 x 2 matrix: sqrt(trace + 2 sqrt(determinant))
    det = F.greatest(inner.a * inner.c - inner.b * inner.b, F.lit(0.0))
    return F.greatest(m.a + m.c + F.lit(mean[0] + mean[2]) - 2 * F.sqrt(inner.a + inner.c + 2 * F.sqrt(det)), F.lit(0.0))


def nearest_mean(train: DataFrame, test: DataFrame, matrix: str, label: str, **how) -> DataFrame:
    """Class with the nearest Wasserstein mean (``prediction``) and the softmax of minus the squared distances (``p1``)."""
    means = wasserstein_means(train, matrix, label, **how)
    classes = sorted(means)
    far = test.withColumn("_d", F.array(*[wasserstein_squared(Sym.column(matrix), means[g]) for g in classes]))
    weight = F.transform("_d", lambda d: F.exp(F.array_min("_d") - d))
    total = F.aggregate(weight, F.lit(0.0), lambda x, y: x + y)
    nearest = F.array_position("_d", F.array_min("_d")).cast("int")
    named = F.element_at(F.array(*[F.lit(g) for g in classes]), nearest)
    positive = classes.index(True) if True in classes else len(classes) - 1
    return far.withColumn("prediction", named.cast("double")).withColumn("p1", weight[positive] / total).drop("_d")
