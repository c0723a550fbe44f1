"""Stratified folds and splits.

Fold numbers follow contiguous stratified k-fold: within each class, rows
in a fixed order are cut into ``k`` consecutive blocks, the first
``n mod k`` blocks one row longer (the same as ``ntile(k)``). Positions
and class sizes come from ``ordering.positions``, so no class is gathered into
one task and rows are dealt by their place in the order, never by class alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions.scalar import seeded
from cohortspark.operators.ordering import positions


def _ntile(pos: Column, n: Column, k: int) -> Column:
    q = F.floor(n / F.lit(k)).cast("long")
    r = (n % F.lit(k)).cast("long")
    big = r * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - big) / q)).cast("int")


def stratified_folds(df: DataFrame, label: str, order: list[str | Column], k: int = 5) -> DataFrame:
    """Add ``fold`` in ``0..k-1``, balanced per class, contiguous in ``order``."""
    out = positions(df, order, [label], size="_n")
    return out.withColumn("fold", _ntile(F.col("pos"), F.col("_n"), k)).drop("_n", "pos")


def stratified_split(df: DataFrame, label: str, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """M4 / U4: shuffled stratified folds; fold 0 is the validation set (``is_valid``).

    The shuffle is by the md5 text of key and seed, so the split is repeatable in any engine.
    """
    shuffled = df.withColumn("_h", seeded(F.col(key), seed))
    f = stratified_folds(shuffled, label, ["_h", key], k)
    return f.withColumn("is_valid", F.col("fold") == 0).drop("_h")
