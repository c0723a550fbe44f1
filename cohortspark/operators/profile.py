"""Profiling: counts, bounds, pivots, row statistics, histograms.

A1–A8, A10–A12, A15, A16, A20, A23, A24, O1–O5, P17, P18.

Pivots always take an explicit code list, so each is a single hash
aggregate with conditional aggregate expressions: one shuffle keyed by
case, partial (map-side) aggregation first, fixed output schema. A case
holding a large share of all readings is reduced to one row per input
partition before the shuffle, so it does not make a hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.operators.staging import not_cancelled

CASE = ["id_nda", "dt_deb"]


def case_key(id_col: str | Column = "id_nda", date_col: str | Column = "dt_deb") -> Column:
    """Text case key: stay id followed by the entry date, no separator (F1).

    For output only; joins use the two columns.
    """
    i = F.col(id_col) if isinstance(id_col, str) else id_col
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    return F.concat(i.cast("string"), d.cast("string"))


def valid_readings(staged: DataFrame, codes: Sequence[int] | None = None) -> DataFrame:
    cond = not_cancelled()
    if codes is not None:
        cond = cond & F.col("id_measure_type").isin([int(c) for c in codes])
    return staged.where(cond)


def measure_counts(staged: DataFrame, measure_ref: DataFrame) -> DataFrame:
    """A1 + J1 + O1: valid readings per measure type and label, most frequent first.

    Readings are counted per type before the join, so the reference table
    joins a handful of rows; duplicate reference rows multiply counts as the
    SQL join would.
    """
    per_type = valid_readings(staged).groupBy("id_measure_type").agg(F.count(F.lit(1)).alias("n"))
    ref = measure_ref.select(F.col("code").try_cast("int").alias("id_measure_type"), "label")
    return (
        per_type.join(ref, "id_measure_type")
        .groupBy("id_measure_type", "label")
        .agg(F.sum("n").alias("counter"))
        .select("counter", "id_measure_type", "label")
        .orderBy(F.col("counter").desc(), "id_measure_type", "label")
    )


def top_measures(counts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent types (top-k, no global sort)."""
    return counts.orderBy(F.col("counter").desc(), "id_measure_type", "label").limit(n)


def frequent_measures(counts: DataFrame, min_count: int) -> DataFrame:
    """Types with more than ``min_count`` readings (HAVING)."""
    return counts.where(F.col("counter") > min_count)


def count_cases(staged: DataFrame, codes: Sequence[int]) -> DataFrame:
    """A3: number of distinct cases (stay, entry date) with a valid reading of the codes."""
    return valid_readings(staged, codes).agg(F.count_distinct("id_nda", "dt_deb").alias("n_cases"))


def count_stays(staged: DataFrame, codes: Sequence[int]) -> DataFrame:
    """A4: number of distinct stays with a valid reading of the codes."""
    return valid_readings(staged, codes).agg(F.count_distinct("id_nda").alias("n_stays"))


def time_bounds(staged: DataFrame) -> DataFrame:
    """First and last entry date of the staged readings."""
    return staged.agg(F.min("dt_deb").alias("beginning"), F.max("dt_deb").alias("ending"))


def case_type_counts(staged: DataFrame, codes: Sequence[int]) -> DataFrame:
    """A2: readings per case and type (long form)."""
    return (
        valid_readings(staged, codes)
        .groupBy("id_nda", "dt_deb", "id_measure_type")
        .agg(F.count(F.lit(1)).alias("counter"))
    )


def case_profile(staged: DataFrame, codes: Sequence[int]) -> DataFrame:
    """Per case and code: count, first and last reading time, in one pass.

    Columns ``n_<code>`` (0 when absent), ``first_<code>``, ``last_<code>``.
    Catalyst drops the aggregates a caller does not select.
    """
    aggs = []
    for c in codes:
        hit = F.col("id_measure_type") == F.lit(int(c))
        aggs += [
            F.count(F.when(hit, F.lit(1))).alias(f"n_{c}"),
            F.min(F.when(hit, F.col("dt_insert"))).alias(f"first_{c}"),
            F.max(F.when(hit, F.col("dt_insert"))).alias(f"last_{c}"),
        ]
    return valid_readings(staged, codes).groupBy(*CASE).agg(*aggs)


def counter_matrix(profile: DataFrame, codes: Sequence[int]) -> DataFrame:
    """One row per case, one count column per code; null = no reading."""
    return profile.select(
        *CASE,
        case_key().alias("id_ndaj1"),
        *[F.nullif(F.col(f"n_{c}"), F.lit(0)).alias(f"n_{c}") for c in codes],
    )


def first_last_matrix(profile: DataFrame, codes: Sequence[int]) -> DataFrame:
    """First and last reading time per case and code."""
    cols = []
    for c in codes:
        cols += [F.col(f"first_{c}"), F.col(f"last_{c}")]
    return profile.select(*CASE, case_key().alias("id_ndaj1"), *cols)


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Exact difference ``end - start`` in seconds (double, microsecond precision)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e) / F.lit(1_000_000.0)


def duration_matrix(profile: DataFrame, codes: Sequence[int]) -> DataFrame:
    """Last − first reading time per case and code, in seconds."""
    return profile.select(
        *CASE,
        case_key().alias("id_ndaj1"),
        *[seconds_between(f"first_{c}", f"last_{c}").alias(f"dur_{c}") for c in codes],
    )


def row_mean_median(matrix: DataFrame, value_cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per row, mean and median over the non-null value columns, rounded half-even.

    Row-local (array functions): no shuffle.
    """
    vals = F.array_sort(F.filter(F.array(*[F.col(c).cast("double") for c in value_cols]), lambda x: x.isNotNull()))
    n = F.size(vals)
    mean = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x) / n
    mid = F.floor(n / 2).cast("int")
    median = F.when(
        n % 2 == 1, F.element_at(vals, mid + 1)
    ).otherwise((F.element_at(vals, mid) + F.element_at(vals, mid + 1)) / 2)
    return matrix.select(
        *keys,
        F.when(n > 0, F.bround(mean, 0)).alias("mean_nb_pts"),
        F.when(n > 0, F.bround(median, 0)).alias("median_nb_pts"),
    )


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, min and max of each column, in one aggregate."""
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}_mean"),
            F.median(c).alias(f"{c}_median"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return df.agg(*aggs)


def low_density(row_stats: DataFrame, below: float = 10.0) -> DataFrame:
    """Rows whose mean number of points is under ``below``."""
    return row_stats.where(F.col("mean_nb_pts") < below)


def equal_width_histogram(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width histogram per column between its min and max.

    Two passes over ``df``, whatever the number of columns: one aggregate gives
    all bounds (a scalar subquery), one counts (column, bin), which each task
    reduces to at most ``bins`` rows a column. The maximum falls in the last
    bin. Output is long: (variable, bin, lower, upper, n). Nulls are not counted.
    """
    x = {c: F.col(c).cast("double") for c in cols}
    ends = [f(x[c]).alias(f"{n}_{k}") for k, c in enumerate(cols) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    bounds = df.agg(*ends).select(F.struct(*[f"{n}_{k}" for k in range(len(cols)) for n in ("lo", "hi")]).alias("b")).scalar()
    values = F.array(*[F.struct(F.lit(k).alias("k"), x[c].alias("x")) for k, c in enumerate(cols)])
    rows = df.select(F.explode(values).alias("v")).select("v.k", "v.x").where("x is not null")
    rows = rows.withColumn("b", bounds)
    pick = lambda end: F.element_at(F.array(*[F.col(f"b.{end}_{k}") for k in range(len(cols))]), F.col("k") + 1)
    rows = rows.select("k", "x", pick("lo").alias("lo"), (pick("hi") - pick("lo")).alias("w"))
    number = F.least(F.floor((F.col("x") - F.col("lo")) * F.lit(bins) / F.col("w")) + 1, F.lit(bins))
    counted = (
        rows.select("k", "lo", "w", F.when(F.col("w") > 0, number).otherwise(F.lit(1)).cast("int").alias("bin"))
        .groupBy("k", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("w").alias("w"))
    )
    return counted.select(
        F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("k") + 1).alias("variable"),
        "bin",
        (F.col("lo") + F.col("w") * (F.col("bin") - 1) / F.lit(bins)).alias("lower"),
        (F.col("lo") + F.col("w") * F.col("bin") / F.lit(bins)).alias("upper"),
        "n",
    )


def frame_shape(df: DataFrame) -> DataFrame:
    """Row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
