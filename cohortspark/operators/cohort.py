"""Cohort selection: presence, count, age and stay filters, bounds, funnel.

P8–P16, J7–J11, A14, A17–A22. All filters work on the one-row-per-case
profile from ``profile.case_profile``; nothing goes back to the readings.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import codes as K
from cohortspark.operators.profile import CASE, case_key, seconds_between


def _any(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def _all(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def _n(code: int) -> Column:
    return F.coalesce(F.col(f"n_{code}"), F.lit(0))


def presence_condition(vois: Sequence[str]) -> Column:
    """Every VOI except BT has a reading under at least one of its codes."""
    return _all([_any([_n(c) > 0 for c in K.codes_of(v)]) for v in K.bounded_vois(vois)])


def count_condition(vois: Sequence[str], min_measures: int = 10) -> Column:
    """P10: per VOI except BT, readings summed over its codes strictly above ``min_measures``."""
    return _all([voi_total(v) > F.lit(min_measures) for v in K.bounded_vois(vois)])


def voi_total(voi: str) -> Column:
    """Readings of one VOI = sum over its codes, missing = 0."""
    return reduce(lambda a, b: a + b, [_n(c) for c in K.codes_of(voi)])


def presence_filter(profile: DataFrame, vois: Sequence[str]) -> DataFrame:
    return profile.where(presence_condition(vois))


def count_filter(profile: DataFrame, vois: Sequence[str], min_measures: int = 10) -> DataFrame:
    return profile.where(count_condition(vois, min_measures))


def voi_totals(profile: DataFrame, vois: Sequence[str]) -> DataFrame:
    """One count column per VOI."""
    return profile.select(*CASE, *[voi_total(v).alias(v) for v in vois])


# --- paired rules of the exploration notebook (fixed codes) -----------------

def _dur(code: int) -> Column:
    return seconds_between(f"first_{code}", f"last_{code}")


def paired_presence() -> Column:
    """Heart and respiration rate, and a complete pressure pair (11 & 12 or 14 & 15)."""
    return (_n(10102) > 0) & (_n(10120) > 0) & (((_n(11) > 0) & (_n(12) > 0)) | ((_n(14) > 0) & (_n(15) > 0)))


def paired_count(min_pts: int = 10) -> Column:
    """The same pairs with at least ``min_pts`` readings each."""
    k = F.lit(min_pts)
    return (
        (((_n(11) >= k) & (_n(12) >= k)) | ((_n(14) >= k) & (_n(15) >= k)))
        & (_n(10102) >= k)
        & (_n(10120) >= k)
    )


def paired_duration(hours: float = 6.0) -> Column:
    """(11 or 14), (12 or 15), 10102 and 10120 each span at least ``hours``."""
    h = F.lit(hours * 3600.0)
    ok = lambda c: F.coalesce(_dur(c) >= h, F.lit(False))
    return (ok(11) | ok(14)) & (ok(12) | ok(15)) & ok(10102) & ok(10120)


# --- demographics ------------------------------------------------------------

def case_demographics(pat_info: DataFrame) -> DataFrame:
    """Distinct (stay, age, death date) of the patient summary."""
    return pat_info.select("id_nda", "age", "dt_deces").distinct()


def demographic_duplicates(demographics: DataFrame) -> DataFrame:
    """Report for P13: stays with more than one (age, death date) row; the age join
    repeats their cases once per row, as the reference's merge does."""
    return demographics.groupBy("id_nda").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def age_filter(cases: DataFrame, demographics: DataFrame, age_min: int = 18) -> DataFrame:
    """Inner join with demographics aged ``>= age_min`` (may multiply rows)."""
    return cases.join(demographics.where(F.col("age") >= F.lit(age_min)), "id_nda")


# --- bounds ------------------------------------------------------------------

def _greatest(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def _least(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def bound_columns(vois: Sequence[str]) -> tuple[Column, Column]:
    """start = latest over VOIs of each VOI's first reading,
    end = earliest over VOIs of each VOI's last reading (BT skipped, nulls skipped)."""
    bv = K.bounded_vois(vois)
    start = _greatest([_least([F.col(f"first_{c}") for c in K.codes_of(v)]) for v in bv])
    end = _least([_greatest([F.col(f"last_{c}") for c in K.codes_of(v)]) for v in bv])
    return start, end


def stay_bounds(profile: DataFrame, vois: Sequence[str]) -> DataFrame:
    """dt_min, dt_max and stay_len (interval; may be negative)."""
    start, end = bound_columns(vois)
    return (
        profile.select(*CASE, start.alias("dt_min"), end.alias("dt_max"))
        .withColumn("stay_len", F.col("dt_max") - F.col("dt_min"))
    )


def stay_condition(hours: float = 6.0) -> Column:
    """Stay length of at least ``hours`` (null fails)."""
    return F.coalesce(seconds_between("dt_min", "dt_max") >= F.lit(hours * 3600.0), F.lit(False))


# --- composed selection --------------------------------------------------------

def select_cohort(
    profile: DataFrame,
    demographics: DataFrame,
    vois: Sequence[str],
    min_measures: int = 10,
    age_min: int = 18,
    stay_hours: float = 6.0,
) -> DataFrame:
    """P9 → P10 → P13 → P14 on the case profile; the selected-cohort table.

    Columns: id_nda, j1, one count per VOI, age, dt_deces, dt_min, dt_max, stay_len.
    """
    start, end = bound_columns(vois)
    cases = profile.where(presence_condition(vois) & count_condition(vois, min_measures)).select(
        *CASE, *[voi_total(v).alias(v) for v in vois], start.alias("dt_min"), end.alias("dt_max")
    )
    aged = age_filter(cases, demographics, age_min)
    return aged.where(stay_condition(stay_hours)).select(
        "id_nda",
        F.col("dt_deb").alias("j1"),
        *vois,
        "age",
        "dt_deces",
        "dt_min",
        "dt_max",
        (F.col("dt_max") - F.col("dt_min")).alias("stay_len"),
    )


def mortality_rate(df: DataFrame, death_col: str = "dt_deces") -> DataFrame:
    """100 × rows with a death date / all rows."""
    return df.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.count(death_col).alias("n_dead"),
        (F.lit(100.0) * F.try_divide(F.count(death_col), F.count(F.lit(1)))).alias("mortality_pct"),
    )


def cohort_funnel(
    profile: DataFrame,
    demographics: DataFrame,
    vois: Sequence[str],
    min_measures: int = 10,
    age_min: int = 18,
    stay_hours: float = 6.0,
) -> DataFrame:
    """A22 + A21: cohort size after each step, and mortality at the last two, in one aggregate.

    Case-level steps are flags on the profile; the age step may fan out, so
    its rows come from the join. Both feed one global sum (partial per task).
    """
    start, end = bound_columns(vois)
    flags = profile.select(
        "id_nda",
        presence_condition(vois).alias("present"),
        (presence_condition(vois) & count_condition(vois, min_measures)).alias("counted"),
        start.alias("dt_min"),
        end.alias("dt_max"),
    )
    zero = F.lit(0).cast("long")
    case_rows = flags.select(
        F.lit(1).cast("long").alias("n_cases"),
        F.col("present").cast("long").alias("n_present"),
        F.col("counted").cast("long").alias("n_counted"),
        zero.alias("n_aged"),
        zero.alias("n_dead_aged"),
        zero.alias("n_long"),
        zero.alias("n_dead_long"),
    )
    aged = age_filter(flags.where("counted"), demographics, age_min)
    dead = F.col("dt_deces").isNotNull()
    long_ = stay_condition(stay_hours)
    aged_rows = aged.select(
        zero.alias("n_cases"),
        zero.alias("n_present"),
        zero.alias("n_counted"),
        F.lit(1).cast("long").alias("n_aged"),
        dead.cast("long").alias("n_dead_aged"),
        long_.cast("long").alias("n_long"),
        (dead & long_).cast("long").alias("n_dead_long"),
    )
    cols = ["n_cases", "n_present", "n_counted", "n_aged", "n_dead_aged", "n_long", "n_dead_long"]
    total = case_rows.unionByName(aged_rows).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in cols])
    return total.select(
        *cols,
        (F.lit(100.0) * F.try_divide(F.col("n_dead_aged"), F.col("n_aged"))).alias("pct_dead_aged"),
        (F.lit(100.0) * F.try_divide(F.col("n_dead_long"), F.col("n_long"))).alias("pct_dead_long"),
    )


def sampling_band(vois: Sequence[str]) -> Column:
    """P8: 'few' if every VOI count < 20, 'about_100' if all in (90, 120), 'many' if all > 200."""
    cols = [F.col(v) for v in vois]
    return (
        F.when(_all([c < 20 for c in cols]), F.lit("few"))
        .when(_all([(c > 90) & (c < 120) for c in cols]), F.lit("about_100"))
        .when(_all([c > 200 for c in cols]), F.lit("many"))
    )


def case_lookup(df: DataFrame, id_case: str, key: Column | None = None) -> DataFrame:
    """Rows of one case, the text key bound as a literal value."""
    k = key if key is not None else case_key("id_nda", "j1")
    return df.where(k == F.lit(id_case))


def death_flag(col: str = "dt_deces") -> Column:
    """Dead when a death date exists."""
    return F.col(col).isNotNull()
