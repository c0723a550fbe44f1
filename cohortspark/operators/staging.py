"""Staging: unit movements, windowed readings, patient summary.

Scale notes
-----------
* The interval join (J3) has an equi key (stay id). A stay with very many
  readings would put them all in one task, so the key is refined with the
  reading's calendar day: each movement is expanded to the days its window
  covers (window days + 1 rows, a fixed bound) and readings join on
  ``(id_nda, day)`` before the exact range test. Skew left after that is
  split by AQE's skew-join handling.
* Stay ids are normalised to text once here; later joins use plain columns.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_WINDOW = timedelta(days=1)


def not_cancelled(col: str = "dt_cancel") -> Column:
    """A reading is valid when its cancel mark is the empty text (null fails)."""
    return F.col(col) == F.lit("")


def icu_movements(movements: DataFrame, units: DataFrame) -> DataFrame:
    """Movements in intensive-care units (inner join: duplicate units multiply rows)."""
    cols = movements.columns
    return movements.join(units.select("ids_ufr"), "ids_ufr").select(*cols)


def window_readings(readings: DataFrame, movements: DataFrame, window: timedelta = DEFAULT_WINDOW) -> DataFrame:
    """J3 + P2: readings taken in ``[entry, entry + window]`` of a movement of the same stay.

    Returns ``dt_deb`` (entry date) followed by all columns of the readings in
    their order, stay id as text; columns that a plan does not use later are
    not read. Both ends are included; a reading inside two movements yields two
    rows, as the SQL join does.
    """
    win = F.lit(window)
    cols = [c for c in readings.columns if c != "dt_deb"]
    r = readings.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "id_nda" else F.col(f"`{c}`") for c in cols])
    r = r.withColumn("_day", F.to_date("dt_insert"))
    m = movements.select(F.col("id_nda").cast("string").alias("_m_nda"), F.col("dt_deb_mouv_ufr").alias("_entry"))
    m = m.withColumn(
        "_day", F.explode(F.sequence(F.to_date("_entry"), F.to_date(F.col("_entry") + win)))
    )
    joined = r.join(m, (r.id_nda == m._m_nda) & (r._day == m._day)).where(
        (F.col("dt_insert") >= F.col("_entry")) & (F.col("dt_insert") <= F.col("_entry") + win)
    )
    return joined.select(F.to_date("_entry").alias("dt_deb"), *[r[f"`{c}`"] for c in cols])


def unstaged_window_readings(
    readings: DataFrame, movements: DataFrame, units: DataFrame, window: timedelta = DEFAULT_WINDOW
) -> DataFrame:
    """Readings × movements × units in one plan, without staging tables."""
    return window_readings(readings, icu_movements(movements, units), window)


def patient_info(icu_moves: DataFrame, patients: DataFrame, staged: DataFrame | None) -> DataFrame:
    """J5 + A9: per stay with staged readings, entry/exit bounds with age, sex and death date.

    Grouped by stay, age, sex and death date as the reference does, so a stay
    with two patient rows gives two rows. ``staged=None`` skips the "stay has
    staged readings" restriction, for callers that join the result to cases
    (which have staged readings by construction) and so need not run the
    readings join a second time.
    """
    moves = icu_moves.select(
        F.col("id_nda").cast("string").alias("id_nda"), "ids_pat", "dt_deb_mouv_ufr", "dt_fin_mouv_ufr"
    )
    if staged is not None:
        stays = staged.select("id_nda").distinct()  # partial distinct: one row per stay and task before the shuffle
        moves = moves.join(stays, "id_nda", "left_semi")
    pats = patients.select("ids_pat", "age", "cd_sex_tr", "dt_deces")
    return (
        moves.join(pats, "ids_pat")
        .groupBy("id_nda", "age", "cd_sex_tr", "dt_deces")
        .agg(
            F.min("dt_deb_mouv_ufr").alias("min_dt_deb_mouv"),
            F.max("dt_deb_mouv_ufr").alias("max_dt_deb_mouv"),
            F.max("dt_fin_mouv_ufr").alias("max_dt_fin_mouv"),
        )
        .select("id_nda", "age", "min_dt_deb_mouv", "max_dt_deb_mouv", "max_dt_fin_mouv", "cd_sex_tr", "dt_deces")
    )


def useful_readings(staged: DataFrame, cohort: DataFrame) -> DataFrame:
    """J6 + P4: valid staged readings of the selected cases (semi-join on stay + entry date)."""
    cases = cohort.select("id_nda", F.col("j1").alias("dt_deb"))
    return staged.where(not_cancelled()).join(cases, ["id_nda", "dt_deb"], "left_semi")


def cohort_readings(useful: DataFrame) -> DataFrame:
    """Readings of the cohort (``useful`` is already restricted to it) with case columns."""
    return useful.select(
        "id_nda",
        F.col("dt_deb").alias("j1"),
        F.concat(F.col("id_nda"), F.col("dt_deb").cast("string")).alias("id_case"),
        "id_measure_type",
        "dt_insert",
        "value_numeric",
    )
