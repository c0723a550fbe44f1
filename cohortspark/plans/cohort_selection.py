"""Cohort selection plan: logical inputs → staged readings → case profile → cohort.

``CohortPlan`` holds the inputs and parameters and hands out lazy
DataFrames; nothing runs until a caller acts on one. Inputs are any
DataFrames with the logical schemas (FIXTURES.md §1); ``from_test_tables``
builds them from the driver's test tables.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.functions import codes as K
from cohortspark.operators import cohort as C
from cohortspark.operators import profile as P
from cohortspark.operators import staging as S
from cohortspark.operators import storage as ST
from cohortspark.session import materialise
from cohortspark.sources import stand_ins as SI

# Parameters used on the test tables. Readings there are sparse, hence the
# 7-day window and the lower count / longer stay thresholds.
TEST_VOIS: tuple[str, ...] = ("HR", "RR", "ABPS", "ABPD")
TEST_WINDOW = timedelta(days=7)
TEST_MIN_MEASURES = 3
TEST_AGE_MIN = 18
TEST_STAY_HOURS = 72.0


@dataclass
class CohortPlan:
    readings: DataFrame
    movements: DataFrame
    units: DataFrame
    patients: DataFrame
    measure_ref: DataFrame | None = None
    vois: Sequence[str] = K.DEFAULT_VOIS
    window: timedelta = S.DEFAULT_WINDOW
    min_measures: int = 10
    age_min: int = 18
    stay_hours: float = 6.0
    # Persist the selected cohort (a table written in the shared checkpoint
    # folder) before plans that use it several times, as the wave build does.
    persist_cohort: bool = False
    # Frames written once before plans that read them several times: "staged"
    # and "useful" as tables bucketed by case, "profile" and "cohort" as plain ones.
    store: Collection[str] = ()
    slot_rows: int = ST.SLOT_ROWS
    _cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        unknown = set(self.store) - {"staged", "useful", "profile", "cohort"}
        if unknown:
            raise ValueError(f"cannot store {sorted(unknown)}: only staged, useful, profile and cohort")
        if "useful" in self.store and "staged" not in self.store:
            raise ValueError("useful readings are stored from the stored staged ones: store both")

    @classmethod
    def from_test_tables(cls, spark: SparkSession, sf_dir: str, **params) -> "CohortPlan":
        defaults = dict(
            vois=TEST_VOIS,
            window=TEST_WINDOW,
            min_measures=TEST_MIN_MEASURES,
            age_min=TEST_AGE_MIN,
            stay_hours=TEST_STAY_HOURS,
        )
        defaults.update(params)
        return cls(
            readings=SI.readings(spark, sf_dir),
            movements=SI.movements(spark, sf_dir),
            units=SI.icu_units(spark, sf_dir),
            patients=SI.patients(spark, sf_dir),
            measure_ref=SI.measure_ref(spark),
            **defaults,
        )

    @property
    def codes(self) -> list[int]:
        return K.voi_codes(self.vois)

    def _memo(self, key, build):
        if key not in self._cache:
            self._cache[key] = build()
        return self._cache[key]

    def icu_movements(self) -> DataFrame:
        return self._memo("icu", lambda: S.icu_movements(self.movements, self.units))

    def staged(self) -> DataFrame:
        """icu_sensor_24: readings within the window after each ICU entry."""
        if "staged" in self.store:
            return self.stored_staged().drop(ST.SLOT)
        return self._memo("staged", lambda: S.window_readings(self.readings, self.icu_movements(), self.window))

    def hot_stays(self) -> DataFrame | None:
        return self._memo("hot", lambda: ST.hot_stays(self.readings, self.slot_rows))

    def _keys(self) -> list[str]:
        return P.CASE if self.hot_stays() is None else [*P.CASE, ST.SLOT]

    def stored_staged(self) -> DataFrame:
        """The staged readings as a table bucketed by case (and slot, if stays are hot): the interval join runs once."""
        def build():
            rows = S.window_readings(self.readings, self.icu_movements(), self.window)
            dealt = ST.slotted(rows, self.hot_stays(), ["dt_insert", "id_measure_type", "value_numeric"])
            return ST.bucketed(dealt, "staged", self._keys())

        return self._memo("stored_staged", build)

    def profile(self) -> DataFrame:
        def build():
            prof = P.case_profile(self.staged(), self.codes)
            return materialise(prof, "profile") if "profile" in self.store else prof

        return self._memo("profile", build)

    def patient_info(self) -> DataFrame:
        return self._memo("pat", lambda: S.patient_info(self.icu_movements(), self.patients, self.staged()))

    def demographics(self) -> DataFrame:
        """Stay demographics for joining to cases: the patient summary without the
        staged-readings restriction, which any case satisfies already."""
        return self._memo(
            "demo", lambda: C.case_demographics(S.patient_info(self.icu_movements(), self.patients, None))
        )

    def cohort(self) -> DataFrame:
        """nda_j1_deces: the selected cases with counts, death date and bounds."""
        def build():
            c = C.select_cohort(
                self.profile(), self.demographics(), self.vois, self.min_measures, self.age_min, self.stay_hours
            )
            if self.persist_cohort or "cohort" in self.store:
                c = materialise(c, "nda_j1_deces")
            return c

        return self._memo("cohort", build)

    def funnel(self) -> DataFrame:
        return C.cohort_funnel(
            self.profile(), self.demographics(), self.vois, self.min_measures, self.age_min, self.stay_hours
        )

    def useful(self) -> DataFrame:
        """icu_sensor_util: valid staged readings of the selected cases."""
        if "staged" in self.store:
            return self.stored_useful().drop(ST.SLOT)
        return self._memo("useful", lambda: S.useful_readings(self.staged(), self.cohort()))

    def stored_useful(self) -> DataFrame:
        """The useful readings (and their slot), from the stored table: only the cohort is shuffled for the semi-join."""
        def build():
            cases = ST.over_slots(self.cohort().select("id_nda", F.col("j1").alias("dt_deb")), self.hot_stays())
            rows = self.stored_staged().where(S.not_cancelled()).join(cases, self._keys(), "left_semi")
            return ST.bucketed(rows, "useful", self._keys(), dealt=True) if "useful" in self.store else rows

        return self._memo("stored_useful", build)

    def cohort_readings(self) -> DataFrame:
        return S.cohort_readings(self.useful())

    def wave_readings(self) -> DataFrame:
        """Valid staged readings with case columns, for the wave build.

        From a stored table they are the useful readings, with their slot, and
        the wave build's join with the cohort's waves reads the buckets as they
        are. Without one they are all staged readings: the same join (an inner
        one) keeps only cohort cases, and the semi-join's shuffle is saved.
        """
        if "staged" in self.store:
            slot = self._keys()[len(P.CASE) :]
            return self.stored_useful().select(
                "id_nda", F.col("dt_deb").alias("j1"), *slot, "id_measure_type", "dt_insert", "value_numeric"
            )
        return self.staged().where(S.not_cancelled()).select(
            "id_nda", F.col("dt_deb").alias("j1"), "id_measure_type", "dt_insert", "value_numeric"
        )

    def case_ranges(self) -> DataFrame:
        """First and last useful reading per selected case (all types)."""
        return (
            self.useful()
            .groupBy("id_nda", F.col("dt_deb").alias("j1"))
            .agg(F.min("dt_insert").alias("dt_min"), F.max("dt_insert").alias("dt_max"))
        )
