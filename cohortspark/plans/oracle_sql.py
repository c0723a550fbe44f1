"""DuckDB statements of the cohort queries, for the driver's side-by-side check.

Each builder returns plain SQL over the pre-registered test-table views.
They restate the semantics directly in SQL (conditional aggregates,
``greatest`` / ``least``, window functions) and share only parameters with
the Spark code.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from cohortspark.functions import codes as K
from cohortspark.sources.stand_ins import DUCK


def secs(a: str, b: str) -> str:
    """Seconds from ``a`` to ``b`` (double, microsecond precision)."""
    return f"(date_diff('microsecond', {a}, {b}) / 1000000.0)"


def _greatest(xs: list[str]) -> str:
    return xs[0] if len(xs) == 1 else f"greatest({', '.join(xs)})"


def _least(xs: list[str]) -> str:
    return xs[0] if len(xs) == 1 else f"least({', '.join(xs)})"


def n(code: int) -> str:
    return f"coalesce(n_{code}, 0)"


def voi_total(voi: str) -> str:
    return "(" + " + ".join(n(c) for c in K.codes_of(voi)) + ")"


def presence(vois: Sequence[str]) -> str:
    parts = ["(" + " or ".join(f"{n(c)} > 0" for c in K.codes_of(v)) + ")" for v in K.bounded_vois(vois)]
    return " and ".join(parts) if parts else "true"


def counted(vois: Sequence[str], min_measures: int) -> str:
    parts = [f"{voi_total(v)} > {int(min_measures)}" for v in K.bounded_vois(vois)]
    return " and ".join(parts) if parts else "true"


def bounds(vois: Sequence[str]) -> tuple[str, str]:
    bv = K.bounded_vois(vois)
    start = _greatest([_least([f"first_{c}" for c in K.codes_of(v)]) for v in bv])
    end = _least([_greatest([f"last_{c}" for c in K.codes_of(v)]) for v in bv])
    return start, end


class CohortSQL:
    """CTE bodies of the cohort chain for one parameter set."""

    def __init__(
        self,
        vois: Sequence[str],
        window: timedelta,
        min_measures: int,
        age_min: int,
        stay_hours: float,
    ) -> None:
        self.vois = list(vois)
        self.codes = K.voi_codes(vois)
        self.window_us = int(window.total_seconds() * 1_000_000)
        self.min_measures = min_measures
        self.age_min = age_min
        self.stay_hours = stay_hours

    def ctes(self, upto: str) -> dict[str, str]:
        """Ordered CTEs needed for ``upto`` (stand-ins included)."""
        codes_list = K.codes_in_list_text(self.codes)
        prof_cols = []
        for c in self.codes:
            f = f"filter (where id_measure_type = {c})"
            prof_cols += [
                f"count(*) {f} as n_{c}",
                f"min(dt_insert) {f} as first_{c}",
                f"max(dt_insert) {f} as last_{c}",
            ]
        start, end = bounds(self.vois)
        stay_ok = f"coalesce({secs('dt_min', 'dt_max')} >= {self.stay_hours * 3600.0}, false)"
        totals = ", ".join(f"{voi_total(v)} as {v}" for v in self.vois)
        all_ctes = {
            "movements": DUCK["movements"],
            "icu_units": DUCK["icu_units"],
            "readings": DUCK["readings"],
            "patients": DUCK["patients"],
            "measure_ref": DUCK["measure_ref"],
            "icu_moves": "select m.* from movements m join icu_units u on u.ids_ufr = m.ids_ufr",
            "staged": (
                "select cast(m.dt_deb_mouv_ufr as date) as dt_deb, cast(r.id_nda as varchar) as id_nda, "
                "r.id_measure_type, r.dt_insert, r.value_numeric, r.dt_cancel "
                "from readings r join icu_moves m on cast(r.id_nda as varchar) = m.id_nda "
                "and r.dt_insert >= m.dt_deb_mouv_ufr "
                f"and r.dt_insert <= m.dt_deb_mouv_ufr + to_microseconds({self.window_us})"
            ),
            "profile": (
                f"select id_nda, dt_deb, {', '.join(prof_cols)} from staged "
                f"where dt_cancel = '' and id_measure_type in {codes_list} group by id_nda, dt_deb"
            ),
            "pat_info": (
                "select n.id_nda, p.age, min(n.dt_deb_mouv_ufr) as min_dt_deb_mouv, "
                "max(n.dt_deb_mouv_ufr) as max_dt_deb_mouv, max(n.dt_fin_mouv_ufr) as max_dt_fin_mouv, "
                "p.cd_sex_tr, p.dt_deces from icu_moves n join patients p on p.ids_pat = n.ids_pat "
                "where n.id_nda in (select id_nda from staged) "
                "group by n.id_nda, p.age, p.cd_sex_tr, p.dt_deces"
            ),
            "demo": "select distinct id_nda, age, dt_deces from pat_info",
            "cases": (
                f"select id_nda, dt_deb, {totals}, {start} as dt_min, {end} as dt_max from profile "
                f"where ({presence(self.vois)}) and ({counted(self.vois, self.min_measures)})"
            ),
            "cohort": (
                f"select c.id_nda, c.dt_deb as j1, {', '.join('c.' + v for v in self.vois)}, d.age, d.dt_deces, "
                "c.dt_min, c.dt_max from cases c join demo d on c.id_nda = d.id_nda "
                f"where d.age >= {int(self.age_min)} and {stay_ok.replace('dt_min', 'c.dt_min').replace('dt_max', 'c.dt_max')}"
            ),
            "useful": (
                "select * from staged s where s.dt_cancel = '' and exists "
                "(select 1 from cohort c where c.id_nda = s.id_nda and c.j1 = s.dt_deb)"
            ),
        }
        order = list(all_ctes)
        needed = {
            "staged": ["movements", "icu_units", "readings", "icu_moves", "staged"],
            "profile": ["movements", "icu_units", "readings", "icu_moves", "staged", "profile"],
        }
        chain = order[: order.index(upto) + 1]
        names = needed.get(upto, chain)
        return {k: all_ctes[k] for k in names}

    def with_(self, upto: str, extra: dict[str, str] | None = None) -> str:
        parts = [f"{k} as ({v})" for k, v in self.ctes(upto).items()]
        for k, v in (extra or {}).items():
            parts.append(f"{k} as ({v})")
        return "with " + ",\n".join(parts) + "\n"
