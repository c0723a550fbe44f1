"""Registered queries over the test tables, and their DuckDB twins.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs one operator (or a short
composition) of the library over the stand-in tables; ``ORACLE[name]`` is
the same result stated in DuckDB SQL. Column names match; doubles are
rounded to 6 decimals on both sides; intervals are given in seconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortspark.functions import codes as K
from cohortspark.operators import cohort as C
from cohortspark.operators import features as FE
from cohortspark.operators import folds as FO
from cohortspark.operators import metrics as M
from cohortspark.operators import models as MO
from cohortspark.operators import neighbours as NB
from cohortspark.operators.ordering import positions
from cohortspark.operators import profile as P
from cohortspark.operators import scores as SC
from cohortspark.operators import spd as SPD
from cohortspark.operators import staging as S
from cohortspark.operators import svm as SV
from cohortspark.operators import waves as W
from cohortspark.plans import cohort_selection as CS
from cohortspark.plans import oracle_sql as OS
from cohortspark.plans.oracle_sql import CohortSQL, secs, voi_total
from cohortspark.session import ensure_checkpoint_dir, materialise
from cohortspark.sources import io as IO
from cohortspark.sources import stand_ins as SI
from cohortspark.sources.stand_ins import DUCK

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Fixed parameters of the registered queries on the test tables.
FREQUENT_MIN_COUNT = 3000
TOP_N = 20
PAIRED_MIN_PTS = 3
PAIRED_HOURS = 48.0
HIST_BINS = 50

VOIS = list(CS.TEST_VOIS)
CODES = K.voi_codes(VOIS)
XCODES = list(K.EXPLORATION_CODES)
CSQL = CohortSQL(CS.TEST_VOIS, CS.TEST_WINDOW, CS.TEST_MIN_MEASURES, CS.TEST_AGE_MIN, CS.TEST_STAY_HOURS)


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def plan(spark: SparkSession, sf_dir: str, *store: str) -> CS.CohortPlan:
    """``store``: frames that the query reads more than once."""
    return CS.CohortPlan.from_test_tables(spark, sf_dir, store=store)


def r6(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), 6)


def d6(expr: str) -> str:
    return f"round(cast({expr} as double), 6)"


# --------------------------------------------------------------------------
# Profile queries

_MEASURE_WITH = CSQL.with_("staged", {"measure_ref": DUCK["measure_ref"]})


@register(
    "measure_counts",
    _MEASURE_WITH
    + "select count(*) as counter, s.id_measure_type, r.label from staged s join measure_ref r "
    "on s.id_measure_type = try_cast(r.code as int) where s.dt_cancel = '' "
    "group by s.id_measure_type, r.label order by counter desc, s.id_measure_type, r.label",
)
def q_measure_counts(spark, sf_dir):
    p = plan(spark, sf_dir)
    return P.measure_counts(p.staged(), p.measure_ref)


_COUNTS_SQL = (
    "select count(*) as counter, s.id_measure_type, r.label from staged s join measure_ref r "
    "on s.id_measure_type = try_cast(r.code as int) where s.dt_cancel = '' group by s.id_measure_type, r.label"
)


@register(
    "top_measures",
    _MEASURE_WITH
    + f"select * from ({_COUNTS_SQL}) order by counter desc, id_measure_type, label limit {TOP_N}",
)
def q_top_measures(spark, sf_dir):
    p = plan(spark, sf_dir)
    return P.top_measures(P.measure_counts(p.staged(), p.measure_ref), TOP_N)


@register(
    "frequent_measures",
    _MEASURE_WITH
    + f"select * from ({_COUNTS_SQL}) where counter > {FREQUENT_MIN_COUNT}",
)
def q_frequent_measures(spark, sf_dir):
    p = plan(spark, sf_dir)
    return P.frequent_measures(P.measure_counts(p.staged(), p.measure_ref), FREQUENT_MIN_COUNT)


@register("stay_window_readings", CSQL.with_("staged") + "select * from staged")
def q_stay_window_readings(spark, sf_dir):
    return plan(spark, sf_dir).staged()


@register("count_cases", CSQL.with_("staged") + (
    "select count(distinct (id_nda, dt_deb)) as n_cases from staged "
    f"where dt_cancel = '' and id_measure_type in {K.codes_in_list_text(CODES)}"
))
def q_count_cases(spark, sf_dir):
    return P.count_cases(plan(spark, sf_dir).staged(), CODES)


@register("count_stays", CSQL.with_("staged") + (
    "select count(distinct id_nda) as n_stays from staged "
    f"where dt_cancel = '' and id_measure_type in {K.codes_in_list_text(CODES)}"
))
def q_count_stays(spark, sf_dir):
    return P.count_stays(plan(spark, sf_dir).staged(), CODES)


@register("time_bounds", CSQL.with_("staged") + "select min(dt_deb) as beginning, max(dt_deb) as ending from staged")
def q_time_bounds(spark, sf_dir):
    return P.time_bounds(plan(spark, sf_dir).staged())


def _key_sql(a: str = "id_nda", b: str = "dt_deb") -> str:
    return f"concat({a}, cast({b} as varchar))"


@register("counter_matrix", CSQL.with_("profile") + (
    f"select id_nda, dt_deb, {_key_sql()} as id_ndaj1, "
    + ", ".join(f"nullif(n_{c}, 0) as n_{c}" for c in CODES)
    + " from profile"
))
def q_counter_matrix(spark, sf_dir):
    return P.counter_matrix(plan(spark, sf_dir).profile(), CODES)


@register("case_type_counts", CSQL.with_("staged") + (
    "select id_nda, dt_deb, id_measure_type, count(*) as counter from staged "
    f"where dt_cancel = '' and id_measure_type in {K.codes_in_list_text(CODES)} group by id_nda, dt_deb, id_measure_type"
))
def q_case_type_counts(spark, sf_dir):
    """A2 in its long form."""
    return P.case_type_counts(plan(spark, sf_dir).staged(), CODES)


@register("first_last_matrix", CSQL.with_("profile") + (
    f"select id_nda, dt_deb, {_key_sql()} as id_ndaj1, "
    + ", ".join(f"first_{c}, last_{c}" for c in CODES)
    + " from profile"
))
def q_first_last_matrix(spark, sf_dir):
    return P.first_last_matrix(plan(spark, sf_dir).profile(), CODES)


@register("duration_matrix", CSQL.with_("profile") + (
    f"select id_nda, dt_deb, {_key_sql()} as id_ndaj1, "
    + ", ".join(f"{d6(secs(f'first_{c}', f'last_{c}'))} as dur_{c}" for c in CODES)
    + " from profile"
))
def q_duration_matrix(spark, sf_dir):
    m = P.duration_matrix(plan(spark, sf_dir).profile(), CODES)
    return m.select("id_nda", "dt_deb", "id_ndaj1", *[r6(f"dur_{c}").alias(f"dur_{c}") for c in CODES])


# --------------------------------------------------------------------------
# Cohort filters

@register("presence_filter", CSQL.with_("profile") + (
    f"select id_nda, dt_deb, {_key_sql()} as id_ndaj1 from profile where "
    + OS.presence(VOIS)
))
def q_presence_filter(spark, sf_dir):
    return C.presence_filter(plan(spark, sf_dir).profile(), VOIS).select(
        "id_nda", "dt_deb", P.case_key().alias("id_ndaj1")
    )


@register("count_filter", CSQL.with_("profile") + (
    "select id_nda, dt_deb, " + ", ".join(f"{voi_total(v)} as {v}" for v in VOIS)
    + f" from profile where ({OS.presence(VOIS)}) and ({OS.counted(VOIS, CS.TEST_MIN_MEASURES)})"
))
def q_count_filter(spark, sf_dir):
    p = plan(spark, sf_dir)
    kept = C.count_filter(C.presence_filter(p.profile(), VOIS), VOIS, CS.TEST_MIN_MEASURES)
    return C.voi_totals(kept, VOIS)


_XPROFILE = "select id_nda, dt_deb, " + ", ".join(
    f"count(*) filter (where id_measure_type = {c}) as n_{c}, "
    f"min(dt_insert) filter (where id_measure_type = {c}) as first_{c}, "
    f"max(dt_insert) filter (where id_measure_type = {c}) as last_{c}"
    for c in XCODES
) + f" from staged where dt_cancel = '' and id_measure_type in {K.codes_in_list_text(XCODES)} group by id_nda, dt_deb"


def _xdur(c: int) -> str:
    return f"coalesce({secs(f'first_{c}', f'last_{c}')} >= {PAIRED_HOURS * 3600.0}, false)"


@register("paired_filters", CSQL.with_("staged", {"xprofile": _XPROFILE}) + (
    "select id_nda, dt_deb, "
    "(n_10102 > 0 and n_10120 > 0 and ((n_11 > 0 and n_12 > 0) or (n_14 > 0 and n_15 > 0))) as paired_presence, "
    f"(((n_11 >= {PAIRED_MIN_PTS} and n_12 >= {PAIRED_MIN_PTS}) or (n_14 >= {PAIRED_MIN_PTS} and n_15 >= {PAIRED_MIN_PTS})) "
    f"and n_10102 >= {PAIRED_MIN_PTS} and n_10120 >= {PAIRED_MIN_PTS}) as paired_count, "
    f"(({_xdur(11)} or {_xdur(14)}) and ({_xdur(12)} or {_xdur(15)}) and {_xdur(10102)} and {_xdur(10120)}) as paired_duration "
    "from xprofile"
))
def q_paired_filters(spark, sf_dir):
    prof = P.case_profile(plan(spark, sf_dir).staged(), XCODES)
    return prof.select(
        "id_nda",
        "dt_deb",
        C.paired_presence().alias("paired_presence"),
        C.paired_count(PAIRED_MIN_PTS).alias("paired_count"),
        C.paired_duration(PAIRED_HOURS).alias("paired_duration"),
    )


@register("patient_info", CSQL.with_("pat_info") + "select * from pat_info")
def q_patient_info(spark, sf_dir):
    return plan(spark, sf_dir).patient_info()


@register("case_demographics", CSQL.with_("pat_info") + (
    f"select distinct {_key_sql('s.id_nda', 's.dt_deb')} as id_ndaj1, p.age, p.dt_deces "
    "from pat_info p join staged s on p.id_nda = s.id_nda where s.dt_cancel = ''"
))
def q_case_demographics(spark, sf_dir):
    p = plan(spark, sf_dir)
    cases = p.staged().where(F.col("dt_cancel") == "").select("id_nda", "dt_deb").distinct()
    return (
        cases.join(p.demographics(), "id_nda")
        .select(P.case_key().alias("id_ndaj1"), "age", "dt_deces")
        .distinct()
    )


@register("age_filter", CSQL.with_("cases") + (
    "select c.id_nda, c.dt_deb, d.age, d.dt_deces from cases c join "
    "(select distinct id_nda, age, dt_deces from pat_info) d on c.id_nda = d.id_nda "
    f"where d.age >= {CS.TEST_AGE_MIN}"
))
def q_age_filter(spark, sf_dir):
    p = plan(spark, sf_dir)
    kept = C.count_filter(C.presence_filter(p.profile(), VOIS), VOIS, CS.TEST_MIN_MEASURES)
    return C.age_filter(kept.select("id_nda", "dt_deb"), p.demographics(), CS.TEST_AGE_MIN).select(
        "id_nda", "dt_deb", "age", "dt_deces"
    )


_START, _END = OS.bounds(VOIS)


@register("stay_bounds", CSQL.with_("profile") + (
    f"select id_nda, dt_deb, dt_min, dt_max, {d6(secs('dt_min', 'dt_max'))} as stay_len_s from "
    f"(select id_nda, dt_deb, {_START} as dt_min, {_END} as dt_max from profile)"
))
def q_stay_bounds(spark, sf_dir):
    b = C.stay_bounds(plan(spark, sf_dir).profile(), VOIS)
    return b.select("id_nda", "dt_deb", "dt_min", "dt_max", r6(P.seconds_between("dt_min", "dt_max")).alias("stay_len_s"))


_COHORT_COLS = ", ".join(["id_nda", "j1", *VOIS, "age", "dt_deces", "dt_min", "dt_max"])


def _cohort_out(df: DataFrame) -> DataFrame:
    return df.select(
        "id_nda", "j1", *VOIS, "age", "dt_deces", "dt_min", "dt_max",
        r6(P.seconds_between("dt_min", "dt_max")).alias("stay_len_s"),
    )


@register("stay_filter", CSQL.with_("cohort") + (
    f"select {_COHORT_COLS}, {d6(secs('dt_min', 'dt_max'))} as stay_len_s from cohort"
))
def q_stay_filter(spark, sf_dir):
    return _cohort_out(plan(spark, sf_dir).cohort())


_FUNNEL_SQL = (
    "select (select count(*) from profile) as n_cases, "
    f"(select count(*) from profile where {OS.presence(VOIS)}) as n_present, "
    "(select count(*) from cases) as n_counted, "
    "(select count(*) from cases c join demo d on c.id_nda = d.id_nda where d.age >= {age}) as n_aged, "
    "(select count(d.dt_deces) from cases c join demo d on c.id_nda = d.id_nda where d.age >= {age}) as n_dead_aged, "
    "(select count(*) from cohort) as n_long, "
    "(select count(dt_deces) from cohort) as n_dead_long"
).format(age=CS.TEST_AGE_MIN)


@register("cohort_funnel", CSQL.with_("cohort", {"f": _FUNNEL_SQL}) + (
    "select *, 100.0 * n_dead_aged / nullif(n_aged, 0) as pct_dead_aged, "
    "100.0 * n_dead_long / nullif(n_long, 0) as pct_dead_long from f"
))
def q_cohort_funnel(spark, sf_dir):
    return plan(spark, sf_dir).funnel()


@register("mortality_rate", CSQL.with_("cohort") + (
    "select count(*) as n_cases, count(dt_deces) as n_dead, "
    "100.0 * count(dt_deces) / nullif(count(*), 0) as mortality_pct from cohort"
))
def q_mortality_rate(spark, sf_dir):
    return C.mortality_rate(plan(spark, sf_dir).cohort())


@register("voi_totals", CSQL.with_("profile") + (
    "select id_nda, dt_deb, " + ", ".join(f"{voi_total(v)} as {v}" for v in VOIS) + " from profile"
))
def q_voi_totals(spark, sf_dir):
    return C.voi_totals(plan(spark, sf_dir).profile(), VOIS)


_RMM_LONG = " union all ".join(
    f"select p.id_nda, p.dt_deb, cast(p.n_{c} as double) as x from profile p "
    f"join cohort c on c.id_nda = p.id_nda and c.j1 = p.dt_deb where p.n_{c} > 0"
    for c in CODES
)


@register("row_mean_median", CSQL.with_("cohort", {"rl": _RMM_LONG}) + (
    "select id_nda, dt_deb, round_even(avg(x), 0) as mean_nb_pts, round_even(median(x), 0) as median_nb_pts "
    "from (select distinct id_nda, j1 as dt_deb from cohort) k join rl using (id_nda, dt_deb) group by id_nda, dt_deb"
))
def q_row_mean_median(spark, sf_dir):
    p = plan(spark, sf_dir, "profile")
    cases = p.cohort().select("id_nda", F.col("j1").alias("dt_deb")).distinct()
    m = P.counter_matrix(p.profile(), CODES).join(cases, ["id_nda", "dt_deb"], "left_semi")
    return P.row_mean_median(m, [f"n_{c}" for c in CODES], ["id_nda", "dt_deb"])


@register("sampling_bands", CSQL.with_("cohort") + (
    "select id_nda, j1, case "
    f"when {' and '.join(f'{v} < 20' for v in VOIS)} then 'few' "
    f"when {' and '.join(f'{v} > 90 and {v} < 120' for v in VOIS)} then 'about_100' "
    f"when {' and '.join(f'{v} > 200' for v in VOIS)} then 'many' end as band from cohort"
))
def q_sampling_bands(spark, sf_dir):
    return plan(spark, sf_dir).cohort().select("id_nda", "j1", C.sampling_band(VOIS).alias("band"))


_HIST_VARS = [*VOIS, "age"]


def _hist_sql() -> str:
    parts = []
    for v in _HIST_VARS:
        mn = f"(select min(cast({v} as double)) from cohort)"
        mx = f"(select max(cast({v} as double)) from cohort)"
        w = f"({mx} - {mn})"
        b = (
            f"case when {w} > 0 then least(floor((cast({v} as double) - {mn}) * {HIST_BINS} / {w}) + 1, {HIST_BINS}) "
            "else 1 end"
        )
        parts.append(
            f"select '{v}' as variable, cast({b} as int) as bin, {mn} as lo, {w} as w from cohort where {v} is not null"
        )
    return " union all ".join(parts)


@register("count_histogram", CSQL.with_("cohort", {"h": _hist_sql()}) + (
    f"select variable, bin, {d6(f'min(lo) + min(w) * (bin - 1) / {HIST_BINS}')} as lower, "
    f"{d6(f'min(lo) + min(w) * bin / {HIST_BINS}')} as upper, count(*) as n from h group by variable, bin"
))
def q_count_histogram(spark, sf_dir):
    h = P.equal_width_histogram(plan(spark, sf_dir).cohort(), _HIST_VARS, HIST_BINS)
    return h.select("variable", "bin", r6("lower").alias("lower"), r6("upper").alias("upper"), "n")


@register("useful_readings", CSQL.with_("useful") + "select * from useful")
def q_useful_readings(spark, sf_dir):
    return plan(spark, sf_dir, "staged").useful()


# --------------------------------------------------------------------------
# Waves


NB_PTS = W.DEFAULT_NB_PTS
GAP = W.DEFAULT_GAP_LIMIT
ID_BLOCKS = 6
LATE_BLOCK = 2  # written after the others
REJECT_PTS = 12_000  # so many points that the shorter stays have no step
_REJECT_CTES = {
    "ranges": (
        "select id_nda, j1, min(dt_min) as dt_min, min(dt_max) as dt_max, bool_or(dt_deces is not null) as dead from cohort group by id_nda, j1"
    ),
    "all_steps": (
        "select *, cast(60000000 * round_even(floor(date_diff('microsecond', dt_min, dt_max) / 1000) "
        f"/ 1000.0 / {float(REJECT_PTS)} / 60.0, 0) as bigint) as step_us from ranges"
    ),
}

_ROUTE_ROWS = ", ".join(
    f"('{v}', {i}, {c})" for i, v in enumerate(VOIS) for c in K.codes_of(v)
)
_WAVE_CTES = {
    "route": f"select * from (values {_ROUTE_ROWS}) t(voi, voi_idx, code)",
    "vlist": "select distinct voi, voi_idx from route",
    "ranges": (
        "select id_nda, j1, min(dt_min) as dt_min, min(dt_max) as dt_max, "
        "bool_or(dt_deces is not null) as dead from cohort group by id_nda, j1"
    ),
    "steps": (
        "select * from (select *, cast(60000000 * round_even(floor(date_diff('microsecond', dt_min, dt_max) / 1000) "
        f"/ 1000.0 / {float(NB_PTS)} / 60.0, 0) as bigint) as step_us from ranges) where step_us > 0"
    ),
    "rr": (
        "select u.id_nda, u.dt_deb as j1, r.voi, r.voi_idx, u.dt_insert, u.value_numeric "
        "from useful u join route r on u.id_measure_type = r.code"
    ),
    "wf": "select id_nda, j1, voi, min(dt_insert) as t_first from rr group by id_nda, j1, voi",
    "b1": (
        "select s.id_nda, s.j1, v.voi, v.voi_idx, s.step_us, s.dead, least(s.dt_min, wf.t_first) as st "
        "from steps s cross join vlist v left join wf on wf.id_nda = s.id_nda and wf.j1 = s.j1 and wf.voi = v.voi"
    ),
    "bases": (
        "select *, date_trunc('day', st) as origin, "
        "floor(date_diff('microsecond', date_trunc('day', st), st) / step_us) as b0 from b1"
    ),
    "pts": (
        "select * from (select b.id_nda, b.j1, b.voi, b.voi_idx, b.dead, "
        "cast(floor(date_diff('microsecond', b.origin, rr.dt_insert) / b.step_us) - b.b0 as int) as i, "
        "rr.value_numeric as v from rr join bases b on rr.id_nda = b.id_nda and rr.j1 = b.j1 and rr.voi = b.voi) "
        f"where i >= 0 and i < {NB_PTS}"
    ),
    "grid": (
        "select b.id_nda, b.j1, b.voi, b.voi_idx, b.dead, cast(g.i as int) as i "
        f"from bases b cross join range(0, {NB_PTS}) g(i)"
    ),
    "binned": (
        "select g.id_nda, g.j1, g.voi, g.voi_idx, g.dead, g.i, avg(p.v) as y_mean, count(p.v) as n_readings "
        "from grid g left join pts p on g.id_nda = p.id_nda and g.j1 = p.j1 and g.voi = p.voi and g.i = p.i "
        "group by g.id_nda, g.j1, g.voi, g.voi_idx, g.dead, g.i"
    ),
    "f1": (
        "select *, "
        "last_value(case when y_mean is not null then i end ignore nulls) over wb as p, "
        "last_value(y_mean ignore nulls) over wb as vp, "
        "first_value(case when y_mean is not null then i end ignore nulls) over wa as nn, "
        "first_value(y_mean ignore nulls) over wa as vn from binned "
        "window wb as (partition by id_nda, j1, voi order by i rows between unbounded preceding and current row), "
        "wa as (partition by id_nda, j1, voi order by i rows between current row and unbounded following)"
    ),
    "filled": (
        "select *, case when y_mean is not null then y_mean "
        f"when p is not null and nn is not null then vp + (vn - vp) * (least(i, p + {GAP}) - p) / (nn - p) "
        "when p is not null then vp else vn end as y from f1"
    ),
}
_WAVE_WITH = CSQL.with_("useful", _WAVE_CTES)


def _wave_inputs(spark, sf_dir, *more: str):
    """Stored inputs; one that builds waves several times stores the useful readings too."""
    p = plan(spark, sf_dir, "staged", "cohort", *more)
    return p.hot_stays(), p.wave_readings(), p.cohort()


@register("cohort_readings", CSQL.with_("useful") + (
    f"select s.id_nda, s.dt_deb as j1, {_key_sql('s.id_nda', 's.dt_deb')} as id_case, s.id_measure_type, "
    "s.dt_insert, s.value_numeric from useful s"
))
def q_cohort_readings(spark, sf_dir):
    return plan(spark, sf_dir, "staged").cohort_readings()


@register("case_ranges", CSQL.with_("useful") + (
    "select n.id_nda, n.j1, min(s.dt_insert) as dt_min, max(s.dt_insert) as dt_max "
    "from (select distinct id_nda, j1 from cohort) n join useful s on n.id_nda = s.id_nda and n.j1 = s.dt_deb "
    "group by n.id_nda, n.j1"
))
def q_case_ranges(spark, sf_dir):
    return plan(spark, sf_dir, "staged").case_ranges()


@register("dt_ranges", CSQL.with_("useful", {
    "rng": "select s.id_nda, s.dt_deb as j1, min(s.dt_insert) as dt_min, max(s.dt_insert) as dt_max "
    "from useful s group by s.id_nda, s.dt_deb"
}) + (
    "select t1.id_nda, t1.j1, t1.dt_min, t1.dt_max, t2.dt_deces from rng t1 join cohort t2 "
    "on t1.id_nda = t2.id_nda and t1.j1 = t2.j1"
))
def q_dt_ranges(spark, sf_dir):
    p = plan(spark, sf_dir, "staged", "cohort")
    return p.case_ranges().join(p.cohort().select("id_nda", "j1", "dt_deces"), ["id_nda", "j1"]).select(
        "id_nda", "j1", "dt_min", "dt_max", "dt_deces"
    )


@register("wave_resample", _WAVE_WITH + (
    f"select id_nda, j1, voi, i, {d6('y_mean')} as y_mean, n_readings from binned"
))
def q_wave_resample(spark, sf_dir):
    hot, readings, ranges = _wave_inputs(spark, sf_dir)
    g = W.resample(spark, readings, ranges, VOIS, NB_PTS, hot)
    return g.select("id_nda", "j1", "voi", "i", r6("y_mean").alias("y_mean"), "n_readings")


@register("wave_fill", _WAVE_WITH + f"select id_nda, j1, voi, i, {d6('y')} as y from filled")
def q_wave_fill(spark, sf_dir):
    hot, readings, ranges = _wave_inputs(spark, sf_dir)
    f = W.resample_and_interpolate(spark, readings, ranges, VOIS, NB_PTS, GAP, hot=hot)
    return f.select("id_nda", "j1", "voi", "i", r6("y").alias("y"))


_PACK_SQL = (
    "select id_nda, j1, list(wave order by voi_idx) as series, bool_or(dead) as dead from "
    f"(select id_nda, j1, voi_idx, bool_or(dead) as dead, list({d6('y')} order by i) as wave "
    "from filled group by id_nda, j1, voi_idx) group by id_nda, j1"
)


def round_series(col: str = "series") -> Column:
    return F.transform(col, lambda w: F.transform(w, lambda x: F.round(x, 6)))


@register("wave_matrix", _WAVE_WITH + _PACK_SQL)
def q_wave_matrix(spark, sf_dir):
    hot, readings, ranges = _wave_inputs(spark, sf_dir)
    ds = W.build_dataset(spark, readings, ranges, VOIS, NB_PTS, GAP, hot=hot)
    return ds.select("id_nda", "j1", round_series().alias("series"), "dead")


_WAVE = "id_nda, j1, voi"
_CUBIC_CTES = {
    "knots": (
        f"select *, row_number() over w - 1 as k, count(*) over (partition by {_WAVE}) as c, lead(i) over w - i as h, "
        f"(lead(y_mean) over w - y_mean) / (lead(i) over w - i) as d from binned where y_mean is not null "
        f"window w as (partition by {_WAVE} order by i)"
    ),
    "inner_knots": (
        f"select * from (select *, lag(h) over w as hp, lag(d) over w as dp from knots window w as (partition by {_WAVE} order by k)) "
        "where c >= 4 and k >= 1 and k <= c - 2"
    ),
    "eqs": (
        f"select {_WAVE}, k, c, h, hp, 6 * (d - dp) as r, "
        "case when k = 1 then 0 when k = c - 2 then hp - h * h / hp else hp end as a, "
        "case when k = 1 then (hp + h) * (2 + hp / h) when k = c - 2 then (hp + h) * (2 + h / hp) else 2.0 * (hp + h) end as b, "
        "case when k = c - 2 then 0 when k = 1 then h - hp * hp / h else h end as g from inner_knots"
    ),
    "fwd": (
        f"select {_WAVE}, k, c, cast(b as double) as bb, cast(g as double) as gg, cast(r as double) as rr from eqs where k = 1 union all "
        "select e.id_nda, e.j1, e.voi, e.k, e.c, e.b - e.a / f.bb * f.gg, cast(e.g as double), e.r - e.a / f.bb * f.rr "
        "from fwd f join eqs e on e.id_nda = f.id_nda and e.j1 = f.j1 and e.voi = f.voi and e.k = f.k + 1"
    ),
    "bwd": (
        f"select {_WAVE}, k, c, rr / bb as m from fwd where k = c - 2 union all "
        "select f.id_nda, f.j1, f.voi, f.k, f.c, (f.rr - f.gg * b.m) / f.bb "
        "from bwd b join fwd f on f.id_nda = b.id_nda and f.j1 = b.j1 and f.voi = b.voi and f.k = b.k - 1"
    ),
    "curv": (
        f"select {_WAVE}, k, m from bwd union all "
        "select e.id_nda, e.j1, e.voi, 0, ((e.hp + e.h) * m1.m - e.hp * m2.m) / e.h from eqs e "
        "join bwd m1 on m1.id_nda = e.id_nda and m1.j1 = e.j1 and m1.voi = e.voi and m1.k = 1 "
        "join bwd m2 on m2.id_nda = e.id_nda and m2.j1 = e.j1 and m2.voi = e.voi and m2.k = 2 where e.k = 1 union all "
        "select e.id_nda, e.j1, e.voi, e.c - 1, ((e.hp + e.h) * m1.m - e.h * m2.m) / e.hp from eqs e "
        "join bwd m1 on m1.id_nda = e.id_nda and m1.j1 = e.j1 and m1.voi = e.voi and m1.k = e.c - 2 "
        "join bwd m2 on m2.id_nda = e.id_nda and m2.j1 = e.j1 and m2.voi = e.voi and m2.k = e.c - 3 where e.k = e.c - 2"
    ),
    "spot": (
        f"select f1.*, least(i, p + {GAP}) as e, nn - p as w, sum(case when y_mean is not null then 1 else 0 end) over "
        f"(partition by {_WAVE} order by i) - 1 as k from f1"
    ),
    "cubic": (
        "select s.id_nda, s.j1, s.voi, s.i, case when s.y_mean is not null then s.y_mean "
        "when s.p is not null and s.nn is not null and a.m is not null then a.m * (s.nn - s.e) ** 3 / (6 * s.w) + b.m * (s.e - s.p) ** 3 / (6 * s.w) "
        "+ (s.vp / s.w - a.m * s.w / 6) * (s.nn - s.e) + (s.vn / s.w - b.m * s.w / 6) * (s.e - s.p) "
        "when s.p is not null and s.nn is not null then s.vp + (s.vn - s.vp) * (s.e - s.p) / s.w "
        "when s.p is not null then s.vp else s.vn end as y from spot s "
        "left join curv a on a.id_nda = s.id_nda and a.j1 = s.j1 and a.voi = s.voi and a.k = s.k "
        "left join curv b on b.id_nda = s.id_nda and b.j1 = s.j1 and b.voi = s.voi and b.k = s.k + 1"
    ),
}
_CUBIC_WITH = CSQL.with_("useful", {**_WAVE_CTES, **_CUBIC_CTES}).replace("with ", "with recursive ", 1)


@register("wave_cubic", _CUBIC_WITH + f"select id_nda, j1, voi, i, {d6('y')} as y from cubic")
def q_wave_cubic(spark, sf_dir):
    hot, readings, ranges = _wave_inputs(spark, sf_dir)
    f = W.resample_and_interpolate(spark, readings, ranges, VOIS, NB_PTS, GAP, method="cubic", hot=hot)
    return f.select("id_nda", "j1", "voi", "i", r6("y").alias("y"))


@register("id_blocks", CSQL.with_("cohort") + (
    "select distinct id_nda, j1, cast(cast('0x' || substr(md5(concat(id_nda, cast(j1 as varchar), ':42')), 1, 8) as bigint) "
    f"% {ID_BLOCKS} as int) as block from cohort"
))
def q_id_blocks(spark, sf_dir):
    cases = plan(spark, sf_dir).cohort().select("id_nda", "j1").distinct()
    return W.id_blocks(cases, ID_BLOCKS)


@register("rejected_cases", CSQL.with_("cohort", _REJECT_CTES) + "select id_nda, j1, dt_min, dt_max, dead from all_steps where coalesce(step_us <= 0, true)")
def q_rejected_cases(spark, sf_dir):
    """T4: the cases whose range is too short for REJECT_PTS points."""
    return W.rejected_cases(plan(spark, sf_dir).cohort(), REJECT_PTS).select("id_nda", "j1", "dt_min", "dt_max", "dead")


@register("dataset_blocks", _WAVE_WITH + (
    "select id_nda, j1, block, series, dead from (" + _PACK_SQL + ") join (select distinct id_nda, j1, "
    "cast(cast('0x' || substr(md5(concat(id_nda, cast(j1 as varchar), ':42')), 1, 8) as bigint) "
    f"% {ID_BLOCKS} as int) as block from cohort) using (id_nda, j1)"
))
def q_dataset_blocks(spark, sf_dir):
    """The dataset written block by block: all blocks but one, then the missing one alone, read back."""
    hot, readings, ranges = _wave_inputs(spark, sf_dir, "useful")
    blocks = W.id_blocks(ranges.select("id_nda", "j1").distinct(), ID_BLOCKS)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortspark-tables/dataset-{uuid.uuid4().hex}"

    def build(numbers: list[int]) -> DataFrame:
        cases = blocks.where(F.col("block").isin(numbers))
        chosen = ranges.join(cases, ["id_nda", "j1"], "left_semi")
        ds = W.build_dataset(spark, readings, chosen, VOIS, NB_PTS, GAP, hot=hot)
        return ds.join(cases, ["id_nda", "j1"]).select("id_nda", "j1", round_series().alias("series"), "dead", "block")

    IO.save_blocks(build([b for b in range(ID_BLOCKS) if b != LATE_BLOCK]), path)
    IO.build_blocks(spark, path, ID_BLOCKS, build)
    return spark.read.parquet(path).select("id_nda", "j1", "block", "series", "dead")


@register("wave_plot_points", _WAVE_WITH + (
    "select r.id_nda, r.j1, r.voi, case r.voi "
    + " ".join(f"when '{v}' then '{K.voi_label(v)}'" for v in VOIS)
    + " end as label, r.dt_insert as t, r.value_numeric as value from rr r"
))
def q_wave_plot_points(spark, sf_dir):
    readings = plan(spark, sf_dir, "staged").cohort_readings()
    routed = W.route_to_voi(spark, readings.select("id_nda", "j1", "id_measure_type", "dt_insert", "value_numeric"), VOIS)
    return W.plot_points(routed, "value_numeric", "dt_insert")


# The same line with loose thresholds: most cases are selected, waves are short and full of gaps.

BROAD = dict(min_measures=0, age_min=10, stay_hours=6.0)
BSQL = CohortSQL(CS.TEST_VOIS, CS.TEST_WINDOW, BROAD["min_measures"], BROAD["age_min"], BROAD["stay_hours"])


def _broad_plan(spark, sf_dir, *store: str) -> CS.CohortPlan:
    return CS.CohortPlan.from_test_tables(spark, sf_dir, store=store, **BROAD)


def _broad_waves(spark, sf_dir, method: str):
    p = _broad_plan(spark, sf_dir, "staged", "cohort", "useful")
    f = W.resample_and_interpolate(spark, p.wave_readings(), p.cohort(), VOIS, NB_PTS, GAP, method=method, hot=p.hot_stays())
    # nine digits: at six, means of readings in hundredths over gaps of 64 points stand exactly between two roundings
    return f.select("id_nda", "j1", "voi", "i", F.round("y", 9).alias("y"))


@register("stay_filter_broad", BSQL.with_("cohort") + f"select {_COHORT_COLS}, {d6(secs('dt_min', 'dt_max'))} as stay_len_s from cohort")
def q_stay_filter_broad(spark, sf_dir):
    return _cohort_out(_broad_plan(spark, sf_dir).cohort())


@register("dt_ranges_broad", BSQL.with_("useful", {
    "rng": "select s.id_nda, s.dt_deb as j1, min(s.dt_insert) as dt_min, max(s.dt_insert) as dt_max from useful s group by s.id_nda, s.dt_deb"
}) + "select t1.id_nda, t1.j1, t1.dt_min, t1.dt_max, t2.dt_deces from rng t1 join cohort t2 on t1.id_nda = t2.id_nda and t1.j1 = t2.j1")
def q_dt_ranges_broad(spark, sf_dir):
    p = _broad_plan(spark, sf_dir, "staged", "cohort")
    return p.case_ranges().join(p.cohort().select("id_nda", "j1", "dt_deces"), ["id_nda", "j1"]).select("id_nda", "j1", "dt_min", "dt_max", "dt_deces")


@register("row_mean_median_broad", BSQL.with_("cohort", {"rl": _RMM_LONG}) + (
    "select id_nda, dt_deb, round_even(avg(x), 0) as mean_nb_pts, round_even(median(x), 0) as median_nb_pts "
    "from (select distinct id_nda, j1 as dt_deb from cohort) k join rl using (id_nda, dt_deb) group by id_nda, dt_deb"
))
def q_row_mean_median_broad(spark, sf_dir):
    p = _broad_plan(spark, sf_dir, "profile")
    cases = p.cohort().select("id_nda", F.col("j1").alias("dt_deb")).distinct()
    m = P.counter_matrix(p.profile(), CODES).join(cases, ["id_nda", "dt_deb"], "left_semi")
    return P.row_mean_median(m, [f"n_{c}" for c in CODES], ["id_nda", "dt_deb"])


@register("wave_fill_broad", BSQL.with_("useful", _WAVE_CTES) + "select id_nda, j1, voi, i, round(cast(y as double), 9) as y from filled")
def q_wave_fill_broad(spark, sf_dir):
    return _broad_waves(spark, sf_dir, "time")


@register("wave_cubic_broad", BSQL.with_("useful", {**_WAVE_CTES, **_CUBIC_CTES}).replace("with ", "with recursive ", 1) + "select id_nda, j1, voi, i, round(cast(y as double), 9) as y from cubic")
def q_wave_cubic_broad(spark, sf_dir):
    return _broad_waves(spark, sf_dir, "cubic")


# --------------------------------------------------------------------------
# Score forms


FIELDS = list(SI.FORM_FIELDS)
_FIELD_SQL = "champ_formulaire like 'int_esc%' or champ_formulaire in ('int_maladies_chronique', 'int_igs2')"
_DATE_FIELD_SQL = "champ_formulaire like 'int_esc%' or champ_formulaire = 'int_maladies_chronique'"
_FORM_CTES = {
    "forms": DUCK["forms"],
    "movements": DUCK["movements"],
    "patients": DUCK["patients"],
    "field_rows": f"select id_form, id_nda, champ_formulaire, cast(value_field as varchar) as value_field, j1 from forms where {_FIELD_SQL}",
    "date_rows": f"select distinct id_form, id_nda, dt_ins, j1 from forms where {_DATE_FIELD_SQL}",
    "dated": "select id_form, coalesce(j1, dt_ins) as dt_eff from date_rows",
    "lng": (
        "select concat(field_rows.id_nda, strftime(dated.dt_eff, '%Y-%m-%d'), '_', cast(field_rows.id_form as varchar)) as id_form_ndaj1, "
        "champ_formulaire, value_field from field_rows join dated on field_rows.id_form = dated.id_form"
    ),
    "mat": (
        "select *, regexp_extract(id_form_ndaj1, '(.*)_.*', 1) as id_ndaj1 from (select id_form_ndaj1, "
        + ", ".join(f"max(value_field) filter (where champ_formulaire = '{f}') as {f}" for f in FIELDS)
        + " from lng group by id_form_ndaj1)"
    ),
    "pmap": (
        "select distinct i.id_ndaj1, n.ids_pat from (select distinct id_ndaj1 from mat) i join movements n "
        "on n.id_nda = substr(i.id_ndaj1, 1, length(i.id_ndaj1) - 10)"
    ),
    "with_death": (
        "select m.*, d.dt_deces from mat m join (select pm.id_ndaj1, p.dt_deces from pmap pm "
        "join patients p on pm.ids_pat = p.ids_pat) d on m.id_ndaj1 = d.id_ndaj1"
    ),
    "scored": (
        "select *, exp(logit) / (1.0 + exp(logit)) as pr, "
        f"exp(logit) / (1.0 + exp(logit)) > {SC.SCORE_THRESHOLD} as y_pred, dt_deces is not null as y_true from "
        f"(select *, {SC.SCORE_A} + {SC.SCORE_B} * cast(int_igs2 as double) "
        f"+ {SC.SCORE_C} * ln(cast(int_igs2 as double) + 1.0) as logit from with_death)"
    ),
    "g": (
        "select cast(pr as double) as score, sum(case when y_true then 1 else 0 end) as pos, "
        "sum(case when y_true then 0 else 1 end) as neg from scored group by cast(pr as double)"
    ),
    "g2": (
        "select *, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) "
        "as neg_before, coalesce(sum(pos) over (order by score rows between unbounded preceding and 1 preceding), 0) "
        "as pos_before from g"
    ),
}
_FORM_WITH = "with " + ",\n".join(f"{k} as ({v})" for k, v in _FORM_CTES.items()) + "\n"


def _score_inputs(spark, sf_dir):
    """Forms, the matrix (stored: the map and the outcome both read it), case to patient, and the outcome of each form."""
    forms = SI.forms(spark, sf_dir)
    mat = materialise(SC.form_matrix(forms, FIELDS, strict=True), "form-matrix")
    pmap = SC.patient_map(mat, SI.movements(spark, sf_dir))
    outcome = SC.with_death(mat, pmap, SI.patients(spark, sf_dir))
    return forms, mat, pmap, outcome


@register("form_matrix", _FORM_WITH + "select * from mat")
def q_form_matrix(spark, sf_dir):
    return SC.form_matrix(SI.forms(spark, sf_dir), FIELDS, strict=True)


@register("patient_map", _FORM_WITH + "select * from pmap")
def q_patient_map(spark, sf_dir):
    return _score_inputs(spark, sf_dir)[2]


@register("case_key_split", CSQL.with_("cohort") + (
    "select nullif(regexp_extract(k, '^([0-9]+)([0-9]{4}-[0-9]{2}-[0-9]{2})$', 1), '') as id_nda, "
    "nullif(regexp_extract(k, '^([0-9]+)([0-9]{4}-[0-9]{2}-[0-9]{2})$', 2), '') as j1 "
    f"from (select {_key_sql('id_nda', 'j1')} as k from cohort)"
))
def q_case_key_split(spark, sf_dir):
    from cohortspark.functions import scalar as FX

    keys = plan(spark, sf_dir).cohort().select(P.case_key("id_nda", "j1").alias("k"))
    return keys.select(*FX.split_case_key("k", id_digits=None))


@register("severity_score", _FORM_WITH + (
    f"select id_form_ndaj1, id_ndaj1, int_igs2, dt_deces, {d6('logit')} as logit, {d6('pr')} as pr, "
    "y_pred, y_true from scored"
))
def q_severity_score(spark, sf_dir):
    s = SC.severity_score(_score_inputs(spark, sf_dir)[3])
    return s.select(
        "id_form_ndaj1", "id_ndaj1", "int_igs2", "dt_deces", r6("logit").alias("logit"), r6("pr").alias("pr"),
        "y_pred", "y_true",
    )


@register("accuracy_auc", _FORM_WITH + (
    "select (select count(*) from scored) as n, "
    f"(select {d6('avg(case when y_pred = y_true then 1.0 else 0.0 end)')} from scored) as accuracy, "
    f"{d6('case when sum(pos) * sum(neg) > 0 then sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)) end')} "
    "as auc from g2"
))
def q_accuracy_auc(spark, sf_dir):
    s = SC.severity_score(_score_inputs(spark, sf_dir)[3])
    r = M.accuracy_auc(s, "y_pred", "pr", "y_true")
    return r.select("n", r6("accuracy").alias("accuracy"), r6("auc").alias("auc"))


@register("roc_points", _FORM_WITH + (
    f"select {d6('score')} as threshold, "
    f"{d6('((select sum(neg) from g) - neg_before) / nullif((select sum(neg) from g), 0)')} as fpr, "
    f"{d6('((select sum(pos) from g) - pos_before) / nullif((select sum(pos) from g), 0)')} as tpr from g2"
))
def q_roc_points(spark, sf_dir):
    s = SC.severity_score(_score_inputs(spark, sf_dir)[3])
    r = M.roc_points(s, "pr", "y_true")
    return r.select(r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


_ENC_LONG = " union all ".join(
    f"select id_form_ndaj1, '{f}' as PARENT, {f} as label from mat" for f in FIELDS
)


@register("label_encode", _FORM_WITH[:-1] + (
    ",\ncat as (select PARENT, label, cast(dense_rank() over (partition by PARENT order by label) - 1 as int) as code "
    "from (select distinct champ_formulaire as PARENT, value_field as label from lng)),\n"
    f"el as ({_ENC_LONG})\n"
    "select el.id_form_ndaj1, "
    + ", ".join(f"max(cat.code) filter (where el.PARENT = '{f}') as {f}" for f in FIELDS)
    + " from el left join cat on el.PARENT = cat.PARENT and el.label = cat.label group by el.id_form_ndaj1"
))
def q_label_encode(spark, sf_dir):
    rows = materialise(SC.form_rows(SI.forms(spark, sf_dir)), "form-rows")
    catalogue = SC.catalogue_from_values(SC.form_long(None, rows))
    return SC.label_encode(SC.form_matrix(None, FIELDS, strict=True, rows=rows), "id_form_ndaj1", FIELDS, catalogue)


# The stand-in forms' fields take the names of the first catalogue parents, and
# the catalogue its texts from part sizes: those above CATALOGUE_BELOW are missing.
CATALOGUE_BELOW = 46
_PARENTS = [parent for _, parent in SC.FORM_FIELD_CATALOGUE][: len(FIELDS) - 1]
_RENAMED = list(zip([f for f in FIELDS if f != SI.FORM_SCORE_FIELD], _PARENTS))
_CATALOGUE_CTES = {
    "named": "select id_form_ndaj1, " + ", ".join(f'{f} as "{p}"' for f, p in _RENAMED) + " from mat",
    "catalogue": (
        f"select distinct ({[p for _, p in _RENAMED]})[p_partkey % {len(_RENAMED)} + 1] as parent, cast(p_size as varchar) as label "
        f"from part where p_size < {CATALOGUE_BELOW}"
    ),
    "codes": "select parent, label, cast(row_number() over (partition by parent order by label) - 1 as int) as code from catalogue",
    "texts": " union all ".join(f"select id_form_ndaj1, '{p}' as parent, \"{p}\" as label from named" for _, p in _RENAMED),
}
_CATALOGUE_WITH = _FORM_WITH[:-1] + ",\n" + ",\n".join(f"{k} as ({v})" for k, v in _CATALOGUE_CTES.items()) + "\n"


def _catalogue_inputs(spark, sf_dir):
    """The form matrix under catalogue names (P3), and a catalogue of all parents that lacks some texts."""
    mat = SC.rename_fields(SC.form_matrix(SI.forms(spark, sf_dir), FIELDS, strict=True), _RENAMED)
    part = SI.table(spark, sf_dir, "part").where(F.col("p_size") < CATALOGUE_BELOW)
    parent = F.element_at(F.array(*[F.lit(p) for _, p in _RENAMED]), (F.col("p_partkey") % len(_RENAMED) + 1).cast("int"))
    catalogue = part.select(parent.alias("PARENT"), F.lit(None).cast("int").alias("index"), F.col("p_size").cast("string").alias("saps2weight"))
    return mat, [p for _, p in _RENAMED], catalogue


@register("label_encode_catalogue", _CATALOGUE_WITH + (
    "select t.id_form_ndaj1, " + ", ".join(f"max(c.code) filter (where t.parent = '{p}') as \"{p}\"" for _, p in _RENAMED)
    + " from texts t left join codes c on c.parent = t.parent and c.label = t.label group by t.id_form_ndaj1"
))
def q_label_encode_catalogue(spark, sf_dir):
    """P3 + M10: fields under their catalogue names, coded by a catalogue of its own; a text it lacks is null."""
    mat, parents, catalogue = _catalogue_inputs(spark, sf_dir)
    return SC.label_encode(mat, "id_form_ndaj1", parents, catalogue)


@register("label_unseen", _CATALOGUE_WITH + (
    "select t.parent as PARENT, t.label, count(*) as n from texts t anti join codes c on c.parent = t.parent and c.label = t.label "
    "where t.label is not null group by t.parent, t.label"
))
def q_label_unseen(spark, sf_dir):
    """M10 report: the texts that the catalogue lacks."""
    mat, parents, catalogue = _catalogue_inputs(spark, sf_dir)
    return SC.unseen_texts(mat, parents, catalogue)


@register("sorted_catalogue", _CATALOGUE_WITH + (
    "select parent as PARENT, cast(row_number() over (partition by parent order by cast(label as int)) as int) as index, label as saps2weight from catalogue"
))
def q_sorted_catalogue(spark, sf_dir):
    """The catalogue by parent and index."""
    _, _, catalogue = _catalogue_inputs(spark, sf_dir)
    order = Window.partitionBy("PARENT").orderBy(F.col("saps2weight").cast("int"))
    distinct = catalogue.select("PARENT", "saps2weight").distinct().select("PARENT", F.row_number().over(order).alias("index"), "saps2weight")
    return SC.sorted_catalogue(distinct)


# Each field as a scorer of its own: its value, and the alarm "above SCORER_LIMIT".
SCORER_LIMIT = 25
_SCORER_CTES = {
    "scorer": " union all ".join(
        f"select '{f}' as model, cast({f} as double) as score, cast({f} as int) > {SCORER_LIMIT} as pred, y_true from scored where {f} is not null" for f in FIELDS
    ),
    "sg": (
        "select model, score, sum(case when y_true then 1 else 0 end) as pos, sum(case when y_true then 0 else 1 end) as neg, "
        "sum(case when pred = y_true then 1 else 0 end) as ok from scorer group by model, score"
    ),
    "sg2": (
        "select *, coalesce(sum(neg) over w, 0) as neg_before, coalesce(sum(pos) over w, 0) as pos_before from sg "
        "window w as (partition by model order by score rows between unbounded preceding and 1 preceding)"
    ),
}
_SCORER_WITH = _FORM_WITH[:-1] + ",\n" + ",\n".join(f"{k} as ({v})" for k, v in _SCORER_CTES.items()) + "\n"


def _scorers(spark, sf_dir):
    """Long table (model, p1, prediction, label): every form scored by each of its fields."""
    s = SC.severity_score(_score_inputs(spark, sf_dir)[3])
    each = F.array(*[F.struct(F.lit(f).alias("model"), F.col(f).cast("double").alias("p1")) for f in FIELDS])
    long = s.select("y_true", F.explode(each).alias("m")).select("m.model", "m.p1", F.col("y_true").cast("double").alias("label"))
    return long.where("p1 is not null").withColumn("prediction", (F.col("p1") > SCORER_LIMIT).cast("double"))


@register("scorer_evaluation", _SCORER_WITH + (
    f"select model, cast(sum(pos + neg) as bigint) as n, {d6('sum(ok) / sum(pos + neg)')} as accuracy, "
    f"{d6('case when sum(pos) * sum(neg) > 0 then sum(pos * (neg_before + 0.5 * neg)) / (sum(pos) * sum(neg)) end')} as auc from sg2 group by model"
))
def q_scorer_evaluation(spark, sf_dir):
    """M6 / M9 of every model of one table of predictions."""
    r = MO.evaluation(_scorers(spark, sf_dir))
    return r.select("model", "n", r6("accuracy").alias("accuracy"), r6("auc").alias("auc"))


@register("scorer_roc", _SCORER_WITH + (
    f"select model, {d6('score')} as threshold, "
    f"{d6('(sum(neg) over (partition by model) - neg_before) / nullif(sum(neg) over (partition by model), 0)')} as fpr, "
    f"{d6('(sum(pos) over (partition by model) - pos_before) / nullif(sum(pos) over (partition by model), 0)')} as tpr from sg2"
))
def q_scorer_roc(spark, sf_dir):
    """M7 of every model of one table of predictions."""
    r = MO.model_roc(_scorers(spark, sf_dir))
    return r.select("model", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


# --------------------------------------------------------------------------
# Features and folds (embedding stand-in: 4 VOIs x 16 points per case)


ALPHA = 1.0
K_FOLDS = 5
K_SPLIT = 3
N_SAMPLES = 6

_SERIES_CTES = {
    "sl": DUCK["series_long"],
    "mm": (
        "select *, min(y) over (partition by case_id, i) as mn, max(y) over (partition by case_id, i) as mx from sl"
    ),
    "sc": "select case_id, v, i, dead, case when mx > mn then (y - mn) / (mx - mn) else y - mn end as y from mm",
}
_SERIES_WITH = "with " + ",\n".join(f"{k} as ({v})" for k, v in _SERIES_CTES.items()) + "\n"


def _series(spark, sf_dir):
    return SI.embedding_series(spark, sf_dir)


@register("point_minmax", _SERIES_WITH + f"select case_id, v, i, {d6('y')} as y from sc")
def q_point_minmax(spark, sf_dir):
    s = FE.scale_points(_series(spark, sf_dir)).select("case_id", "scaled")
    long = FE.matrix_long(s, ["case_id"], "scaled", ("v", "i", "y"))
    return long.select("case_id", F.col("v").cast("int").alias("v"), F.col("i").cast("int").alias("i"), r6("y").alias("y"))


@register("case_covariance", _SERIES_WITH + (
    f"select a.case_id, a.v as v1, b.v as v2, {d6(f'covar_pop(a.y, b.y) + case when a.v = b.v then {ALPHA} else 0.0 end')} "
    "as cov from sc a join sc b on a.case_id = b.case_id and a.i = b.i group by a.case_id, a.v, b.v"
))
def q_case_covariance(spark, sf_dir):
    s = FE.add_covariance(FE.scale_points(_series(spark, sf_dir)), "scaled", "cov", 0, ALPHA).select("case_id", "cov")
    long = FE.matrix_long(s, ["case_id"], "cov", ("v1", "v2", "cov"))
    return long.select(
        "case_id", F.col("v1").cast("int").alias("v1"), F.col("v2").cast("int").alias("v2"), r6("cov").alias("cov")
    )


_LABELLED = f"(select vec_id as case_id, label < {SI.SERIES_TARGET_BELOW} as dead from embeddings)"


@register("stratified_folds", (
    f"select case_id, dead, cast(ntile({K_FOLDS}) over (partition by dead order by case_id) - 1 as int) as fold "
    f"from (select vec_id as case_id, label < {SI.SERIES_TARGET_BELOW} as dead from embeddings)"
))
def q_stratified_folds(spark, sf_dir):
    d = _series(spark, sf_dir).select("case_id", "dead")
    return FO.stratified_folds(d, "dead", ["case_id"], K_FOLDS).select("case_id", "dead", "fold")


_SEEDED = "md5(concat(cast(case_id as varchar), ':42')), case_id"


@register("fold_counts", (
    f"select fold, dead, count(*) as n from (select dead, cast(ntile({K_FOLDS}) over (partition by dead order by case_id) - 1 as int) as fold "
    f"from {_LABELLED}) group by fold, dead"
))
def q_fold_counts(spark, sf_dir):
    """M5: rows of each class in each fold."""
    d = _series(spark, sf_dir).select("case_id", "dead")
    folds = FO.stratified_folds(d, "dead", ["case_id"], K_FOLDS)
    return folds.groupBy("fold", "dead").agg(F.count(F.lit(1)).alias("n"))


@register("stratified_split", (
    f"select *, fold = 0 as is_valid from (select case_id, dead, cast(ntile({K_SPLIT}) over "
    f"(partition by dead order by {_SEEDED}) - 1 as int) as fold from {_LABELLED})"
))
def q_stratified_split(spark, sf_dir):
    d = _series(spark, sf_dir).select("case_id", "dead")
    return FO.stratified_split(d, "dead", "case_id", K_SPLIT).select("case_id", "dead", "fold", "is_valid")


@register("sample_cases", f"select case_id, dead from {_LABELLED} order by {_SEEDED} limit {N_SAMPLES}")
def q_sample_cases(spark, sf_dir):
    return FE.sample_cases(_series(spark, sf_dir).select("case_id", "dead"), "case_id", N_SAMPLES)


@register("covariance_samples", _SERIES_WITH + (
    f"select a.case_id, a.dead, a.v as v1, b.v as v2, {d6(f'covar_pop(a.y, b.y) + case when a.v = b.v then {ALPHA} else 0.0 end')} "
    f"as cov from sc a join sc b on a.case_id = b.case_id and a.i = b.i where a.case_id in "
    f"(select case_id from {_LABELLED} order by {_SEEDED} limit {N_SAMPLES}) group by a.case_id, a.dead, a.v, b.v"
))
def q_covariance_samples(spark, sf_dir):
    long = FE.covariance_samples(_series(spark, sf_dir), "case_id", N_SAMPLES, alpha=ALPHA)
    return long.select(
        "case_id", "dead", F.col("v1").cast("int").alias("v1"), F.col("v2").cast("int").alias("v2"), r6("cov").alias("cov")
    )


# --------------------------------------------------------------------------
# Models (rows-only checks: library optimisers differ from any SQL statement)


N_VOI_SERIES = SI.SERIES_VOIS
FORM_FEATURES = [f for f in FIELDS if f != SI.FORM_SCORE_FIELD]


def _form_dataset(spark, sf_dir):
    """Label-encoded form fields with the death target, split 2/3 train, 1/3 validation."""
    _, mat, _, outcome = _score_inputs(spark, sf_dir)
    outcome = materialise(outcome, "form-outcome")  # the codes and the target read it
    catalogue = SC.catalogue_from_values(SC.form_long(None, matrix=mat, fields=FIELDS))
    enc = SC.label_encode(outcome, "id_form_ndaj1", FORM_FEATURES, catalogue)
    target = outcome.select("id_form_ndaj1", F.col("dt_deces").isNotNull().alias("dead"))
    data = enc.join(target, "id_form_ndaj1")
    split = FO.stratified_split(data, "dead", "id_form_ndaj1", K_SPLIT)
    feats = MO.materialise(MO.assemble(split, FORM_FEATURES, "dead"))
    return feats.where(~F.col("is_valid")), feats.where(F.col("is_valid"))


def _model_query(make):
    def q(spark, sf_dir):
        train, valid = _form_dataset(spark, sf_dir)
        return MO.validate(make(train.count()), train, valid)

    return q


register("model_logistic")(_model_query(lambda n: MO.logistic(0.9, n)))
register("model_tree")(_model_query(lambda n: MO.decision_tree(50)))
register("model_forest")(_model_query(lambda n: MO.random_forest(200, 50)))
register("model_boosting")(_model_query(lambda n: MO.boosting(200, 50)))
register("model_svm")(_model_query(lambda n: MO.CalibratedSVC(0.78, n)))


@register("cross_validation")
def q_cross_validation(spark, sf_dir):
    train, _ = _form_dataset(spark, sf_dir)
    folded = FO.stratified_folds(train.drop("fold"), "dead", ["id_form_ndaj1"], K_FOLDS)
    return MO.cross_val_accuracy(MO.logistic(0.9, train.count()), folded, "fold", K_FOLDS)


def _tangent_dataset(spark, sf_dir):
    """Tangent vectors of the 4-variable covariances as features, and the outcome; two thirds to train."""
    t, _ = MO.tangent_space(_cov_dataset(spark, sf_dir), "cov", N_VOI_SERIES)
    feats = MO.materialise(MO.array_features(t, "tangent", "dead").select("case_id", "dead", "is_valid", MO.FEATURES, MO.LABEL))
    return feats.where(~F.col("is_valid")), feats.where(F.col("is_valid"))


@register("tangent_svm")
def q_tangent_svm(spark, sf_dir):
    """L1 linear machine on tangent features, calibrated out of fold."""
    train, valid = _tangent_dataset(spark, sf_dir)
    pred = SV.CalibratedL1SVC("case_id", 0.78).fit(train).transform(valid)
    return M.accuracy_auc(pred, F.col("prediction") == 1.0, "p1", F.col(MO.LABEL) == 1.0)


@register("tangent_boosting")
def q_tangent_boosting(spark, sf_dir):
    """Boosting on tangent features."""
    train, valid = _tangent_dataset(spark, sf_dir)
    return MO.validate(MO.boosting(100, 1), train, valid)


def _tangent_predictions(spark, sf_dir):
    """Out-of-fold predictions of three models on the tangent features."""
    train, _ = _tangent_dataset(spark, sf_dir)
    folded = MO.materialise(FO.stratified_folds(train, "dead", ["case_id"], K_SPLIT))
    n = folded.count()
    models = {
        "logistic": MO.logistic(1.0, n).fit,
        "tree": MO.decision_tree(50).fit,
        "svm": lambda rows: SV.CalibratedL1SVC("case_id", 0.78).fit(rows),
    }
    return MO.predictions(models, MO.fold_pairs(folded, "fold", K_SPLIT), "case_id")


@register("model_evaluation")
def q_model_evaluation(spark, sf_dir):
    """M5 / M6: n, accuracy and AUC of each model on each held-out fold."""
    return MO.evaluation(_tangent_predictions(spark, sf_dir), ["model", "fold"])


@register("model_roc")
def q_model_roc(spark, sf_dir):
    """M7: ROC points of each model."""
    return MO.model_roc(_tangent_predictions(spark, sf_dir))


def _cov_dataset(spark, sf_dir):
    s = FE.add_covariance(FE.scale_points(_series(spark, sf_dir)), "scaled", "cov", 0, ALPHA)
    stored = MO.materialise(s.select("case_id", "dead", "cov"))  # the split's ranges are sampled: a pass of its own
    return MO.materialise(FO.stratified_split(stored, "dead", "case_id", K_SPLIT))


@register("tangent_features")
def q_tangent_features(spark, sf_dir):
    t, _ = MO.tangent_space(_cov_dataset(spark, sf_dir), "cov", N_VOI_SERIES)
    return t.select("case_id", "dead", "tangent")


@register("tangent_logistic")
def q_tangent_logistic(spark, sf_dir):
    t, _ = MO.tangent_space(_cov_dataset(spark, sf_dir), "cov", N_VOI_SERIES)
    feats = MO.array_features(t, "tangent", "dead")
    train, valid = feats.where(~F.col("is_valid")), feats.where(F.col("is_valid"))
    return MO.validate(MO.logistic(1.0, train.count()), train, valid)


@register("nearest_mean")
def q_nearest_mean(spark, sf_dir):
    d = _cov_dataset(spark, sf_dir)
    train, valid = d.where(~F.col("is_valid")), d.where(F.col("is_valid"))
    pred = MO.nearest_mean(train, valid, "cov", "dead", N_VOI_SERIES)
    return pred.select("case_id", "dead", "prediction", "p1")


@register("neighbour_vote")
def q_neighbour_vote(spark, sf_dir):
    """Vote of the nearest neighbours of each validation case among the training cases."""
    d = _cov_dataset(spark, sf_dir)
    found = NB.nearest_neighbours(d.where(~F.col("is_valid")), d.where(F.col("is_valid")), "cov", "case_id", "dead", N_VOI_SERIES)
    return NB.neighbour_vote(found, "case_id")


# Matrix geometry of the first two variables in closed form, with DuckDB twins.

_LN = ("ln({0})", "1 / {0}")
_EXP = ("exp({0})", "exp({0})")
_ROOT = ("sqrt({0})", "0.5 / sqrt({0})")
_INVERSE_ROOT = ("1 / sqrt({0})", "-0.5 / ({0} * sqrt({0}))")


def _sym_sql(source: str, function: tuple[str, str], keep: str = "") -> str:
    """A function of the symmetric matrix (a, b, c) of each row of ``source``."""
    f, slope = function
    hi, lo = f.format("(t + r)"), f.format("(t - r)")
    return (
        f"(select {keep}p + q * a as a, q * b as b, p + q * c as c from (select *, ({hi} + {lo}) / 2 - q * t as p from "
        f"(select *, case when r > 1e-12 * abs(t) then ({hi} - {lo}) / (2 * r) else {slope.format('t')} end as q from "
        f"(select *, (a + c) / 2 as t, sqrt((a - c) / 2 * ((a - c) / 2) + b * b) as r from {source}))))"
    )


def _between_sql(k: str, m: str, keep: str = "", on: str = "true") -> str:
    """``k m k`` for the matrices of ``m`` and the matrix ``k``."""
    return (
        f"(select {keep}(k.a * m.a + k.b * m.b) * k.a + (k.a * m.b + k.b * m.c) * k.b as a, "
        "(k.a * m.a + k.b * m.b) * k.b + (k.a * m.b + k.b * m.c) * k.c as b, "
        f"(k.b * m.a + k.c * m.b) * k.b + (k.b * m.b + k.c * m.c) * k.c as c from {m} m join {k} k on {on})"
    )


_MEAN = "avg(a) as a, avg(b) as b, avg(c) as c"
_PAIR_CTES = {
    **_SERIES_CTES,
    "pair": (
        f"select p.case_id, any_value(p.dead) as dead, covar_pop(p.y, p.y) + {ALPHA} as a, covar_pop(p.y, q.y) as b, "
        f"covar_pop(q.y, q.y) + {ALPHA} as c from sc p join sc q on p.case_id = q.case_id and p.i = q.i and p.v = 0 and q.v = 1 group by p.case_id"
    ),
}
AFFINE_ROUNDS, WASSERSTEIN_ROUNDS = 12, 45
NEIGHBOUR_EVERY = 20  # cases that ask for neighbours


def _affine_rounds() -> dict[str, str]:
    ctes = {"mean_0": f"select {_MEAN} from pair"}
    for r in range(AFFINE_ROUNDS):
        ctes[f"inverse_{r}"] = "select * from " + _sym_sql(f"mean_{r}", _INVERSE_ROOT)
        ctes[f"step_{r}"] = f"select {_MEAN} from " + _sym_sql(_between_sql(f"inverse_{r}", "pair"), _LN)
        ctes[f"mean_{r + 1}"] = "select * from " + _between_sql(_sym_sql(f"mean_{r}", _ROOT), _sym_sql(f"step_{r}", _EXP))
    return ctes


def _materialized(ctes: dict[str, str]) -> str:
    return "with recursive " + ",\n".join(f"{k} as {'' if '(' in k else 'materialized '}({v})" for k, v in ctes.items()) + "\n"


_TANGENT_SQL = _materialized(
    {**_PAIR_CTES, **_affine_rounds(), "inverse": "select * from " + _sym_sql(f"mean_{AFFINE_ROUNDS}", _INVERSE_ROOT)}
) + (
    f"select case_id, dead, {d6('a')} as t_1, {d6('b * sqrt(2)')} as t_2, {d6('c')} as t_3 from "
    + _sym_sql(_between_sql("inverse", "pair", "case_id, dead, "), _LN, "case_id, dead, ")
)


def _pair_dataset(spark, sf_dir):
    """Loaded covariance of the first two variables of each case, as a struct (a, b, c), stored once."""
    s = _series(spark, sf_dir)
    scaled = FE.scale_points(s).withColumn("scaled", F.slice("scaled", 1, 2))
    cov = FE.add_covariance(scaled, "scaled", "cov", 0, ALPHA).select("case_id", "dead", "cov")
    return MO.materialise(cov.select("case_id", "dead", SPD.Sym.of(F.col("cov")).struct().alias("m")))


@register("tangent_pair", _TANGENT_SQL)
def q_tangent_pair(spark, sf_dir):
    """M18 in closed form: affine-invariant mean and tangent vectors of 2 x 2 covariances."""
    d = _pair_dataset(spark, sf_dir)
    t = SPD.tangent(d, "m", SPD.affine_mean(d, "m"))
    return t.select("case_id", "dead", *[r6(F.element_at("tangent", k)).alias(f"t_{k}") for k in (1, 2, 3)])


@register("neighbours_pair", _materialized(_PAIR_CTES) + (
    f"select case_id, cast(row_number() over w as int) as rank, neighbour, {d6('distance')} as distance, neighbour_label from ("
    "select *, sqrt(ln(tr / 2 + e) ** 2 + ln(tr / 2 - e) ** 2) as distance from ("
    "select q.case_id, x.case_id as neighbour, cast(x.dead as int) as neighbour_label, "
    "(q.c * x.a - 2 * q.b * x.b + q.a * x.c) / (q.a * q.c - q.b * q.b) as tr, "
    "(x.a * x.c - x.b * x.b) / (q.a * q.c - q.b * q.b) as det, sqrt(greatest(tr * tr / 4 - det, 0)) as e "
    f"from pair q join pair x on q.case_id != x.case_id where q.case_id % {NEIGHBOUR_EVERY} = 0)) "
    "window w as (partition by case_id order by distance, neighbour) qualify rank <= 5"
))
def q_neighbours_pair(spark, sf_dir):
    """Five nearest 2 x 2 covariances of every twentieth case, among all cases."""
    s = _series(spark, sf_dir)
    scaled = FE.scale_points(s).withColumn("scaled", F.slice("scaled", 1, 2))
    d = MO.materialise(FE.add_covariance(scaled, "scaled", "cov", 0, ALPHA).select("case_id", "dead", "cov"))
    found = NB.nearest_neighbours(d, d.where(F.col("case_id") % NEIGHBOUR_EVERY == 0), "cov", "case_id", "dead", 2)
    return found.select("case_id", "rank", "neighbour", r6("distance").alias("distance"), "neighbour_label")


_CLASS_CTES = {
    **_PAIR_CTES,
    "rounds(n, dead, a, b, c)": (
        "select 0, dead, a, b, c from " + _sym_sql(f"(select dead, {_MEAN} from pair group by dead)", _ROOT, "dead, ") + " union all "
        "select n + 1, dead, a, b, c from "
        + _sym_sql(
            f"(select n, dead, {_MEAN} from "
            + _sym_sql(_between_sql("rounds", "pair", "k.n, k.dead, ", f"k.dead = m.dead and k.n < {WASSERSTEIN_ROUNDS}"), _ROOT, "n, dead, ")
            + " group by n, dead)",
            _ROOT, "n, dead, ",
        )
    ),
    "roots": f"select dead, a, b, c from rounds where n = {WASSERSTEIN_ROUNDS}",
    # the root of a class mean is kept, the mean is its square
    "away": (
        "select x.case_id, x.real, x.dead, greatest(p.a + p.c + r.a * r.a + 2 * r.b * r.b + r.c * r.c "
        "- 2 * sqrt(x.a + x.c + 2 * sqrt(greatest(x.a * x.c - x.b * x.b, 0))), 0) as d from "
        + _between_sql("roots", "pair", "m.case_id, m.dead as real, k.dead, ") + " x join pair p on p.case_id = x.case_id join roots r on r.dead = x.dead"
    ),
}


@register("nearest_mean_pair", _materialized(_CLASS_CTES) + (
    f"select case_id, real as dead, cast(arg_min(dead, d) as int)::double as prediction, "
    f"{d6('max(exp(-d)) filter (where dead) / sum(exp(-d))')} as p1 from away group by case_id, real"
))
def q_nearest_mean_pair(spark, sf_dir):
    """M19 in closed form: nearest Wasserstein class mean of 2 x 2 covariances."""
    d = _pair_dataset(spark, sf_dir)
    return SPD.nearest_mean(d, d, "m", "dead").select("case_id", "dead", "prediction", r6("p1").alias("p1"))


# --------------------------------------------------------------------------
# SQL path, previews, checks and row statistics


PREVIEW_N = 10
LOW_DENSITY_BELOW = 10.0


@register("sql_measure_counts", _MEASURE_WITH + _COUNTS_SQL)
def q_sql_measure_counts(spark, sf_dir):
    """The measure counts as an SQL text over DataFrame parameters (lazy, no collect)."""
    p = plan(spark, sf_dir)
    return IO.run_sql(
        spark,
        "select count(*) as counter, s.id_measure_type, r.label from {staged} s join {ref} r "
        "on s.id_measure_type = try_cast(r.code as int) where s.dt_cancel = :valid "
        "group by s.id_measure_type, r.label",
        args={"valid": ""},
        staged=p.staged(),
        ref=p.measure_ref,
    )


@register("preview_cases", CSQL.with_("profile") + (
    f"select id_nda, dt_deb, {_key_sql()} as id_ndaj1, "
    + ", ".join(f"nullif(n_{c}, 0) as n_{c}" for c in CODES)
    + f" from profile order by id_nda desc, dt_deb desc limit {PREVIEW_N}"
))
def q_preview_cases(spark, sf_dir):
    """Last rows of the counter matrix by case key (top-k, no full sort)."""
    return IO.preview(P.counter_matrix(plan(spark, sf_dir).profile(), CODES), ["id_nda", "dt_deb"], PREVIEW_N, last=True)


@register("frame_shape", CSQL.with_("profile") + (
    f"select count(*) as n_rows, {3 + len(CODES)} as n_cols from profile"
))
def q_frame_shape(spark, sf_dir):
    """Size of the counter matrix."""
    return P.frame_shape(P.counter_matrix(plan(spark, sf_dir).profile(), CODES))


DUPLICATE_FIELDS = 4
_FOLDED_CTES = {
    "folded": (
        f"select * replace (case when champ_formulaire like 'int_esc_%' then concat('int_esc_', cast(cast(right(champ_formulaire, 1) as int) % {DUPLICATE_FIELDS} as varchar)) "
        "else champ_formulaire end as champ_formulaire) from lng"
    ),
}


@register("form_duplicates_folded", _FORM_WITH[:-1] + ",\n" + ",\n".join(f"{k} as ({v})" for k, v in _FOLDED_CTES.items()) + (
    "\nselect id_form_ndaj1, champ_formulaire, count(*) as n from folded group by id_form_ndaj1, champ_formulaire having count(*) > 1"
))
def q_form_duplicates_folded(spark, sf_dir):
    """A13 report on forms whose fields are folded onto fewer names, so that many have several rows."""
    long = SC.form_long(SI.forms(spark, sf_dir))
    f = F.col("champ_formulaire")
    number = (F.right(f, F.lit(1)).try_cast("int") % DUPLICATE_FIELDS).cast("string")
    return SC.form_duplicates(long.withColumn("champ_formulaire", F.when(f.like("int_esc_%"), F.concat(F.lit("int_esc_"), number)).otherwise(f)))


@register("form_duplicates", _FORM_WITH + (
    "select id_form_ndaj1, champ_formulaire, count(*) as n from lng group by id_form_ndaj1, champ_formulaire "
    "having count(*) > 1"
))
def q_form_duplicates(spark, sf_dir):
    """Form fields holding more than one value (a pivot would be ambiguous)."""
    return SC.form_duplicates(SC.form_long(SI.forms(spark, sf_dir)))


_RMM_SQL = (
    "select id_nda, dt_deb, round_even(avg(x), 0) as mean_nb_pts, round_even(median(x), 0) as median_nb_pts "
    "from (select distinct id_nda, j1 as dt_deb from cohort) k join rl using (id_nda, dt_deb) group by id_nda, dt_deb"
)


def _row_stats(spark, sf_dir):
    return QUERIES["row_mean_median"](spark, sf_dir)


@register("point_count_stats", CSQL.with_("cohort", {"rl": _RMM_LONG, "rmm": _RMM_SQL}) + (
    "select " + ", ".join(
        f"{d6(f'avg({c})')} as {c}_mean, {d6(f'median({c})')} as {c}_median, "
        f"{d6(f'min({c})')} as {c}_min, {d6(f'max({c})')} as {c}_max"
        for c in ("mean_nb_pts", "median_nb_pts")
    ) + " from rmm"
))
def q_point_count_stats(spark, sf_dir):
    """Mean, median, min, max of the per-case mean and median numbers of points."""
    s = P.column_stats(_row_stats(spark, sf_dir), ["mean_nb_pts", "median_nb_pts"])
    return s.select(*[r6(c).alias(c) for c in s.columns])


@register("low_density_cases", CSQL.with_("cohort", {"rl": _RMM_LONG, "rmm": _RMM_SQL}) + (
    f"select id_nda, dt_deb, mean_nb_pts, median_nb_pts from rmm where mean_nb_pts < {LOW_DENSITY_BELOW}"
))
def q_low_density_cases(spark, sf_dir):
    """Cases whose mean number of points is low."""
    return P.low_density(_row_stats(spark, sf_dir), LOW_DENSITY_BELOW)


# --------------------------------------------------------------------------
# Exploration without staging (J4): readings x movements x units (x reference),
# no cancel rule, counted by type and by stay and type.

_UNSTAGED_SQL = (
    "select cast(r.id_nda as varchar) as id_nda, r.id_measure_type from readings r "
    "join movements n on cast(r.id_nda as varchar) = n.id_nda "
    "join icu_units u on u.ids_ufr = n.ids_ufr "
    "where r.dt_insert >= n.dt_deb_mouv_ufr "
    f"and r.dt_insert <= n.dt_deb_mouv_ufr + to_microseconds({CSQL.window_us})"
)


def _unstaged(spark, sf_dir):
    p = plan(spark, sf_dir)
    return S.unstaged_window_readings(p.readings, p.movements, p.units, p.window)


@register("unstaged_measure_counts", CSQL.with_("staged", {"measure_ref": DUCK["measure_ref"], "uj": _UNSTAGED_SQL}) + (
    "select count(*) as co, uj.id_measure_type, r.label from uj join measure_ref r "
    "on uj.id_measure_type = try_cast(r.code as int) group by uj.id_measure_type, r.label"
))
def q_unstaged_measure_counts(spark, sf_dir):
    """J4 + A1: readings per type and label over the four-way join, no cancel rule."""
    p = plan(spark, sf_dir)
    per_type = _unstaged(spark, sf_dir).groupBy("id_measure_type").agg(F.count(F.lit(1)).alias("n"))
    ref = p.measure_ref.select(F.col("code").try_cast("int").alias("id_measure_type"), "label")
    return per_type.join(ref, "id_measure_type").groupBy("id_measure_type", "label").agg(F.sum("n").alias("co"))


@register("unstaged_stay_type_counts", CSQL.with_("staged", {"uj": _UNSTAGED_SQL}) + (
    "select id_nda, id_measure_type, count(*) as co from uj "
    f"where id_measure_type in {K.codes_in_list_text(XCODES)} group by id_nda, id_measure_type"
))
def q_unstaged_stay_type_counts(spark, sf_dir):
    """J4 + A2: readings per stay and type (exploration codes) over the three-way join."""
    u = _unstaged(spark, sf_dir).where(F.col("id_measure_type").isin(XCODES))
    return u.groupBy("id_nda", "id_measure_type").agg(F.count(F.lit(1)).alias("co"))


@register("demographic_duplicates", CSQL.with_("pat_info") + (
    "select id_nda, count(*) as n from (select distinct id_nda, age, dt_deces from pat_info) "
    "group by id_nda having count(*) > 1"
))
def q_demographic_duplicates(spark, sf_dir):
    """P13 report: stays whose demographics would multiply their cases."""
    return C.demographic_duplicates(C.case_demographics(plan(spark, sf_dir).patient_info()))


# --------------------------------------------------------------------------
# Tables and scalar functions

LOOKUP_EVERY = 7


@register("case_lookup", CSQL.with_("profile") + (
    f"select id_nda, dt_deb, {_key_sql()} as id_ndaj1, " + ", ".join(f"nullif(n_{c}, 0) as n_{c}" for c in CODES)
    + f" from profile where {_key_sql()} = (select min({_key_sql()}) from profile)"
))
def q_case_lookup(spark, sf_dir):
    """The row of one case, its text key bound as a value (here the first key)."""
    m = P.counter_matrix(plan(spark, sf_dir, "profile").profile(), CODES)
    first = m.agg(F.min("id_ndaj1")).first()[0]
    return C.case_lookup(m, first or "", F.col("id_ndaj1"))


@register("distinct_types", CSQL.with_("staged") + "select distinct id_measure_type from staged where dt_cancel = ''")
def q_distinct_types(spark, sf_dir):
    """The distinct measure types of the valid staged readings."""
    return P.valid_readings(plan(spark, sf_dir).staged()).select("id_measure_type").distinct()


@register("frequent_type_stays", CSQL.with_("staged", {"uj": _UNSTAGED_SQL}) + (
    "select count(distinct id_nda) as n_stays from uj where id_measure_type in "
    f"(select id_measure_type from uj group by id_measure_type having count(*) > {FREQUENT_MIN_COUNT})"
))
def q_frequent_type_stays(spark, sf_dir):
    """J4 + A4: stays that have a reading of a type found frequent, in one plan."""
    u = _unstaged(spark, sf_dir)
    per_stay = u.groupBy("id_nda", "id_measure_type").agg(F.count(F.lit(1)).alias("n"))  # the readings are joined and reduced once
    types = per_stay.groupBy("id_measure_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_stays"))
    frequent = types.where(F.col("n") > FREQUENT_MIN_COUNT).select("id_measure_type")
    return per_stay.join(frequent, "id_measure_type", "left_semi").agg(F.count_distinct("id_nda").alias("n_stays"))


@register("wave_plot_filled", _WAVE_WITH + (
    "select f.id_nda, f.j1, f.voi, case f.voi " + " ".join(f"when '{v}' then '{K.voi_label(v)}'" for v in VOIS)
    + f" end as label, b.origin + to_microseconds(cast((b.b0 + f.i) * b.step_us as bigint)) as t, {d6('f.y')} as value "
    "from filled f join bases b on f.id_nda = b.id_nda and f.j1 = b.j1 and f.voi = b.voi"
))
def q_wave_plot_filled(spark, sf_dir):
    """T17 after filling: the filled points of each wave with their time."""
    hot, readings, ranges = _wave_inputs(spark, sf_dir)
    filled = W.resample_and_interpolate(spark, readings, ranges, VOIS, NB_PTS, GAP, hot=hot)
    times = W.grid_times(spark, readings, ranges, VOIS, NB_PTS)
    timed = filled.select("id_nda", "j1", "voi", "i", "y").join(times, ["id_nda", "j1", "voi", "i"])
    out = W.plot_points(timed, "y", "t")
    return out.select("id_nda", "j1", "voi", "label", "t", r6("value").alias("value"))


@register("saved_cohort", CSQL.with_("cohort") + (
    f"select {_COHORT_COLS}, {d6(secs('dt_min', 'dt_max'))} as stay_len_s from cohort where {_key_sql('id_nda', 'j1')} in "
    f"(select k from (select {_key_sql('id_nda', 'j1')} as k, row_number() over (order by {_key_sql('id_nda', 'j1')}) as n from "
    f"(select distinct id_nda, j1 from cohort)) where n % {LOOKUP_EVERY} = 0)"
))
def q_saved_cohort(spark, sf_dir):
    """The cohort saved with age, read back, and a block of case ids handed over as a view."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortspark-tables/cohort-{uuid.uuid4().hex}"
    p = plan(spark, sf_dir)
    IO.save_cohort(p.cohort(), path, VOIS, with_age=True)
    saved = IO.scan(spark, path)
    cases = saved.select("id_nda", "j1", P.case_key("id_nda", "j1").alias("id_case")).distinct()
    view = f"case_ids_{uuid.uuid4().hex}"
    numbered = positions(cases, ["id_case"])
    IO.case_view(numbered.where((F.col("pos") + 1) % LOOKUP_EVERY == 0).select("id_nda", "j1"), view)
    block = IO.run_sql(spark, f"select c.* from {{saved}} c left semi join {view} v on c.id_nda = v.id_nda and c.j1 = v.j1", saved=saved)
    return _cohort_out(block)


@register("stored_tables", CSQL.with_("staged") + (
    "select * from (values ('created', true, 1), ('kept', true, 1), ('appended to', true, 2), ('replaced', true, 1), ('dropped', false, 0)) t(step, there, times), "
    "(select count(*) as n from staged where dt_cancel = '') s"
).replace("select * from (values", "select step, there, times * n as n_rows from (values"))
def q_stored_tables(spark, sf_dir):
    """A table made from a query, kept by create-if-absent, appended to, replaced, and dropped; its rows after each step."""
    rows = P.valid_readings(plan(spark, sf_dir).staged())
    name = f"cohortspark_valid_{uuid.uuid4().hex}"
    steps = []

    def said(step: str) -> None:
        there = IO.table_exists(spark, name)
        steps.append((step, there, IO.scan(spark, name).count() if there else 0))

    IO.create_table_as(rows, name)
    said("created")
    IO.create_if_absent(spark, name, rows.limit(0))
    said("kept")
    IO.create_table_as(rows, name, mode="append")
    said("appended to")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cohortspark-tables/valid-{uuid.uuid4().hex}"
    IO.write_parquet(IO.scan(spark, name).limit(0), path, mode="errorifexists")
    IO.write_parquet(rows, path)
    IO.create_table_as(IO.scan(spark, path), name, mode="overwrite")
    said("replaced")
    IO.drop_table(spark, name)
    IO.drop_table(spark, name)  # a missing table is no error
    said("dropped")
    return spark.createDataFrame(steps, "step string, there boolean, n_rows long")


@register("scalar_functions", f"with r as ({DUCK['readings']}) " + (
    "select id_nda, strptime(strftime(dt_insert, '%d/%m/%Y %H:%M:%S'), '%d/%m/%Y %H:%M:%S') as t, "
    "cast(round(value_numeric * 100) as bigint)::varchar as hundredths, "
    f"id_measure_type in {K.codes_in_list_text(CODES)} as listed, 'Fréquence' as label from r"
))
def q_scalar_functions(spark, sf_dir):
    """Text to time, codes from a list text, Latin-1 bytes to text, value to text."""
    from cohortspark.functions import scalar as FX

    r = SI.readings(spark, sf_dir)
    listed = FX.in_list_text_to_codes(K.codes_in_list_text(CODES))
    return r.select(
        "id_nda",
        FX.parse_timestamp(F.date_format("dt_insert", "dd/MM/yyyy HH:mm:ss"), "dd/MM/yyyy HH:mm:ss").alias("t"),
        FX.as_text(F.round(F.col("value_numeric") * 100).cast("long")).alias("hundredths"),
        F.col("id_measure_type").isin(listed).alias("listed"),
        FX.decode_latin1(F.encode(F.lit("Fréquence"), "ISO-8859-1")).alias("label"),
    )
