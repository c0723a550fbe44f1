"""Logical input tables built from the driver's test tables.

The reference reads hospital tables (unit movements, bedside readings,
patients, score forms). The test data has none of them, so each logical
table is derived from a test table by a fixed rule. Every rule exists twice:
as a Spark DataFrame (``movements(spark, sf_dir)`` ...) and as the DuckDB SQL
body the oracle uses (``DUCK``). Both must stay in step.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.sources.schemas import MEASURE_REF_SCHEMA

# Stand-in parameters (fixed; see FIXTURES.md §2).
ICU_UNIT_LIMIT = 3          # regions 0..2 play the intensive-care units
MOVEMENT_LENGTH = timedelta(days=3)
CANCEL_K_BELOW = 5          # readings with props.k below this are cancelled
EVENT_CODES = (("view", 10102), ("click", 10120), ("purchase", 14))
OTHER_EVENT_CODE = 15
DEATH_SEGMENT = "FURNITURE"
DEATH_DATE = "2024-02-15"
# Four measure-reference rows (code as text, label).
MEASURE_REF_ROWS = (
    ("10102", "Heart rate"),
    ("10120", "Respiration rate"),
    ("14", "Systolic arterial pressure"),
    ("15", "Diastolic arterial pressure"),
)
SERIES_VOIS = 4             # an embedding of 64 floats = 4 variables x 16 points
SERIES_POINTS = 16
SERIES_TARGET_BELOW = 5     # target = label < 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit movements: one per signup event (stay id as text)."""
    ev = table(spark, sf_dir, "events")
    return ev.where(F.col("event_type") == "signup").select(
        F.col("user_id").cast("string").alias("id_nda"),
        (F.col("event_id") % 5).cast("int").alias("ids_ufr"),
        F.col("user_id").alias("ids_pat"),
        F.col("ts").alias("dt_deb_mouv_ufr"),
        (F.col("ts") + F.lit(MOVEMENT_LENGTH)).alias("dt_fin_mouv_ufr"),
    )


def icu_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "region")
    return reg.where(F.col("r_regionkey") < ICU_UNIT_LIMIT).select(F.col("r_regionkey").alias("ids_ufr"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bedside readings: every non-signup event; stay id stays numeric."""
    ev = table(spark, sf_dir, "events")
    code = F.lit(OTHER_EVENT_CODE)
    for name, c in reversed(EVENT_CODES):
        code = F.when(F.col("event_type") == name, F.lit(c)).otherwise(code)
    k = F.get_json_object("props", "$.k").try_cast("int")
    return ev.where(F.col("event_type") != "signup").select(
        F.col("user_id").alias("id_nda"),
        code.cast("int").alias("id_measure_type"),
        F.col("ts").alias("dt_insert"),
        F.col("value").alias("value_numeric"),
        F.when(k < CANCEL_K_BELOW, F.lit("x")).otherwise(F.lit("")).alias("dt_cancel"),
    )


def measure_ref(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MEASURE_REF_ROWS), MEASURE_REF_SCHEMA)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    cu = table(spark, sf_dir, "customer")
    return cu.select(
        F.col("c_custkey").alias("ids_pat"),
        (F.col("c_nationkey") * 4).cast("int").alias("age"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("cd_sex_tr"),
        F.when(F.col("c_mktsegment") == DEATH_SEGMENT, F.lit(DEATH_DATE).cast("date")).alias("dt_deces"),
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score form rows (id_form, id_nda, champ_formulaire, value_field, j1, dt_ins).

    One field per order line (``int_esc_<line>`` = max quantity) plus the
    total score field ``int_igs2`` (= summed quantity) per order.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    j1 = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date"))
    dt_ins = (F.col("o_orderdate") + F.lit(timedelta(days=1))).cast("date")
    keys = ["l_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
    # Both levels in one aggregate: per order line (max quantity) and per order
    # (summed quantity, the score field) as two grouping sets of one shuffle.
    both = j.groupingSets([[*keys, "l_linenumber"], keys], *keys, "l_linenumber").agg(
        F.max("l_quantity").alias("q_line"),
        F.sum("l_quantity").alias("q_order"),
        F.grouping("l_linenumber").alias("order_level"),
    )
    is_order = F.col("order_level") == 1
    return both.select(
        F.col("l_orderkey").alias("id_form"),
        F.col("o_custkey").cast("string").alias("id_nda"),
        F.when(is_order, F.lit("int_igs2"))
        .otherwise(F.concat(F.lit("int_esc_"), F.col("l_linenumber").cast("string")))
        .alias("champ_formulaire"),
        F.when(is_order, F.col("q_order")).otherwise(F.col("q_line")).cast("int").cast("string").alias("value_field"),
        j1.alias("j1"),
        dt_ins.alias("dt_ins"),
    )


# Field names produced by ``forms``: one per order line number, then the score.
FORM_FIELDS = tuple(f"int_esc_{i}" for i in range(1, 8)) + ("int_igs2",)
FORM_SCORE_FIELD = "int_igs2"


def embedding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed series per case: (case_id, series array<array<double>>, dead)."""
    em = table(spark, sf_dir, "embeddings")
    nv, npt = SERIES_VOIS, SERIES_POINTS
    series = F.transform(
        F.sequence(F.lit(0), F.lit(nv - 1)),
        lambda v: F.transform(
            F.sequence(F.lit(0), F.lit(npt - 1)),
            lambda p: F.element_at("embedding", v * npt + p + 1).cast("double"),
        ),
    )
    return em.select(
        F.col("vec_id").alias("case_id"),
        series.alias("series"),
        (F.col("label") < SERIES_TARGET_BELOW).alias("dead"),
    )


# ---------------------------------------------------------------------------
# DuckDB twins (bodies of CTEs over the pre-registered test-table views).
_EVENT_CASE = " ".join(f"when '{n}' then {c}" for n, c in EVENT_CODES)
_REF_VALUES = " union all ".join(f"select '{c}' as code, '{lab}' as label" for c, lab in MEASURE_REF_ROWS)

DUCK: dict[str, str] = {
    "movements": (
        "select cast(user_id as varchar) as id_nda, cast(event_id % 5 as int) as ids_ufr, "
        "user_id as ids_pat, ts as dt_deb_mouv_ufr, ts + interval 3 day as dt_fin_mouv_ufr "
        "from events where event_type = 'signup'"
    ),
    "icu_units": f"select r_regionkey as ids_ufr from region where r_regionkey < {ICU_UNIT_LIMIT}",
    "readings": (
        f"select user_id as id_nda, cast(case event_type {_EVENT_CASE} else {OTHER_EVENT_CODE} end as int) "
        "as id_measure_type, ts as dt_insert, value as value_numeric, "
        f"case when try_cast(json_extract_string(props, '$.k') as int) < {CANCEL_K_BELOW} then 'x' else '' end "
        "as dt_cancel from events where event_type <> 'signup'"
    ),
    "measure_ref": _REF_VALUES,
    "patients": (
        "select c_custkey as ids_pat, cast(c_nationkey * 4 as int) as age, "
        "case when c_custkey % 2 = 0 then 'F' else 'M' end as cd_sex_tr, "
        f"case when c_mktsegment = '{DEATH_SEGMENT}' then date '{DEATH_DATE}' end as dt_deces from customer"
    ),
    "forms": (
        "select l_orderkey as id_form, cast(o_custkey as varchar) as id_nda, "
        "concat('int_esc_', cast(l_linenumber as varchar)) as champ_formulaire, "
        "cast(cast(max(l_quantity) as int) as varchar) as value_field, "
        "case when o_orderstatus = 'F' then cast(o_orderdate as date) end as j1, "
        "cast(o_orderdate + interval 1 day as date) as dt_ins "
        "from lineitem join orders on l_orderkey = o_orderkey "
        "group by l_orderkey, o_custkey, l_linenumber, o_orderstatus, o_orderdate "
        "union all "
        "select l_orderkey as id_form, cast(o_custkey as varchar) as id_nda, 'int_igs2' as champ_formulaire, "
        "cast(cast(sum(l_quantity) as int) as varchar) as value_field, "
        "case when o_orderstatus = 'F' then cast(o_orderdate as date) end as j1, "
        "cast(o_orderdate + interval 1 day as date) as dt_ins "
        "from lineitem join orders on l_orderkey = o_orderkey "
        "group by l_orderkey, o_custkey, o_orderstatus, o_orderdate"
    ),
    # long form of the embedding series: (case_id, v, i, y, dead)
    "series_long": (
        f"select vec_id as case_id, cast((g.k - 1) // {SERIES_POINTS} as int) as v, "
        f"cast((g.k - 1) % {SERIES_POINTS} as int) as i, cast(embedding[g.k] as double) as y, "
        f"label < {SERIES_TARGET_BELOW} as dead "
        f"from embeddings, range(1, {SERIES_VOIS * SERIES_POINTS + 1}) as g(k)"
    ),
}


def duck_with(*names: str, extra: dict[str, str] | None = None) -> str:
    """``with`` clause defining the named stand-ins (then ``extra`` CTEs, in order)."""
    parts = [f"{n} as ({DUCK[n]})" for n in names]
    for n, body in (extra or {}).items():
        parts.append(f"{n} as ({body})")
    return "with " + ",\n".join(parts) + "\n"
