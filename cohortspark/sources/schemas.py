"""Explicit schemas at table boundaries (see FIXTURES.md §1)."""

from __future__ import annotations

from pyspark.sql import types as T

NTZ = T.TimestampNTZType()

READINGS_SCHEMA = T.StructType(
    [
        T.StructField("id_nda", T.LongType()),
        T.StructField("id_measure_type", T.IntegerType()),
        T.StructField("dt_insert", NTZ),
        T.StructField("value_numeric", T.DoubleType()),
        T.StructField("dt_cancel", T.StringType()),
    ]
)

MOVEMENTS_SCHEMA = T.StructType(
    [
        T.StructField("id_nda", T.StringType()),
        T.StructField("ids_ufr", T.IntegerType()),
        T.StructField("ids_pat", T.LongType()),
        T.StructField("dt_deb_mouv_ufr", NTZ),
        T.StructField("dt_fin_mouv_ufr", NTZ),
    ]
)

UNITS_SCHEMA = T.StructType([T.StructField("ids_ufr", T.IntegerType())])

MEASURE_REF_SCHEMA = T.StructType(
    [T.StructField("code", T.StringType()), T.StructField("label", T.StringType())]
)

PATIENTS_SCHEMA = T.StructType(
    [
        T.StructField("ids_pat", T.LongType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("cd_sex_tr", T.StringType()),
        T.StructField("dt_deces", T.DateType()),
    ]
)

FORMS_SCHEMA = T.StructType(
    [
        T.StructField("id_form", T.LongType()),
        T.StructField("id_nda", T.StringType()),
        T.StructField("champ_formulaire", T.StringType()),
        T.StructField("value_field", T.StringType()),
        T.StructField("j1", T.DateType()),
        T.StructField("dt_ins", T.DateType()),
    ]
)

CATEGORIES_SCHEMA = T.StructType(
    [
        T.StructField("PARENT", T.StringType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("saps2weight", T.StringType()),
    ]
)

# Staged readings: entry date of the movement + the reading (stay id as text).
STAGED_SCHEMA = T.StructType(
    [
        T.StructField("dt_deb", T.DateType()),
        T.StructField("id_nda", T.StringType()),
        T.StructField("id_measure_type", T.IntegerType()),
        T.StructField("dt_insert", NTZ),
        T.StructField("value_numeric", T.DoubleType()),
        T.StructField("dt_cancel", T.StringType()),
    ]
)

# Packed wave dataset: one row per case.
DATASET_SCHEMA = T.StructType(
    [
        T.StructField("id_nda", T.StringType()),
        T.StructField("j1", T.DateType()),
        T.StructField("series", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("dead", T.BooleanType()),
    ]
)
