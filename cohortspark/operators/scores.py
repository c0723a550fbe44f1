"""Severity-score forms: form matrix, patient map, score, label encoding.

M10–M12, J12–J14, P3, P6, P19, F7–F10, F13, F17.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortspark.operators.ordering import positions
from cohortspark.session import materialise

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for right results).
# Severity score → death probability: logit = A + B*s + C*ln(s + 1).
SCORE_A = -7.7631
SCORE_B = 0.0737
SCORE_C = 0.9971
SCORE_THRESHOLD = 0.5
# Form fields selected: a name prefix (LIKE pattern) and exact names.
FIELD_PATTERN = "int_esc%"
CHRONIC_FIELD = "int_maladies_chronique"
SCORE_FIELD = "int_igs2"
# The 15 form fields and their catalogue names, in this order.
FORM_FIELD_CATALOGUE = (
    ("int_esc_admission", "TYPEADMISSION"),
    ("int_esc_age", "AGE"),
    ("int_esc_bicarbonate", "BICARBONATEMIE"),
    ("int_esc_bilirubine", "BILIRUBINE"),
    ("int_esc_diurese", "DIURESE"),
    ("int_esc_frequence", "FREQUENCECARDIAQUE"),
    ("int_esc_glasgow", "GLASGOW"),
    ("int_esc_globules", "GLOBULESBLANCS"),
    ("int_esc_kaliemie", "KALIEMIE"),
    ("int_esc_natremie", "NATREMIE"),
    ("int_esc_pao2", "PAO2/FIO2"),
    ("int_esc_pression", "PRESSIONARTERIELLE"),
    ("int_esc_temperature", "TEMPERATURE"),
    ("int_esc_uree", "UREE"),
    ("int_maladies_chronique", "MALADIESCHRONIQUES"),
)
# Length of the date part plus the separator at the end of a form case key.
DATE_SUFFIX_LEN = 10
# ---------------------------------------------------------------------------


def field_condition(with_score: bool) -> Column:
    """Prefix pattern (``_`` is a one-character wildcard) or exact field names."""
    f = F.col("champ_formulaire")
    names = [CHRONIC_FIELD, SCORE_FIELD] if with_score else [CHRONIC_FIELD]
    return f.like(FIELD_PATTERN) | f.isin(names)


def form_values(forms: DataFrame) -> DataFrame:
    """Selected field rows with their value as text."""
    return forms.where(field_condition(True)).select(
        "id_form", "id_nda", "champ_formulaire", F.col("value_field").cast("string").alias("value_field"), "j1"
    )


def form_dates(forms: DataFrame) -> DataFrame:
    """distinct (form, stay, dates); the effective date is j1 when present, else dt_ins."""
    d = forms.where(field_condition(False)).select("id_form", "id_nda", "dt_ins", "j1").distinct()
    return d.select("id_form", "id_nda", F.coalesce("j1", "dt_ins").alias("dt_ins"))


def form_key(id_nda: Column, date: Column, id_form: Column) -> Column:
    """Form case key: stay id, date as yyyy-MM-dd, '_', form id."""
    return F.concat(id_nda, F.date_format(date, "yyyy-MM-dd"), F.lit("_"), id_form.cast("string"))


def form_rows(forms: DataFrame) -> DataFrame:
    """Field rows with the form's effective date ``dt_eff`` (merge on form id only, as the reference).

    Store the result where both its long form and its matrix are needed.
    """
    d = form_dates(forms).select("id_form", F.col("dt_ins").alias("dt_eff"))
    return form_values(forms).join(d, "id_form").select("id_form", "id_nda", "dt_eff", "champ_formulaire", "value_field")


def form_long(
    forms: DataFrame | None, rows: DataFrame | None = None, matrix: DataFrame | None = None, fields: Sequence[str] = ()
) -> DataFrame:
    """Field rows keyed by ``id_form_ndaj1``.

    Where the strict matrix of the forms is stored, its texts of ``fields`` are
    the same rows (a strict matrix holds one row a field and form, but no nulls).
    """
    if matrix is not None:
        texts = F.array(*[F.struct(F.lit(f).alias("champ_formulaire"), F.col(f"`{f}`").alias("value_field")) for f in fields])
        return matrix.select("id_form_ndaj1", F.explode(texts).alias("_t")).select("id_form_ndaj1", "_t.*").where("value_field is not null")
    j = form_rows(forms) if rows is None else rows
    return j.select(
        form_key(F.col("id_nda"), F.col("dt_eff"), F.col("id_form")).alias("id_form_ndaj1"),
        "champ_formulaire",
        "value_field",
    )


def form_duplicates(long: DataFrame) -> DataFrame:
    """A13 check: (key, field) pairs holding more than one value (a pivot would be ambiguous)."""
    return long.groupBy("id_form_ndaj1", "champ_formulaire").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def case_prefix(key: str | Column = "id_form_ndaj1") -> Column:
    """greedy prefix before the last '_' (case key of a form key)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.regexp_extract(k, r"(.*)_.*", 1)


def form_matrix(forms: DataFrame, fields: Sequence[str], strict: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """M12 + A13: one row per form key, one text column per field (explicit list), plus id_ndaj1.

    A field with more than one row in a form makes the pivot ambiguous
    (``form_duplicates`` reports them all): with ``strict`` it raises when such
    a form is computed, otherwise the largest text is taken.

    The key is a one-to-one function of (form id, stay id, effective date): the
    numeric form id follows the last '_' and the date has a fixed width. So the
    pivot groups by those columns, which keeps the join's partitioning on the
    form id (no second shuffle), and the text key is built once per form.
    (A null stay id or date gives a null key per form, where a grouping on the
    text key would merge such forms.)
    """
    j = form_rows(forms) if rows is None else rows
    is_field = lambda f: F.col("champ_formulaire") == F.lit(f)
    aggs = [F.max(F.when(is_field(f), F.col("value_field"))).alias(f) for f in fields]
    counts = [F.count(F.when(is_field(f), F.lit(1))).alias(f"_n_{k}") for k, f in enumerate(fields)] if strict else []
    m = j.groupBy("id_form", "id_nda", "dt_eff").agg(*aggs, *counts)
    key = form_key(F.col("id_nda"), F.col("dt_eff"), F.col("id_form"))

    def single(k: int, f: str) -> Column:
        twice = F.raise_error(F.concat(F.lit(f"field {f} has several rows in form "), F.col("id_form").cast("string")))
        return F.when(F.col(f"_n_{k}") > 1, twice.cast("string")).otherwise(F.col(f)).alias(f) if strict else F.col(f)

    m = m.select(key.alias("id_form_ndaj1"), *[single(k, f) for k, f in enumerate(fields)])
    return m.select("id_form_ndaj1", *fields, case_prefix().alias("id_ndaj1"))


def stay_of_case_key(key: str | Column = "id_ndaj1") -> Column:
    """F8: stay id = case key without its trailing date (last 10 characters)."""
    k = F.col(key) if isinstance(key, str) else key
    return k.substr(F.lit(1), F.char_length(k) - F.lit(DATE_SUFFIX_LEN))


def patient_map(matrix: DataFrame, movements: DataFrame) -> DataFrame:
    """Distinct (case key, patient) where the stay id equals the case key minus its date.

    The expression key is computed once as a column, so the join is a plain equi-join.
    """
    keys = matrix.select("id_ndaj1").distinct().withColumn("_stay", stay_of_case_key("id_ndaj1"))
    mv = movements.select(F.col("id_nda").cast("string").alias("_stay"), "ids_pat")
    return keys.join(mv, "_stay").select("id_ndaj1", "ids_pat").distinct()


def with_death(matrix: DataFrame, pmap: DataFrame, patients: DataFrame) -> DataFrame:
    """Death date of each case through the case → patient map (inner joins)."""
    deaths = pmap.join(patients.select("ids_pat", "dt_deces"), "ids_pat").select("id_ndaj1", "dt_deces")
    return matrix.join(deaths, "id_ndaj1")


def severity_columns(score_col: str = SCORE_FIELD) -> tuple[Column, Column]:
    """M11 (F17): logit and probability of death from the total score."""
    s = F.col(score_col).cast("double")
    logit = F.lit(SCORE_A) + F.lit(SCORE_B) * s + F.lit(SCORE_C) * F.ln(s + F.lit(1.0))
    pr = F.exp(logit) / (F.lit(1.0) + F.exp(logit))
    return logit, pr


def severity_score(df: DataFrame, score_col: str = SCORE_FIELD) -> DataFrame:
    """M11 + P19 + T14: add logit, pr, y_pred (pr > 0.5) and y_true (death date present)."""
    logit, pr = severity_columns(score_col)
    return (
        df.withColumn("logit", logit)
        .withColumn("pr", pr)
        .withColumn("y_pred", F.col("pr") > F.lit(SCORE_THRESHOLD))
        .withColumn("y_true", F.col("dt_deces").isNotNull())
    )


def rename_fields(df: DataFrame, mapping: Sequence[tuple[str, str]] = FORM_FIELD_CATALOGUE) -> DataFrame:
    """Rename form fields to catalogue names (fields absent from ``df`` are skipped)."""
    present = {a: b for a, b in mapping if a in df.columns}
    return df.withColumnsRenamed(present)


def sorted_catalogue(catalogue: DataFrame) -> DataFrame:
    """The category catalogue ordered by parent field, then index (output order only)."""
    return catalogue.orderBy("PARENT", "index")


def catalogue_codes(catalogue: DataFrame) -> DataFrame:
    """Code of each category = rank in the sorted distinct texts of its parent − 1."""
    cats = _categories(catalogue).distinct()
    # position among the distinct texts of the parent = dense rank − 1, without one task per parent
    ranked = positions(cats, ["label"], ["PARENT"])
    return ranked.select("PARENT", "label", F.col("pos").cast("int").alias("code"))


def _categories(catalogue: DataFrame) -> DataFrame:
    """(PARENT, label); a null text is no category."""
    return catalogue.select(F.col("PARENT"), F.col("saps2weight").cast("string").alias("label")).where("PARENT is not null and label is not null")


MAP_CATEGORIES = 20_000  # distinct (parent, text) up to which the catalogue is a map in the row


def _code_maps(catalogue: DataFrame) -> Column | None:
    """Parent → text → code as one value, or None for a catalogue of more than ``MAP_CATEGORIES``.

    The value is a scalar subquery: it is computed once and is a literal in every task.
    """
    cats = materialise(_categories(catalogue).distinct(), "catalogue")
    if cats.count() > MAP_CATEGORIES:
        return None
    texts = cats.groupBy("PARENT").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    codes = F.map_from_arrays("labels", F.sequence(F.lit(0), F.size("labels") - 1))
    return texts.agg(F.map_from_entries(F.collect_list(F.struct("PARENT", codes.alias("codes")))).alias("maps")).scalar()


def label_encode(
    matrix: DataFrame, key: str, fields: Sequence[str], catalogue: DataFrame, unseen: str = "null", report: Observation | None = None
) -> DataFrame:
    """Replace each field's text by its catalogue code.

    A text that its parent's catalogue does not hold is ``null`` or, with
    ``unseen="error"``, raises in the task that meets it. ``report`` is filled,
    by the action that computes the result, with the number of such texts of
    each field (``observe``: no pass of its own).

    The catalogue becomes a map in the row, so nothing is shuffled; one too
    large for that is joined field by field, in a long form.
    """
    if unseen not in ("null", "error"):
        raise ValueError(f"unseen must be 'null' or 'error', not {unseen!r}")
    maps = _code_maps(catalogue)
    text = lambda f: F.col(f"`{f}`").cast("string")
    if maps is None:
        coded = _joined_codes(matrix, key, fields, catalogue)
    else:
        code = lambda f: F.try_element_at(F.try_element_at(maps, F.lit(f)), text(f))
        coded = matrix.select(key, *[F.struct(text(f).alias("label"), code(f).alias("code")).alias(f) for f in fields])
    missing = lambda f: F.col(f"`{f}`.label").isNotNull() & F.col(f"`{f}`.code").isNull()
    if report is not None:
        coded = coded.observe(report, *[F.count_if(missing(f)).alias(f) for f in fields])

    def out(f: str) -> Column:
        if unseen == "null":
            return F.col(f"`{f}`.code").alias(f)
        said = F.raise_error(F.concat(F.lit(f"field {f}: the catalogue has no "), F.col(f"`{f}`.label")))
        return F.when(missing(f), said.cast("int")).otherwise(F.col(f"`{f}`.code")).alias(f)

    return coded.select(key, *[out(f) for f in fields])


def _joined_codes(matrix: DataFrame, key: str, fields: Sequence[str], catalogue: DataFrame) -> DataFrame:
    """(label, code) of each field by a join with the catalogue: for one that is too large for a map."""
    pairs = F.array(*[F.struct(F.lit(f).alias("PARENT"), F.col(f"`{f}`").cast("string").alias("label")) for f in fields])
    long = matrix.select(key, F.explode(pairs).alias("kv")).select(key, "kv.PARENT", "kv.label")
    coded = long.join(catalogue_codes(catalogue), ["PARENT", "label"], "left")
    aggs = [F.max(F.when(F.col("PARENT") == F.lit(f), F.struct("label", "code"))).alias(f) for f in fields]
    return coded.groupBy(key).agg(*aggs)


def unseen_texts(matrix: DataFrame, fields: Sequence[str], catalogue: DataFrame) -> DataFrame:
    """M10 report: (PARENT, label, n) of the texts that the catalogue does not hold."""
    pairs = F.array(*[F.struct(F.lit(f).alias("PARENT"), F.col(f"`{f}`").cast("string").alias("label")) for f in fields])
    texts = matrix.select(F.explode(pairs).alias("kv")).select("kv.PARENT", "kv.label").where("label is not null")
    counts = texts.groupBy("PARENT", "label").agg(F.count(F.lit(1)).alias("n"))  # few: partial counts in each task
    return counts.join(_categories(catalogue), ["PARENT", "label"], "left_anti")


def catalogue_from_values(long: DataFrame) -> DataFrame:
    """A catalogue (PARENT, index, saps2weight) from the values observed per field."""
    cats = long.select(F.col("champ_formulaire").alias("PARENT"), F.col("value_field").alias("saps2weight")).distinct()
    return cats.select("PARENT", F.lit(None).cast("int").alias("index"), "saps2weight")
