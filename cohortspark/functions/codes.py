"""Variables of interest (VOI) and the device measure codes that feed them.

A VOI groups several measure codes (a heart rate may come from the bedside
monitor or from a two-hourly chart). Everything downstream is keyed by the
measure code; this module turns a VOI list into codes, labels and small
constant DataFrames that are safe to broadcast (their size is fixed here).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's dictionary for right results).
# VOI code, label, measure codes, in this order.
VOI_DICTIONARY: tuple[tuple[str, str, tuple[int, ...]], ...] = (
    ("HR", "Heart rate", (10102, 10280)),
    ("RR", "Respiration rate", (10120, 10285)),
    ("ABPS", "Systolic arterial blood pressure", (11, 10281, 14)),
    ("ABPD", "Diastolic arterial blood pressure", (12, 10283, 15)),
    ("SPO2", "Blood oxygen saturation", (10168, 10291)),
    ("BT", "Body temperature", (4,)),
)
# The usual VOI list, and the VOI exempt from presence / count / bound rules.
DEFAULT_VOIS: tuple[str, ...] = ("HR", "RR", "ABPS", "ABPD", "SPO2")
EXEMPT_VOI = "BT"
# Older exploration code list (heart rate, respiration rate, two blood pressure pairs).
EXPLORATION_CODES: tuple[int, ...] = (10102, 10120, 11, 12, 14, 15)
# ---------------------------------------------------------------------------

_BY_CODE = {code: (label, codes) for code, label, codes in VOI_DICTIONARY}

DICTIONARY_SCHEMA = T.StructType(
    [
        T.StructField("code", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("measure_codes", T.ArrayType(T.IntegerType(), False), False),
    ]
)

ROUTING_SCHEMA = T.StructType(
    [
        T.StructField("voi", T.StringType(), False),
        T.StructField("voi_idx", T.IntegerType(), False),
        T.StructField("id_measure_type", T.IntegerType(), False),
    ]
)


def _check(vois: Iterable[str]) -> list[str]:
    out = list(vois)
    unknown = [v for v in out if v not in _BY_CODE]
    if unknown:
        raise KeyError(f"unknown VOI code(s): {unknown}")
    return out


def voi_codes(vois: Iterable[str]) -> list[int]:
    """Sorted union of the measure codes of the given VOIs."""
    codes: set[int] = set()
    for v in _check(vois):
        codes.update(_BY_CODE[v][1])
    return sorted(codes)


def codes_of(voi: str) -> list[int]:
    """Measure codes of one VOI, in dictionary order."""
    return list(_BY_CODE[_check([voi])[0]][1])


def voi_label(voi: str) -> str:
    return _BY_CODE[_check([voi])[0]][0]


def bounded_vois(vois: Iterable[str]) -> list[str]:
    """VOIs that take part in presence, count and bound rules (all but BT)."""
    return [v for v in _check(vois) if v != EXEMPT_VOI]


def codes_in_list_text(codes: Sequence[int]) -> str:
    """Render codes as an SQL in-list, e.g. ``(11,12,14)`` (P5)."""
    return "(" + ",".join(str(int(c)) for c in codes) + ")"


def dictionary_frame(spark: SparkSession) -> DataFrame:
    """The VOI dictionary as a DataFrame (code, label, measure_codes)."""
    rows = [(c, label, list(codes)) for c, label, codes in VOI_DICTIONARY]
    return spark.createDataFrame(rows, DICTIONARY_SCHEMA)


def routing_frame(spark: SparkSession, vois: Sequence[str]) -> DataFrame:
    """code → VOI routing (J15): one row per (voi, measure code).

    ``voi_idx`` is the position of the VOI in ``vois``; it fixes the row order
    of packed matrices. The frame has at most a few dozen rows, so callers
    broadcast it.
    """
    rows = [(v, i, int(c)) for i, v in enumerate(_check(vois)) for c in _BY_CODE[v][1]]
    return spark.createDataFrame(rows, ROUTING_SCHEMA)
