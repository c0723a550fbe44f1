"""Scalar column functions of the reference's queries.

Most map one-to-one onto Spark built-ins; these wrappers fix the null and
no-match rules the reference relies on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_case_key(key: str | Column, id_digits: int | None = 7) -> list[Column]:
    """split a text case key (stay id + yyyy-MM-dd) into ``id_nda`` and ``j1`` text.

    ``id_digits=7`` demands a 7-digit stay id as the reference does; ``None``
    accepts any number of digits. No match gives null (not the empty text).
    """
    digits = "[0-9]+" if id_digits is None else f"[0-9]{{{int(id_digits)}}}"
    pattern = f"^({digits})([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})$"
    k = _c(key)
    return [
        F.nullif(F.regexp_extract(k, pattern, 1), F.lit("")).alias("id_nda"),
        F.nullif(F.regexp_extract(k, pattern, 2), F.lit("")).alias("j1"),
    ]


def decode_latin1(x: str | Column) -> Column:
    """text stored as Latin-1 bytes → proper text."""
    return F.decode(_c(x).cast("binary"), "ISO-8859-1")


def decode_latin1_bytes(x: str | Column) -> Column:
    """F12 for binary columns."""
    return F.decode(_c(x), "ISO-8859-1")


def as_text(x: str | Column) -> Column:
    """value → text for export (typed columns are kept inside the plans)."""
    return _c(x).cast("string")


def parse_timestamp(x: str | Column, fmt: str | None = None) -> Column:
    """text → timestamp without time zone."""
    return F.to_timestamp_ntz(_c(x), F.lit(fmt)) if fmt else F.to_timestamp_ntz(_c(x))


def in_list_text_to_codes(text: str) -> list[int]:
    """Parse an SQL in-list text such as ``(11,12,14)`` back to codes."""
    inner = text.strip().removeprefix("(").removesuffix(")")
    return [int(t) for t in inner.split(",") if t.strip()]


def seeded(key: Column, seed: int) -> Column:
    """A pseudo-random text for ``key``: the md5 of key and seed, equal in every engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))
