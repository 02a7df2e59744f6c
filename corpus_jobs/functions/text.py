"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blank at either end in any script, which trim() alone would leave.
_ENDS = r"(?U)^\s+|\s+$"


def _normalizer(form: str):
    @F.arrow_udf(T.StringType())
    def normalize(text: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize(form, t) for t in text.to_pylist()], type=pa.string())

    return normalize


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def clean_text(c: Column) -> Column:
    """Compatibility-composed text without control characters, with line feeds only, single spaces and no more than one
    empty line in a row. Spark has no Unicode normalisation, so only that step leaves the JVM."""
    c = F.regexp_replace(_normalizer("NFKC")(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, " {2,}", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def truncate(c: Column, n: int = 2000) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def text_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def safe_filename(c: Column) -> Column:
    """A name without folders and unsafe characters; unnamed_file if nothing is left."""
    name = F.substring_index(_normalizer("NFKD")(c), "/", -1)
    name = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    name = F.regexp_replace(name, r"^[. ]+|[. ]+$", "")
    return F.when(name == "", F.lit("unnamed_file")).otherwise(name)


def canonical_id(c: Column) -> Column:
    """An identifier in upper case without blanks, hyphens and underscores."""
    return F.upper(F.regexp_replace(c, r"(?U)[\s\-_]", ""))


def squeezed(c: Column) -> Column:
    """Text in upper case without spaces, hyphens and underscores, in which canonical identifiers are looked for."""
    return F.upper(F.translate(c, " -_", ""))


def clean_answer(c: Column) -> Column:
    """An answer without evidence marks and source tags."""
    c = F.regexp_replace(c, r"(?U)\([E|e]vidence\s+\d+:[^)]+\)", "")
    c = F.regexp_replace(c, r"\[Source:[^\]]+\]", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def count_contained(c: Column, words: list[str]) -> Column:
    """How many of the words occur in c."""
    total = F.lit(0)
    for w in words:
        total = total + c.contains(w).cast("int")
    return total


def extension(name: Column) -> Column:
    """The last suffix of a file name in lower case with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]+)$", 1))
