"""Overlapping chunks of section texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..storage import materialize

SIZE, OVERLAP = 800, 120
#: Characters from which a section is dealt in parts, and of a part.
PART = 1 << 20


def _packed(parts: Iterator[str], glue: str, size: int, overlap: int) -> Iterator[str]:
    """Joins parts while they fit; a new chunk begins with the end of the one before it."""
    held = ""
    for part in parts:
        longer = f"{held}{glue}{part}" if held else part
        if held and len(longer) > size:
            yield held
            tail = held[-overlap:].strip() if overlap > 0 else ""
            held = f"{tail}{glue}{part}" if tail else part
        else:
            held = longer
    if held:
        yield held


def _stripped(parts: list[str]) -> Iterator[str]:
    return (p for p in map(str.strip, parts) if p)


def sentences(text: str, size: int, overlap: int) -> Iterator[str]:
    """Chunks of a long paragraph; one that is still over twice the size becomes windows."""
    for chunk in _packed(_stripped(re.split(r"(?<=\.) |\n", text)), " ", size, overlap):
        if len(chunk) > 2 * size:
            yield from (chunk[i : i + size] for i in range(0, len(chunk), size - overlap))
        else:
            yield chunk


def chunk(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Paragraphs packed to `size` characters. A paragraph longer than that ends the chunk before it, is cut by
    sentences, and hands no overlap on."""
    out: list[str] = []
    short: list[str] = []
    for para in _stripped((text or "").split("\n\n")):
        if len(para) <= size:
            short.append(para)
            continue
        out += _packed(iter(short), "\n\n", size, overlap)
        short = []
        out += sentences(para, size, overlap)
    out += _packed(iter(short), "\n\n", size, overlap)
    return out


def chunks_of(size: int = SIZE, overlap: int = OVERLAP):
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than a chunk")

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def of(text: pa.Array) -> pa.Array:
        return pa.array([chunk(t, size, overlap) for t in text.to_pylist()], type=pa.list_(pa.string()))

    return of


def chunk_sections(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """sections(document_id, section_index, text, ...) -> a row per chunk with chunk_id, chunk_index and the other
    columns; a narrow step. chunk_index starts at 0 in every section, chunk_id names document, section and chunk."""
    rest = [c for c in sections.columns if c not in ("document_id", "section_index", "text")]
    rows = sections.select("document_id", "section_index", *rest, F.posexplode(chunks_of(size, overlap)("text")).alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", F.concat_ws("_", "document_id", F.col("section_index").cast("string"), F.col("chunk_index").cast("string")))


def parts(text: str | None, part: int, size: int = SIZE) -> list[str]:
    """A text in parts of at least `part` characters, cut behind paragraphs longer than `size`. Nothing is handed on there, so
    the chunks of the parts, one after the other, are those of the text."""
    out, held, n = [], [], 0
    for para in (text or "").split("\n\n"):
        held.append(para)
        n += len(para) + 2
        if n >= part and len(para.strip()) > size:
            out.append("\n\n".join(held))
            held, n = [], 0
    return out + ["\n\n".join(held)] if held else out


def chunk_long_sections(sections: DataFrame, size: int = SIZE, overlap: int = OVERLAP, part: int = PART) -> DataFrame:
    """chunk_sections for tables in which some sections are very long: those are dealt over tasks in parts, and numbered by the
    counts of the parts before. Only keys, part and chunks of long sections are shuffled; a section without a paragraph
    longer than `size` is one part."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def of(text: pa.Array) -> pa.Array:
        return pa.array([parts(t.as_py(), part, size) for t in text], type=pa.list_(pa.string()))

    keys = ["document_id", "section_index"]
    short = chunk_sections(sections.filter(F.coalesce(F.length("text"), F.lit(0)) <= part), size, overlap)
    long = sections.filter(F.length("text") > part)
    dealt = long.select(*keys, F.posexplode(of("text")).alias("part", "t")).repartition(*keys, "part")
    done = materialize(dealt.select(*keys, "part", chunks_of(size, overlap)("t").alias("c")), "parts")
    before = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = done.select(*keys, "part", F.coalesce(F.sum(F.size("c")).over(before), F.lit(0)).cast("int").alias("base"))  # a row for each part
    rows = done.join(base, [*keys, "part"]).select(*keys, "base", F.posexplode("c").alias("i", "text"))
    rest = [c for c in sections.columns if c not in (*keys, "text")]
    rows = rows.select(*keys, (F.col("base") + F.col("i")).alias("chunk_index"), "text").join(long.select(*keys, *rest), keys)
    rows = rows.withColumn("chunk_id", F.concat_ws("_", "document_id", F.col("section_index").cast("string"), F.col("chunk_index").cast("string")))
    return short.unionByName(rows.select(short.columns))


def simple_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata columns without nulls and nesting: text and nested values become text, null becomes empty text."""
    kinds = dict(df.dtypes)
    out = {}
    for c in columns:
        if kinds[c].startswith(("struct", "array", "map")):
            out[c] = F.coalesce(F.to_json(F.col(c)), F.lit(""))
        elif kinds[c] == "string":
            out[c] = F.coalesce(F.col(c), F.lit(""))
        else:
            out[c] = F.col(c)
    return df.withColumns(out)


def merged_metadata(file_meta: dict[str, str], section_columns: list[str]) -> dict:
    """Columns of file metadata overridden by the section's own where it has them."""
    return {k: F.coalesce(F.col(k), F.col(v)) if k in section_columns else F.col(v) for k, v in file_meta.items()}
