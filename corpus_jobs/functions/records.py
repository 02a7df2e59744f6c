"""Structured records inside page texts: one per coded identifier, with the fields that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import strip

# Labels in pages, tried in order, and where a value ends.
CODE = r"\b[Ss][Ii][Hh]\s*[-_]?\s*\d{4,6}\b"
LABELS = {
    "track": ["track", "category", "domain"],
    "problem_statement_title": ["title", "problem title", "statement title", "name"],
    "theme": ["theme", "sub-theme", "area"],
    "sponsoring_ministry": ["sponsoring ministry", "organization", "sponsor", "ministry", "funded by"],
}
VALUE_END = r"(?=\n|\||\b(?:Track|Theme|Title|Sponsor|Ministry|PS Code|Category|Description|Problem Statement)[:|]|$)"
STATEMENT_LABELS = ["problem statement", "description", "details"]
STATEMENT = r"(?isU)\b(?:problem statement|description|details)\s*[:|]\s*(.+)"
CHUNK_LABELS = [("PS CODE", "ps_code"), ("TITLE", "problem_statement_title"), ("TRACK", "track"), ("THEME", "theme"), ("SPONSOR", "sponsoring_ministry"), ("PROBLEM STATEMENT", "problem_statement")]


def folded(text: Column) -> Column:
    """Text in which a plain search finds what the case-blind patterns may: with the letters that fold to s, i and k."""
    return F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik"))


def field_value(text: Column, labels: list[str], plain: Column | None = None) -> Column:
    """The value after the first label that has one; empty if none has. A label's pattern is tried only where the text,
    folded once for all labels (`plain`), holds it."""
    found, plain = [], folded(text) if plain is None else plain
    for label in labels:
        value = F.when(plain.contains(label), F.regexp_extract(text, rf"(?isU)\b{label}\s*[:|]\s*(.+?){VALUE_END}", 1)).otherwise(F.lit(""))
        found.append(strip(F.substring_index(F.substring_index(strip(value), "|", 1), "\n", 1)))
    # an array, so that each value is worked out once
    return F.coalesce(F.get(F.filter(F.array(*found), lambda v: v != ""), F.lit(0)), F.lit(""))


def problem_text(block: Column, plain: Column | None = None) -> Column:
    """What follows the statement's label, else the first 1000 characters."""
    plain = folded(block) if plain is None else plain
    some = plain.contains(STATEMENT_LABELS[0])
    for label in STATEMENT_LABELS[1:]:
        some = some | plain.contains(label)
    return F.when(some & block.rlike(STATEMENT), strip(F.regexp_extract(block, STATEMENT, 1))).otherwise(F.substring(block, 1, 1000))


def extract(pages: DataFrame) -> DataFrame:
    """pages(document_id, file_name, page_number, text) -> one row per code occurrence, last one per id.

    A text is split before every code; a piece that begins with one is its record's block.
    """
    # blocks are made before the rows are, so that no later expression repeats the work
    made = F.transform(F.filter(F.split("text", f"(?={CODE})"), lambda p: p.rlike(f"^{CODE}")), strip)
    both = F.transform(made, lambda b: F.struct(b.alias("block"), folded(b).alias("plain")))
    blocks = pages.select("document_id", F.col("file_name").alias("source_document"), "page_number", F.posexplode(both).alias("n", "b")).select("*", "b.*").drop("b")
    code = F.concat(F.lit("SIH"), F.regexp_replace(F.regexp_extract("block", f"^{CODE}", 0), r"\D", ""))
    rows = blocks.select(
        F.concat_ws("_", "document_id", code, F.col("page_number").cast("string")).alias("id"),
        "document_id",
        F.lit("sih_problem_statement").alias("record_type"),
        code.alias("identifier"),
        code.alias("ps_code"),
        *[field_value(F.col("block"), labels, F.col("plain")).alias(name) for name, labels in LABELS.items()],
        problem_text(F.col("block"), F.col("plain")).alias("problem_statement"),
        "source_document",
        "page_number",
        F.substring("block", 1, 1500).alias("raw_text"),
        "n",
    )
    last = W.partitionBy("id").orderBy(F.desc("n"))
    return rows.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r", "n")


def record_chunks(records: DataFrame) -> DataFrame:
    """A chunk of labelled lines for each record; the record's id is the chunk's."""
    text = F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(""))) for label, c in CHUNK_LABELS])
    return records.select(F.col("id").alias("chunk_id"), "document_id", text.alias("text"), F.lit("").alias("file_name"), "page_number", "identifier", "ps_code", F.lit("structured").alias("record_type"))
