"""Recognised words and lines of images. The recognition engines themselves are outside Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_any, strip
from .retrieval import first_of

# Fixed values of the service.
FORBIDDEN = ["ocr processing complete", "visual content", "[image:", "processing complete"]
HEADINGS = ["notes", "introduction", "purpose", "features", "tip", "summary", "heading"]
UNCLEAR_BELOW = 35


def is_forbidden(text: Column) -> Column:
    return contains_any(F.lower(text), FORBIDDEN)


def line_type(text: Column) -> Column:
    bullet = text.startswith("•") | text.startswith("-") | text.startswith("*") | text.rlike(r"^\d+[.)]")
    upper = (F.upper(text) == text) & (F.lower(text) != text)
    heading = contains_any(F.lower(text), HEADINGS) | upper | text.endswith(":")
    return F.when(bullet, "bullet").when(heading, "heading").otherwise("paragraph")


def layout_lines(ocr_words: DataFrame) -> DataFrame:
    """Words -> lines of each image with their text, type, box around all words, and mean confidence.

    Words of a confidence between 0 and 35 read [unclear]; blank and placeholder words and lines are left out.
    """
    w = ocr_words.withColumn("t", strip(F.coalesce("text", F.lit("")))).filter("t <> ''").filter(~is_forbidden(F.col("t")))
    w = w.withColumn("t", F.when((F.col("conf") > 0) & (F.col("conf") < UNCLEAR_BELOW), "[unclear]").otherwise(F.col("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "t"))), lambda x: x.t), " ")
    left, top = F.min("left"), F.min("top")
    per = w.groupBy("image_id", "block_num", "line_num").agg(
        text.alias("text"),
        F.struct(left.alias("x"), top.alias("y"), (F.max(F.col("left") + F.col("width")) - left).alias("w"), (F.max(F.col("top") + F.col("height")) - top).alias("h")).alias("bbox"),
        F.round(F.avg(F.coalesce("conf", F.lit(50.0))) / 100, 2).alias("confidence"),
    )
    per = per.filter(~is_forbidden(F.col("text")))
    n = F.row_number().over(W.partitionBy("image_id").orderBy("block_num", "line_num")) - 1
    return per.select("image_id", F.concat(F.lit("b"), n.cast("string")).alias("block_id"), "block_num", F.col("line_num").alias("line_number"), "text", line_type(F.col("text")).alias("type"), "bbox", "confidence")


def structured_text(layout: DataFrame) -> DataFrame:
    """(image_id, structured_ocr): headings with marks, bullets, and paragraphs, in the order of the blocks."""
    t = F.col("text")
    part = F.when(F.col("type") == "heading", F.concat(F.lit("\n### "), t, F.lit("\n"))).when(F.col("type") == "bullet", F.concat(F.lit("  • "), F.regexp_replace(t, r"^[•\-* ]+", ""))).otherwise(t)
    rows = layout.select("image_id", F.struct("block_num", "line_number", part.alias("part")).alias("x"))
    return rows.groupBy("image_id").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.part), "\n")).alias("structured_ocr"))


def merged_lines(engines: DataFrame, key: str = "image_id") -> DataFrame:
    """engines(image_id, engine_no, text) -> (image_id, raw_ocr, ocr_confidence): the engines' lines in order, the first
    of those that agree but for case and blanks; lines of one or two characters and placeholders are left out."""
    rows = engines.select(key, "engine_no", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", strip(F.col("line")))
    rows = rows.filter((F.length("line") > 2) & ~is_forbidden(F.col("line")))
    rows = first_of(rows.withColumn("fold", F.regexp_replace(F.lower("line"), r"(?U)\s+", " ")), [key, "fold"], ["engine_no", "n"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("engine_no", "n", "line"))), lambda x: x.line), "\n")
    out = rows.groupBy(key).agg(text.alias("raw_ocr"))
    n = F.length("raw_ocr")
    return out.withColumn("ocr_confidence", F.when(n > 100, "high").when(n > 30, "medium").otherwise("low"))


