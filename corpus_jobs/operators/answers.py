"""What an answer is given and shows: context, source cards, diagnostics, groundedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import contains_any, truncate
from .retrieval import first_of, top

# Fixed values of the service.
MAX_CHARS, MARGIN, LEAST_CUT = 4000, 100, 200
RECORD_INTENTS = ["exact_identifier", "identifier_detail", "comparison"]
RECORD_TYPES = ["structured", "sih_problem_statement"]
RECORD_LABELS = [("ps_code", "PS Code"), ("track", "Track"), ("problem_statement_title", "Problem Statement Title"), ("theme", "Theme"), ("sponsoring_ministry", "Sponsoring Organization / Ministry"), ("problem_statement", "Problem Statement")]
DISCLAIMERS = ["couldn't find", "not found", "no information", "not available", "don't have", "cannot determine", "general knowledge"]


def _given(c: str) -> Column:
    """The column as text; null where it is blank or zero."""
    return F.nullif(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("0"))


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)  # null if the value is


def entry(rows: DataFrame) -> Column:
    """A row's entry in the context; rows have every metadata column that is named here."""
    source = F.concat(_labelled("Source: ", F.coalesce(_given("file_name"), _given("source_document"))), F.coalesce(_labelled(", Page ", _given("page_number")), F.lit("")))
    record = F.concat_ws("\n", *[_labelled(f"{label}: ", _given(c)) for c, label in RECORD_LABELS], source)
    record = F.concat(F.lit("--- Record "), F.col("rank").cast("string"), F.lit(" ---\n"), F.when(record == "", F.col("text")).otherwise(record))
    place = F.coalesce(_labelled(", Slide ", _given("slide_number")), _labelled(", Page ", _given("page_number")), F.lit(""))
    more = F.concat(F.coalesce(_labelled(", Sheet: ", _given("sheet_name")), F.lit("")), F.coalesce(_labelled(", Section: ", _given("section")), F.lit("")))
    head = F.concat(F.lit("--- Evidence "), F.col("rank").cast("string"), F.lit(" [Source: "), F.coalesce("file_name", F.lit("Unknown")), place, more, F.lit("] ---\n"))
    return F.when(F.col("intent").isin(RECORD_INTENTS) & F.col("record_type").isin(RECORD_TYPES), record).otherwise(F.concat(head, F.col("text")))


def context(rows: DataFrame, entry_col: Column | None = None, max_chars: int = MAX_CHARS) -> DataFrame:
    """rows(query_id, rank, text, ...) -> (query_id, context): entries in order while they fit.

    A text whose first 200 characters came before is skipped. The first entry that does not fit is cut if more than 200
    characters remain under a margin of 100, and ends the context either way.
    """
    entry_col = entry(rows) if entry_col is None else entry_col
    once = first_of(rows.withColumn("head", F.substring("text", 1, 200)), ["query_id", "head"], ["rank"])
    sized = once.select("query_id", "rank", entry_col.alias("entry"))
    before = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    sized = sized.withColumn("used", F.coalesce(F.sum(F.length("entry")).over(before), F.lit(0)))
    left = F.lit(max_chars - MARGIN) - F.col("used")
    fits = F.col("used") + F.length("entry") <= max_chars
    # lengths add up without gaps until the first entry that does not fit, so later ones are over the limit as well
    first_over = F.min(F.when(~fits, F.col("rank"))).over(W.partitionBy("query_id"))
    part = F.when(fits & (first_over.isNull() | (F.col("rank") < first_over)), F.col("entry")).when((F.col("rank") == first_over) & (left > LEAST_CUT), F.concat(F.substring(F.col("entry"), F.lit(1), left), F.lit("...")))
    parts = sized.select("query_id", "rank", part.alias("part"))
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("rank", "part")))), lambda x: x.part), "\n\n").alias("context"))


def source_cards(rows: DataFrame, k: int = 3) -> DataFrame:
    """rows(query_id, rank, document_id, chunk_id, score, text, file_name, file_type, page_number, slide_number, section)
    -> the k best documents of each question with their pages, slides, sections, best chunk (last of equal scores)."""
    pages, slides = (F.array_sort(F.collect_set(F.when(F.col(c) > 0, F.col(c)))) for c in ("page_number", "slide_number"))
    cards = rows.groupBy("query_id", "document_id").agg(
        F.min_by(F.struct("file_name", "file_type"), "rank").alias("f"),
        pages.alias("pages"),
        slides.alias("slides"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("section", F.lit("")))), ", ").alias("section"),
        F.max_by(F.struct("chunk_id", "text", "score"), F.struct("score", "rank")).alias("b"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("rank").alias("first"),
    )
    cards = cards.select("query_id", "document_id", "f.file_name", "f.file_type", F.get("pages", 0).alias("page"), "pages", F.get("slides", 0).alias("slide_number"), "slides", F.nullif("section", F.lit("")).alias("section"), "b.chunk_id", "chunk_count", "b.score", F.col("b.text").alias("snippet"), "first")
    best = top(cards, ["query_id"], [F.desc("score"), "first"], k, "card_no").drop("first")
    return best.withColumn("unique_sources", F.count(F.lit(1)).over(W.partitionBy("query_id")))


def unique_sources(sources: DataFrame, order: list) -> DataFrame:
    """The first source of each document id, or of each file name where the id is empty."""
    key = F.coalesce(F.nullif("document_id", F.lit("")), F.col("file_name"))
    return first_of(sources.withColumn("source_key", key), ["query_id", "source_key"], order).drop("source_key")


def diagnostics(plans: DataFrame, candidates: DataFrame, merged: DataFrame, reranked: DataFrame, conf: DataFrame) -> DataFrame:
    """One row per question: plan columns, rows per list, candidates, reranked rows, confidence and the top chunks."""
    per_list = candidates.groupBy("query_id").agg(F.count_if(F.col("list_no") == 4).alias("semantic_count"), F.count_if(F.col("list_no") == 3).alias("keyword_count"))
    total = merged.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_candidates"))
    chunk = F.struct("rank", "chunk_id", "score", F.col("origin").alias("source"), truncate(F.col("text"), 200).alias("snippet"))
    tops = reranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("reranked_count"), F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, chunk))).alias("top_chunks"))
    out = plans.join(per_list, "query_id", "left").join(total, "query_id", "left").join(tops, "query_id", "left").join(conf, "query_id", "left")
    return out.fillna(0, ["semantic_count", "keyword_count", "total_candidates", "reranked_count"]).fillna(0.0, ["confidence"])


def grounded(answer: Column, context_col: Column) -> Column:
    """False for an answer with more than two numbers of which over half are missing from the context. Empty inputs,
    answers under 50 characters and disclaimers pass."""
    numbers = F.regexp_extract_all(answer, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))
    missing = F.size(F.filter(numbers, lambda n: ~F.lower(context_col).contains(n)))
    n = F.size(numbers)
    skipped = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(context_col, F.lit("")) == "") | (F.length(answer) < 50) | contains_any(F.lower(answer), DISCLAIMERS)
    return skipped | ~((n > 2) & (missing > n * 0.5))
