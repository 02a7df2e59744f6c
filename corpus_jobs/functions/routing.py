"""What a question asks for: identifiers, page, fields, follow-up, intent; and its conversation's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..ranges import with_rows_before
from .text import contains_any, strip

# Patterns, words and intent names that the service recognises.
CODED_ID = r"\b[Ss][Ii][Hh]\s*[-_]?\s*(\d{4,6})\b"
GENERIC_ID = r"\b([A-Za-z]{2,8}[-_]?\d{3,8}(?:[-_]\d{1,6})?)\b"
BARE_NUMBER = r"\b(\d{5,6})\b"
PAGE_CARDINAL = r"(?i)\b(?:page|p\.?)\s*(\d+)\b"
PAGE_ORDINAL = r"(?i)\b(\d+)(?:st|nd|rd|th)\s*page\b"
FOLLOW_UP_WORDS = ["it", "its", "this", "that", "the same", "above", "previous"]
FOLLOW_UP_STARTS = ["what is its", "who sponsors it", "what is the theme", "what track", "give me the"]
FIELD_WORDS = {
    "title": ["title", "name of", "called"],
    "track": ["track", "category"],
    "theme": ["theme", "domain", "area"],
    "sponsor": ["sponsor", "sponsors", "sponsoring", "ministry", "organization", "organisation", "funded by", "who sponsors"],
    "problem_statement": ["problem statement", "full problem", "describe the problem", "detailed problem", "complete problem", "give me the problem"],
}
LIST_WORDS = ["list all", "show all", "how many", "count", "all problems", "all records", "all entries"]
SUMMARY_WORDS = ["summarize", "summary", "summarise", "main points", "overview", "what is this document about"]
COMPARISON_WORDS = ["compare", "difference between", "versus", "vs"]
IMAGE_WORDS = [
    "image", "handwritten", "notes", "report writing", "report", "purpose of report", "features of a good report",
    "useful tip", "picture", "photo", "diagram", "my notes", "this image", "uploaded image", "this document", "what is a report",
]
QUESTION_WORDS = ["what", "how", "why", "which", "who", "where"]
PRONOUNS = ["it", "its", "this", "that", "the same"]
TEMPLATES = {"exact_identifier": "identifier", "identifier_detail": "detail", "comparison": "comparison", "table_list": "list", "summary": "summary", "page_lookup": "page"}
HISTORY = 10


def words(c: Column) -> Column:
    """Words between blanks; an empty array for a blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def identifiers(c: Column) -> Column:
    """Distinct identifiers in order: coded ones, then generic ones, else bare numbers in at most three words."""
    coded = F.transform(F.regexp_extract_all(c, F.lit(CODED_ID), F.lit(1)), lambda x: F.concat(F.lit("SIH"), x))
    generic = F.transform(F.regexp_extract_all(c, F.lit(GENERIC_ID), F.lit(1)), F.upper)
    generic = F.filter(generic, lambda x: ~F.translate(x, "-_", "").startswith("SIH"))
    both = F.array_distinct(F.concat(coded, generic))
    bare = F.when(F.size(words(c)) <= 3, F.regexp_extract_all(c, F.lit(BARE_NUMBER), F.lit(1))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(both) > 0, both).otherwise(bare)


def target_page(c: Column) -> Column:
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (PAGE_ORDINAL, PAGE_CARDINAL)]
    return F.coalesce(*found).try_cast("int")


def target_fields(c: Column) -> Column:
    lower = F.lower(c)
    return F.filter(F.array(*[F.when(contains_any(lower, w), F.lit(f)) for f, w in FIELD_WORDS.items()]), lambda x: x.isNotNull())


def is_follow_up(c: Column) -> Column:
    lower = strip(F.lower(c))
    said = words(lower)
    short = (F.size(said) <= 8) & F.arrays_overlap(said, F.array(*map(F.lit, FOLLOW_UP_WORDS)))
    for start in FOLLOW_UP_STARTS:
        short = short | lower.startswith(start)
    return short


def intent(c: Column, ids: Column, page: Column, follow_up: Column) -> Column:
    """One of eleven intents; the first rule that holds decides."""
    lower = strip(F.lower(c))
    some = F.size(ids) > 0
    plain = F.upper(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))
    alone = F.exists(ids, lambda x: F.upper(F.regexp_replace(x, "[^a-zA-Z0-9]", "")) == plain)
    return (
        F.when(contains_any(lower, COMPARISON_WORDS) & (F.size(ids) >= 2), "comparison")
        .when(follow_up & ~some, "follow_up")
        .when((F.coalesce(page, F.lit(0)) != 0) & ~some, "page_lookup")
        .when(contains_any(lower, SUMMARY_WORDS), "summary")
        .when(contains_any(lower, IMAGE_WORDS), "image_note")
        .when(contains_any(lower, LIST_WORDS), "table_list")
        .when(some & alone, "exact_identifier")
        .when(some, "identifier_detail")
        .when((F.size(words(lower)) <= 4) & ~contains_any(lower, QUESTION_WORDS), "keyword")
        .otherwise("semantic")
    )


def resolve(c: Column, last_id: Column) -> Column:
    """The question with its pronouns replaced by the identifier; null without one."""
    for p in PRONOUNS:
        put = F.concat(last_id, F.lit("'s")) if p == "its" else last_id
        c = F.regexp_replace(c, F.lit(rf"(?iU)\b{p}\b"), put)
    return c


def with_history(messages: DataFrame, limit: int = HISTORY) -> DataFrame:
    """messages(conversation_id, created_at, seq, role, content) with last_id, the first identifier of the latest of the
    limit messages before each, and history, those messages as lines. A long conversation is many ranges of messages, each
    with the limit messages before it."""
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("content"))
    seen = messages.withColumn("first_id", F.get(identifiers(F.col("content")), 0)).withColumn("line", line)
    rows = with_rows_before(seen, "conversation_id", ["created_at", "seq"], limit)
    w = W.partitionBy("_part", "conversation_id").orderBy("created_at", "seq").rowsBetween(-limit, -1)
    told = rows.withColumn("last_id", F.last("first_id", ignorenulls=True).over(w)).withColumn("history", F.array_join(F.collect_list("line").over(w), "\n"))
    return told.filter("not _before").drop("first_id", "line", "_part", "_before")


def expanded(question: Column, history: Column) -> Column:
    """A question behind its conversation so far; the question alone where there is none."""
    return F.when(history == "", question).otherwise(F.concat(F.lit("Previous Conversation Context:\n"), history, F.lit("\n\nCurrent Question: "), question))


def plan(questions: DataFrame, text: str = "message") -> DataFrame:
    """questions with normalized, identifiers, target_page, target_fields, is_follow_up, resolved, comparison_ids and
    intent. Where questions carry last_id (see with_history), follow-ups are resolved with it."""
    q = questions.withColumn("normalized", strip(F.col(text)))
    n = F.col("normalized")
    q = q.withColumns({"identifiers": identifiers(n), "target_page": target_page(n), "target_fields": target_fields(n), "is_follow_up": is_follow_up(n)})
    last = F.col("last_id") if "last_id" in questions.columns else F.lit(None).cast("string")
    q = q.withColumn("resolved", F.when(F.col("is_follow_up"), resolve(n, last)))
    again = identifiers(F.col("resolved"))
    q = q.withColumn("identifiers", F.when(F.size(again) > 0, again).otherwise(F.col("identifiers")))
    pair = (F.size("identifiers") >= 2) & contains_any(F.lower(n), COMPARISON_WORDS)
    q = q.withColumn("comparison_ids", F.when(pair, F.slice("identifiers", 1, 2)).otherwise(F.array().cast("array<string>")))
    return q.withColumn("intent", intent(n, F.col("identifiers"), F.col("target_page"), F.col("is_follow_up")))


def template_key(intent_col: Column) -> Column:
    """The prompt template of an intent; `system` unless it has one of its own."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv]), intent_col), F.lit("system"))
