"""Candidate lists for questions, their fusion, boosts and filters.

A candidate is a row (query_id, list_no, rank, chunk_id, document_id, text, score, origin, meta_keys, meta): list_no is
the list's place (1 identifier, 2 page, 3 keyword, 4 dense), rank counts from 1 within a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import canonical_id, contains_any, squeezed, strip

# Fixed values of the service: constants of fusion and boosts, keywords and file types of images.
RRF_K = 60
SCORES = {"record": 10.0, "identifier": 10.0, "text": 8.0, "phrase": 3.0, "page": 5.0}
IDENTIFIER_BOOST, IMAGE_BOOST, RATIO, CITATION = 5.0, 2.0, 0.35, 0.28
IMAGE_TYPES = ["image", "png", "jpg", "jpeg", "webp"]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp"]
IMAGE_QUESTION_WORDS = [
    "image", "handwritten", "note", "notes", "writing", "written", "picture", "photo", "diagram", "draw", "report",
    "purpose of report", "features of a good report", "useful tip", "what is a report",
]
#: Keys that a record's metadata has, and an un-hydrated keyword hit.
RECORD_KEYS, BARE_KEYS = 11, 1


def union(lists: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by the order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top(rows: DataFrame, keys: list[str], order: list, k: int, number: str = "rank") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(number, F.row_number().over(w)).filter(F.col(number) <= k)


# --- lookups -----------------------------------------------------------------------------------------------------------


def record_lookup(asked: DataFrame, records: DataFrame, k: int | None = None) -> DataFrame:
    """asked(query_id, ident, ...) with the structured records whose identifier or code it is: two equi-joins, no OR. With k, the
    first so many of an identifier by id, cut before they meet the questions."""
    both = [records.withColumn("key", canonical_id(F.col(c))) for c in ("identifier", "ps_code")]
    some = union(both).filter("key <> ''").dropDuplicates(["key", "id"])
    some = some if k is None else top(some, ["key"], ["id"], k)
    return asked.withColumn("key", canonical_id(F.col("ident"))).join(some, "key").drop("key")


def identifier_lookup(asked: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """asked(query_id, ident, ...) with at most k chunks whose metadata carry the identifier, score 10. Chunks are cut to k for each
    identifier before they meet the questions, in every task before the shuffle too, so a common one is no long list."""
    keyed = asked.withColumn("key", canonical_id(F.col("ident")))
    both = F.array_distinct(F.array(*[canonical_id(F.col(c)) for c in ("identifier", "ps_code")]))
    some = top(chunks.withColumn("key", F.explode(both)).filter("key <> ''"), ["key"], ["chunk_id"], k)
    return keyed.join(some, "key").drop("key").withColumn("score", F.lit(SCORES["identifier"]))


def variants(asked: DataFrame) -> DataFrame:
    """asked(query_id, ident, ...) -> the spellings that are searched as phrases: canonical, upper case, as written if that is
    more than a matter of case, which searches fold."""
    written = F.when(F.lower(F.upper("ident")) == F.lower("ident"), F.upper("ident")).otherwise(F.col("ident"))
    forms = F.array_distinct(F.array(canonical_id(F.col("ident")), F.upper("ident"), written))
    return asked.select("*", F.posexplode(forms).alias("variant", "question"))


def identifier_phrases(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits(query_id, ident, variant, chunk_id, position, ...) of the spellings -> one row per chunk, score 8 where the text
    holds the canonical identifier, else 3."""
    once = first_of(hits, ["query_id", "ident", "chunk_id"], ["variant", "position"])
    full = once.join(chunks.select("chunk_id", "document_id", "text"), "chunk_id")
    inside = squeezed(F.col("text")).contains(canonical_id(F.col("ident")))
    return full.withColumn("score", F.when(inside, SCORES["text"]).otherwise(SCORES["phrase"]))


def hydrated(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """hits with the chunk's metadata columns; what the hit has itself stays where the chunk is unknown."""
    known = chunks.select("chunk_id", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = hits.join(known, "chunk_id", "left")
    return joined.select(*[c for c in hits.columns if c not in columns], *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in hits.columns else F.coalesce(F.col(f"_{c}"), F.lit("")).alias(c) for c in columns])


def page_lookup(asked: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """asked(query_id, target_page) with at most k chunks of that page, score 5.

    Page 1 exists in every document, so chunks are cut to k per page before they meet the questions.
    """
    per_page = top(chunks.filter("page_number is not null"), ["page_number"], ["chunk_id"], k)
    found = asked.filter("target_page is not null and target_page <> 0").join(per_page, F.col("target_page") == F.col("page_number"))
    return found.withColumn("score", F.lit(SCORES["page"]))


def record_text() -> Column:
    """A record as labelled lines and its raw text."""
    names = ["ps_code", "track", "problem_statement_title", "problem_statement", "theme", "sponsoring_ministry", "page_number"]
    parts = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), None).otherwise(F.concat(F.lit(f"{c.replace('_', ' ').title()}: "), F.col(c).cast("string"))) for c in names]
    return F.concat_ws("\n", *parts, F.nullif(F.col("raw_text"), F.lit("")))


def identifier_search(records: DataFrame, by_meta: DataFrame, by_phrase: DataFrame, k: int = 10) -> DataFrame:
    """The three lookups' rows (query_id, ident_no, chunk_id, score, place, ...) as one list per question.

    In the order of identifiers, then strategies, then places, the first row of a chunk stays; then the k best scores.
    Rows are shuffled once.
    """
    rows = union([x.withColumn("strategy", F.lit(i)) for i, x in enumerate((records, by_meta, by_phrase))]).repartition("query_id")
    order = ["ident_no", "strategy", "place", "chunk_id"]
    return top(first_of(rows, ["query_id", "chunk_id"], order), ["query_id"], [F.desc("score"), *order], k)


# --- fusion, boosts and filters ------------------------------------------------------------------------------------------


def _fused(candidates: DataFrame, k: int) -> DataFrame:
    rows = candidates.filter("chunk_id is not null and chunk_id <> ''")
    copy = F.struct(*[c for c in candidates.columns if c not in ("query_id", "chunk_id", "score")])
    return rows.groupBy("query_id", "chunk_id").agg(
        F.sum(1 / (k + F.col("rank"))).alias("score"),
        F.max_by(copy, F.struct("meta_keys", -F.col("list_no"), -F.col("rank"))).alias("best"),
        F.min(F.struct("list_no", "rank")).alias("seen"),
        F.min_by("score", "rank").alias("own"),
        F.max("list_no").alias("last"),
    )


def fuse(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, best, seen): reciprocal-rank sums over the lists, and the copy with most metadata,
    the earlier list's on a tie. Texts need not take part: join them to the few rows that remain."""
    return _fused(candidates, k).drop("own", "last")


def fuse_or_keep(candidates: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fused scores for questions with several lists; questions with a single list keep its own scores. One shuffle by
    question and chunk, one by question."""
    w = W.partitionBy("query_id")
    single = F.max("last").over(w) == F.min("seen.list_no").over(w)
    both = _fused(candidates, k).withColumn("single", single)
    return both.withColumn("score", F.when(F.col("single"), F.col("own")).otherwise(F.col("score"))).drop("own", "last", "single")


def lists_for(plans: DataFrame, identifier: DataFrame, page: DataFrame, keyword: DataFrame, dense: DataFrame) -> DataFrame:
    """The lists of each question in one table; questions that ask for an exact identifier and have an identifier hit
    take no keyword and dense rows."""
    done = identifier.select("query_id").distinct().join(plans.filter("intent = 'exact_identifier'").select("query_id"), "query_id")
    narrow = union([identifier.withColumn("list_no", F.lit(1)), page.withColumn("list_no", F.lit(2))])
    broad = union([keyword.withColumn("list_no", F.lit(3)), dense.withColumn("list_no", F.lit(4))]).join(done, "query_id", "left_anti")
    return union([narrow, broad])


def has_identifier(identifiers: Column, text: Column, identifier: Column, ps_code: Column) -> Column:
    """Whether a canonical identifier stands in the squeezed text or is the chunk's identifier or code."""
    inside, own, code = squeezed(text), squeezed(identifier), squeezed(ps_code)
    return F.exists(F.transform(identifiers, canonical_id), lambda x: inside.contains(x) | (x == own) | (x == code))


def identifier_boost(rows: DataFrame) -> DataFrame:
    hit = F.coalesce(has_identifier(F.col("identifiers"), F.coalesce("text", F.lit("")), F.coalesce("identifier", F.lit("")), F.coalesce("ps_code", F.lit(""))), F.lit(False))
    return rows.withColumn("score", F.col("score") + F.when(hit, IDENTIFIER_BOOST).otherwise(0.0))


def is_placeholder(text: Column) -> Column:
    """Empty, or the note that an image's recognition left instead of a text."""
    t = strip(F.coalesce(text, F.lit("")))
    return (t == "") | (t.contains("[Image:") & t.contains("OCR processing complete"))


def drop_placeholders(rows: DataFrame) -> DataFrame:
    return rows.filter(~is_placeholder(F.col("text")))


def image_boost(rows: DataFrame, question: str = "question") -> DataFrame:
    asks = contains_any(F.lower(question), IMAGE_QUESTION_WORDS)
    image = F.lower(F.coalesce("file_type", F.lit(""))).isin(IMAGE_TYPES[1:]) | (F.lower(F.coalesce("source_type", F.lit(""))) == "image")
    return rows.withColumn("score", F.col("score") + F.when(asks & image, IMAGE_BOOST).otherwise(0.0))


def ratio_filter(rows: DataFrame, order: list, ratio: float = RATIO) -> DataFrame:
    """Rows of the question's top document, and others with at least the given share of the top score."""
    w = W.partitionBy("query_id").orderBy(*order)
    best = rows.withColumns({"_score": F.first("score").over(w), "_doc": F.first("document_id").over(w)})
    return best.filter((F.col("document_id") == F.col("_doc")) | (F.col("score") >= F.col("_score") * ratio)).drop("_score", "_doc")


def hybrid(rows: DataFrame, question: str = "question", k: int = 10) -> DataFrame:
    """Fused rows with their question, identifiers, text and metadata -> boosted, filtered and cut to 2 k, ranked."""
    order = [F.desc("score"), "seen", "chunk_id"]
    kept = image_boost(drop_placeholders(identifier_boost(rows)), question)
    return top(ratio_filter(kept, order), ["query_id"], order, 2 * k)


def is_image_chunk(file_type: Column, file_name: Column, source_type: Column | None = None) -> Column:
    image = F.lower(F.coalesce(file_type, F.lit(""))).isin(IMAGE_TYPES)
    for suffix in IMAGE_SUFFIXES:
        image = image | F.lower(F.coalesce(file_name, F.lit(""))).endswith(suffix)
    return image if source_type is None else image | (F.lower(F.coalesce(source_type, F.lit(""))) == "image")


def isolate_images(rows: DataFrame) -> DataFrame:
    """For questions about an image, only image chunks where there are any; rows carry intent and is_image."""
    any_image = F.max(F.col("is_image").cast("int")).over(W.partitionBy("query_id")) == 1
    return rows.withColumn("_any", any_image).filter((F.col("intent") != "image_note") | ~F.col("_any") | F.col("is_image")).drop("_any")


def cited(rows: DataFrame, candidates: DataFrame, least: float = CITATION) -> DataFrame:
    """Rows that an answer may cite: a score of at least 0.28; for image questions every image row, else the first image
    candidate. Both tables carry query_id, intent, is_image, rank and score."""
    plain = rows.filter((F.col("intent") != "image_note") & (F.coalesce("score", F.lit(0.0)) >= least))
    images = rows.filter((F.col("intent") == "image_note") & F.col("is_image"))
    spare = candidates.filter((F.col("intent") == "image_note") & F.col("is_image")).join(images.select("query_id").distinct(), "query_id", "left_anti")
    return union([plain, images, first_of(spare, ["query_id"], ["rank", "chunk_id"])])
