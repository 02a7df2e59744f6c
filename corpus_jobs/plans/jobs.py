"""The two whole jobs: files into knowledge tables, and a table of questions into contexts and source cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import records as rec
from ..functions import routing
from ..operators import answers, catalog, chunking, dense, keyword, ranking, retrieval
from ..schemas import META
from ..sources import files
from ..storage import materialize

NO_TEXT, NO_CHUNKS = "No readable content found", "Chunking produced no results"
RECORD_FIELDS = ["track", "problem_statement_title", "theme", "sponsoring_ministry", "problem_statement", "source_document"]


def with_columns_of(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """df with the named columns, null where it has none of that name."""
    have = set(df.columns)
    return df.withColumns({n: F.lit(None).cast(t) for n, t in fields if n not in have})


#: Metadata of a chunk; the path is the key of a file until it has its document id.
_META = [(f.name, f.dataType) for f in META.fields if f.name != "file_path"]


def sections_of(listing: DataFrame, parsers: dict[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with their content -> (sections, failures). Text, Markdown, JSON and CSV are read by Spark, other types by the
    given parsers; a parser's metadata keys that the schema knows become columns."""
    own = {"txt": files.text_sections, "markdown": files.markdown_sections, "json": files.json_sections, "csv": files.csv_sections}
    built = [with_columns_of(f(listing.filter(F.col("file_type") == k)), _META) for k, f in own.items()]
    columns = ["file_path", "section_index", "text", *[n for n, _ in _META]]
    parsed = files.parsed(listing.filter(~F.col("file_type").isin(list(own))), parsers or {})
    given = parsed.filter("error is null").select("file_path", "section_index", "text", *[F.try_element_at("meta", F.lit(n)).try_cast(t).alias(n) for n, t in _META])
    sections = retrieval.union([b.select(columns) for b in [*built, given]])
    return sections, parsed.filter("error is not null").select("file_path", "error")


def ingest(listing: DataFrame, known: DataFrame, parsers: dict[str, Callable] | None = None, encoder: Callable | None = None, force: bool = False) -> dict[str, DataFrame]:
    """listing (see sources.files.listed) against the catalogue -> documents, chunks, records and, with an encoder,
    vectors of new and changed files; ids that must leave the old tables are those of documents."""
    changed = catalog.changes(listing, known, force).filter("change <> 'unchanged'")
    changed = materialize(changed, "changed")
    sections, failures = sections_of(changed.drop("document_id", "created_at", "change"), parsers)
    sections = materialize(sections, "sections")
    lead = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_index", F.substring("text", 1, 2000).alias("t")))), lambda x: x.t), "\n\n")
    # the first 2000 characters of a document lie in its first sections; 2000 sections hold them in any case
    heads = sections.filter("section_index < 2000").groupBy("file_path").agg(lead.alias("head"))
    docs = changed.drop("content").join(heads, "file_path", "left").join(failures.groupBy("file_path").agg(F.min("error").alias("error")), "file_path", "left")
    docs = docs.withColumn("dataset_type", files.dataset_type(F.col("filename"), F.coalesce("head", F.lit(""))))
    file_meta = docs.select("file_path", F.col("document_id"), *[F.col(c).alias(f"_{c}") for c in ("filename", "file_type", "dataset_type")])
    full = sections.join(file_meta, "file_path")
    full = full.withColumns(chunking.merged_metadata({"file_name": "_filename", "file_type": "_file_type", "dataset_type": "_dataset_type"}, ["file_name", "file_type", "dataset_type"]))
    full = full.drop("_filename", "_file_type", "_dataset_type")
    pages = full.filter("file_type = 'pdf' and page_number is not null").select("document_id", "file_name", "page_number", "text")
    records = materialize(rec.extract(pages), "records")
    chunks = chunking.chunk_long_sections(full.drop("chunk_index"))
    own = with_columns_of(rec.record_chunks(records), _META).select("chunk_id", "document_id", "text", *[n for n, _ in _META])
    chunks = materialize(chunks.select("chunk_id", "document_id", "text", *[n for n, _ in _META]).unionByName(own), "chunks")
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    docs = docs.join(n, "document_id", "left")
    error = F.when(F.col("n").isNull(), F.coalesce("error", F.when(F.col("head").isNull(), NO_TEXT).otherwise(NO_CHUNKS)))
    documents = docs.select("document_id", "filename", "file_type", "file_path", "file_hash", "size_bytes", F.coalesce("n", F.lit(0)).alias("chunks"), F.when(error.isNull(), "indexed").otherwise("failed").alias("status"), "dataset_type", error.alias("error_message"), "created_at")
    out = {"documents": documents, "chunks": chunks, "records": records}
    if encoder:
        out["vectors"] = dense.embed(chunks.select("chunk_id", "text"), encoder).select("chunk_id", "embedding")
    return out


def _listed(rows: DataFrame, origin: str) -> DataFrame:
    return rows.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.lit(origin).alias("origin"))


def answer(questions: DataFrame, chunks: DataFrame, records: DataFrame, scorer: Callable, vectors: DataFrame | None = None, encoder: Callable | None = None, k: int = 10, stemmed: bool = True) -> dict[str, DataFrame]:
    """questions(query_id, question, optional last_id) -> plans, candidates, reranked, confidence, contexts, cards.

    Lists carry ids and scores only; texts and metadata are joined to the few fused rows.
    """
    plans = materialize(routing.plan(questions, "question"), "plans")
    index = materialize(keyword.index(chunks, stemmed), "index")
    asked = plans.select("query_id", F.posexplode("identifiers").alias("ident_no", "ident"))
    number = asked.select("query_id", "ident", "ident_no")
    found = [
        retrieval.record_lookup(asked.drop("ident_no"), records).join(number, ["query_id", "ident"]).select("query_id", "ident_no", F.col("id").alias("chunk_id"), F.lit(10.0).alias("score"), F.lit(0).alias("place"), F.lit("structured_record").alias("origin")),
        retrieval.identifier_lookup(asked.drop("ident_no"), chunks, k).join(number, ["query_id", "ident"]).select("query_id", "ident_no", "chunk_id", "score", F.col("rank").alias("place"), F.lit("identifier_exact").alias("origin")),
    ]
    forms = retrieval.variants(asked).withColumn("pair", F.to_json(F.struct("query_id", "ident", "variant")))
    hits = keyword.phrase_search(forms.select(F.col("pair").alias("query_id"), "question"), index, k, stemmed).withColumnRenamed("query_id", "pair")
    hits = forms.join(hits, "pair").select("query_id", "ident", "variant", "chunk_id", "position")
    found.append(retrieval.identifier_phrases(hits, chunks).join(number, ["query_id", "ident"]).select("query_id", "ident_no", "chunk_id", "score", F.col("position").alias("place"), F.lit("identifier_fts").alias("origin")))
    best = retrieval.identifier_search(*found, k=k)
    identifier = best.select("query_id", "chunk_id", "rank", "score", "origin")
    page = _listed(retrieval.page_lookup(plans.select("query_id", "target_page"), chunks.select("chunk_id", "page_number"), k), "page_lookup")
    said = plans.select("query_id", F.coalesce("resolved", "normalized").alias("question"))
    words = _listed(keyword.phrase_search(said, index, k, stemmed).select("query_id", "chunk_id", F.col("position").alias("rank"), "score"), "keyword")
    if encoder and vectors is not None:
        near = dense.dense_search(dense.embed(said, encoder, "question"), vectors, k=k)
        meaning = _listed(near.select("query_id", "chunk_id", F.col("position").alias("rank"), "score"), "semantic")
    else:
        meaning = words.limit(0)
    lists = retrieval.lists_for(plans, identifier, page, words, meaning)
    keys = F.when(F.col("origin") == "structured_record", retrieval.RECORD_KEYS).otherwise(len(_META))
    lists = materialize(lists.withColumn("meta_keys", keys), "lists")
    fused = retrieval.fuse_or_keep(lists).select("query_id", "chunk_id", "score", "seen", F.col("best.origin").alias("origin"))
    fields = [*_META, *[(c, T.StringType()) for c in RECORD_FIELDS]]
    names = [n for n, _ in fields]
    body = with_columns_of(chunks, fields).select("chunk_id", "document_id", "text", *names)
    looked_up = with_columns_of(records.withColumns({"text": retrieval.record_text(), "chunk_id": F.col("id"), "file_name": F.col("source_document")}), fields).select("chunk_id", "document_id", "text", *names)
    # a record's own chunk has its id; the record itself says more
    full = looked_up.unionByName(body.join(looked_up.select("chunk_id"), "chunk_id", "left_anti"))
    asks = plans.select("query_id", "question", "intent", "identifiers", F.coalesce("resolved", "normalized").alias("search"))
    rows = retrieval.hybrid(fused.join(full, "chunk_id").join(asks, "query_id"), "search", k)
    rows = retrieval.isolate_images(rows.withColumn("is_image", retrieval.is_image_chunk(F.col("file_type"), F.col("file_name"), F.col("source_type"))))
    rows = rows.withColumn("is_exact", ranking.is_exact(F.col("identifiers"), F.col("text"), F.col("identifier"), F.col("ps_code"), F.col("origin")))
    rows = materialize(rows, "merged")
    rows = materialize(ranking.with_scores(rows, ranking.scored_by_length(rows, scorer, "search"), "search"), "scored")
    top = ranking.rerank(rows).withColumn("has_id", F.coalesce(retrieval.has_identifier(F.col("identifiers"), F.col("text"), F.coalesce("identifier", F.lit("")), F.coalesce("ps_code", F.lit(""))), F.lit(False)))
    top = materialize(top, "reranked")
    conf = ranking.confidence(plans.select("query_id", "question", "intent"), top)
    cards = answers.source_cards(retrieval.cited(top, rows))
    return {"plans": plans, "candidates": lists, "merged": rows, "reranked": top, "confidence": conf, "contexts": answers.context(top), "cards": cards}
