"""Statistics over the catalogue and the query log; documents with their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "\n\n--- CHUNK BREAK ---\n\n"
NO_TEXT = "No text extracted yet."
BLOCKS = "array<struct<block_id:string,text:string,type:string,page:int,bbox:array<int>,line_number:int,confidence:double>>"


def document_stats(catalog: DataFrame) -> DataFrame:
    """One row; one pass with partial sums."""
    s = F.col("status")
    return catalog.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "indexed").alias("indexed"),
        F.count_if(s.isin("pending", "processing")).alias("pending"),
        F.count_if(s == "failed").alias("failed"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size"),
    )


def documents_by_type(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("file_type").agg(F.count(F.lit(1)).alias("count"))


def exact_mean(c: str) -> Column:
    """The mean of a number, 0 where there is none, from an exact sum of its six decimals: no order of the rows and no
    partial sums show in a rounded result."""
    return F.coalesce(F.try_divide(F.sum(F.col(c).cast("decimal(18,6)")).cast("double"), F.count(c)), F.lit(0.0))


def query_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), exact_mean("response_time").alias("avg_time"), exact_mean("confidence").alias("avg_conf"))


def report(catalog: DataFrame, log: DataFrame) -> DataFrame:
    """Both statistics as one row, means to one and four decimals, documents by type as an array."""
    d = document_stats(catalog).select(F.col("total").alias("total_documents"), F.col("indexed").alias("indexed_documents"), F.col("pending").alias("pending_documents"), F.col("failed").alias("failed_documents"), F.col("chunks").alias("total_chunks"), F.col("size").alias("dataset_size_bytes"))
    t = documents_by_type(catalog).agg(F.array_sort(F.collect_list(F.struct("file_type", "count"))).alias("documents_by_type"))
    q = query_stats(log).select(F.col("total").alias("total_queries"), F.round("avg_time", 1).alias("avg_response_time_ms"), F.round("avg_conf", 4).alias("avg_confidence"))
    return d.join(F.broadcast(t)).join(F.broadcast(q))  # one row each


def append_log(rows: DataFrame, path: str) -> None:
    rows.select("question", "answer_type", "confidence", "model", "response_time", "created_at").write.mode("append").parquet(path)


def documents_with_text(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """catalogue rows with full_text, chunk count, first raw and structured recognised texts, and layout blocks."""
    place = F.struct("section_index", "chunk_index", "chunk_id", "text", "raw_ocr", "structured_ocr", "layout_blocks")
    per = chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(place)).alias("c"))  # one document's chunks
    first = lambda name: F.get(F.filter(F.transform("c", lambda x: x[name]), lambda v: F.coalesce(v, F.lit("")) != ""), 0)
    per = per.select("document_id", F.array_join(F.transform("c", lambda x: x.text), BREAK).alias("joined"), F.size("c").alias("n"), first("raw_ocr").alias("raw"), first("structured_ocr").alias("structured"), F.flatten(F.transform("c", lambda x: F.coalesce(F.from_json(x.layout_blocks, BLOCKS), F.array().cast(BLOCKS)))).alias("layout_blocks"))
    full = F.coalesce("joined", F.lit(NO_TEXT))
    rows = catalog.join(per, catalog["id"] == per["document_id"], "left")
    return rows.select("id", "filename", "file_type", "size_bytes", F.coalesce("n", "chunks").alias("chunks_count"), "status", full.alias("full_text"), F.coalesce("raw", full).alias("raw_ocr"), F.coalesce("structured", full).alias("structured_ocr"), F.coalesce("layout_blocks", F.array().cast(BLOCKS)).alias("layout_blocks"))
