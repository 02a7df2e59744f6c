"""Schemas of the knowledge tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"s": T.StringType, "i": T.IntegerType, "l": T.LongType, "d": T.DoubleType, "t": T.TimestampType, "b": T.BooleanType}
    return T.StructType([T.StructField(n, kinds[k]()) for n, k in (x.split(":") for x in text.split())])


#: Every key that a parser or a record may set on a chunk.
META = _struct(
    "file_name:s file_type:s file_path:s dataset_type:s source_type:s section:s sheet_name:s columns:s row_range:s "
    "identifier:s ps_code:s record_type:s ocr_confidence:s raw_ocr:s structured_ocr:s layout_blocks:s "
    "page_number:i slide_number:i chunk_index:i total_pages:i image_number:i"
)
CATALOG = _struct("id:s filename:s file_type:s file_path:s file_hash:s size_bytes:l chunks:l status:s dataset_type:s error_message:s created_at:t indexed_at:t updated_at:t")
SECTIONS = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("section_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("meta", META)])
CHUNKS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("chunk_id", "document_id", "text", "file_name")], T.StructField("meta", META)])
RECORDS = _struct("id:s document_id:s record_type:s identifier:s ps_code:s track:s problem_statement_title:s theme:s sponsoring_ministry:s problem_statement:s source_document:s raw_text:s page_number:i created_at:t")
QUERY_LOG = _struct("question:s answer_type:s confidence:d model:s response_time:i created_at:t")
MESSAGES = _struct("id:s conversation_id:s role:s content:s model:s answer_type:s confidence:d sources:s created_at:t")
FILE_EVENTS = _struct("path:s kind:s ts:t")
#: The tables that files are kept in (streaming.arrivals).
STORED_DOCUMENTS = _struct("document_id:s filename:s file_type:s file_path:s file_hash:s size_bytes:l chunks:l status:s dataset_type:s error_message:s created_at:t")
STORED_CHUNKS = T.StructType([*_struct("chunk_id:s document_id:s text:s").fields, *[f for f in META.fields if f.name != "file_path"]])
STORED_RECORDS = T.StructType([f for f in RECORDS.fields if f.name != "created_at"])
