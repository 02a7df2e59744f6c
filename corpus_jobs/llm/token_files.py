"""Token ids as ORC files in document order.

Documents are range-partitioned by id and sorted, encoded, and written as ORC: ids are integer columns, which ORC
stores run-length encoded; every stripe carries a row index with the least and greatest doc_id of each group of rows
and a Bloom filter on doc_id, so a reader can take stripes in parallel and leave out those that cannot hold a document.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import default_path, encoded
from .common import documents, new_path, release, shuffle_partitions, sliced

END_ID = 2
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "lz4",
}

#: Bytes of texts that are encoded into one batch: its offsets have 32 bits, and a text has no more ids than bytes.
SLICE_BYTES = 128 << 20


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Writes (doc_id, file_start, n_tokens, ids) as ORC files whose names, and rows within them, ascend by doc_id.

    Ids are whole numbers. Null texts are empty; null ids come first; rows with the same id lie next to each other, by text. file_start counts
    the ids before the document in its own file, so no task needs to know of another.
    """
    tokens = tokenizer_path or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        at = 0
        for b in sliced(batches, size=SLICE_BYTES):
            done = [x + end for x in encoded(b.column(1).to_pylist(), tokens)]
            n = np.array([len(x) // 4 for x in done], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(done), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), pa.array(n), ids], names=["doc_id", "file_start", "n_tokens", "ids"])
        release()

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = keyed.repartitionByRange(partitions or shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(encode, "doc_id long, file_start long, n_tokens long, ids array<int>").write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_start, n_tokens, ids, file) from the files; filters on doc_id reach the stripes' statistics."""
    schema = "doc_id long, file_start long, n_tokens long, ids array<int>"
    return spark.read.schema(schema).orc(path).withColumn("file", F.col("_metadata.file_name"))


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): ids in all files before each one. One row per file, and only the counts are read."""
    totals = read(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    base, rows = 0, []
    number = lambda r: (int(re.search(r"part-(\d+)", r["file"])[1]), r["file"])  # noqa: E731  names have five digits or more
    for r in sorted(totals, key=number):
        rows.append((r["file"], base))
        base += r["n"]
    return spark.createDataFrame(rows, "file string, base long")


@F.arrow_udf(T.LongType())
def crc32_of_ids(ids: pa.Array) -> pa.Array:
    flat, offsets = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4"), ids.offsets.to_numpy()
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:])], type=pa.int64())


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, from the ids that they hold."""
    rows = read(spark, path).select("doc_id", "file_start", "file", F.size("ids").cast("long").alias("n_tokens"), crc32_of_ids("ids").alias("ids_crc32"))
    return rows.join(file_bases(spark, path), "file").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def op8_orc_token_ids(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write(documents(spark, sf_dir), path)
    return digest(spark, path)
