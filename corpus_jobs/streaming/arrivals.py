"""Files as they come, change and go, kept in the knowledge tables by one stream.

Each batch of the stream names paths. What a path holds now decides: a file that is there is listed, compared with the
catalogue by its hash and, if new or changed, parsed, chunked and stored in place of its old rows; a path without a file
loses its rows. The tables are bucketed by document, so a batch rewrites the buckets of its documents, and the batch's
number is noted in them: a batch that Spark gives again, after a failure at any point, ends in the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bucketed
from ..operators.retrieval import first_of
from ..plans import jobs
from ..schemas import STORED_CHUNKS, STORED_DOCUMENTS, STORED_RECORDS
from ..sources import files
from ..storage import materialize, scratch
from .watch import DEBOUNCE_SECONDS, debounced, deletions, watched

#: Paths whose files are read at a time; a batch with more is done in parts.
PATHS = 5000


@dataclass(frozen=True)
class Knowledge:
    documents: bucketed.Table
    chunks: bucketed.Table
    records: bucketed.Table


def knowledge(spark: SparkSession, root: str, buckets: int = bucketed.BUCKETS) -> Knowledge:
    """The tables under a folder, there or yet to be written."""
    return Knowledge(
        bucketed.table(spark, f"{root}/documents", STORED_DOCUMENTS, "document_id", buckets=buckets),
        bucketed.table(spark, f"{root}/chunks", STORED_CHUNKS, "chunk_id", "document_id", buckets),
        bucketed.table(spark, f"{root}/records", STORED_RECORDS, "id", "document_id", buckets),
    )


def bring_in(k: Knowledge, listing: DataFrame, gone: DataFrame, batch: int, writer: str, parsers: dict[str, Callable] | None = None) -> None:
    """Stores the new and changed files of a listing (sources.files.listed) and takes out the documents of gone(file_path).

    The catalogue is written last: until then the files still count as changed, so a batch that is given again makes the
    same rows, and buckets that had taken them skip them.
    """
    spark = listing.sparkSession
    with scratch(spark):
        known = materialize(k.documents.rows().select(F.col("document_id").alias("id"), "file_path", "file_hash", "status", "created_at"), "known")
        out = jobs.ingest(listing, known, parsers)
        documents = materialize(out["documents"].withColumn("created_at", F.coalesce("created_at", F.current_timestamp())), "documents")
        lost = known.join(gone, "file_path", "left_semi").select(F.col("id").alias("document_id"))
        ids = materialize(documents.select("document_id").unionByName(lost).distinct(), "ids")
        bucketed.replace(k.chunks, ids, out["chunks"], batch, writer)
        bucketed.replace(k.records, ids, out["records"], batch, writer)
        bucketed.replace(k.documents, ids, documents, batch, writer)


def _slices(paths: DataFrame, size: int = PATHS) -> Iterator[list[str]]:
    rows = (r[0] for r in paths.distinct().toLocalIterator())
    while part := list(islice(rows, size)):
        yield part


def as_now(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(listing, gone) of paths as the file system has them now, under the names that Spark's reader gives them."""
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    there, gone = [], []
    for p in paths:
        at = jvm.Path(p)
        fs = at.getFileSystem(conf)
        (there if fs.exists(at) and fs.getFileStatus(at).isFile() else gone).append(fs.makeQualified(at).toString())
    found = spark.read.format("binaryFile").load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return files.listed(found), spark.createDataFrame([(p,) for p in gone], "file_path string")


def follow(k: Knowledge, changes: DataFrame, checkpoint: str, seconds: float = DEBOUNCE_SECONDS, trigger: dict | None = None, parsers: dict[str, Callable] | None = None, writer: str = "stream"):
    """Starts the query over a stream of changes(path, kind, ts); returns it. Creations and modifications are debounced,
    deletions are not. Files are read when their batch runs."""
    seen = watched(changes)
    both = debounced(seen.filter("kind <> 'deleted'"), seconds).select("path").unionByName(deletions(seen).select("path"))

    def apply(batch: DataFrame, number: int) -> None:
        for n, part in enumerate(_slices(batch)):
            listing, gone = as_now(batch.sparkSession, part)
            bring_in(k, listing, gone, number, f"{writer}-{n}", parsers)

    return both.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{DEBOUNCE_SECONDS} seconds"})).start()


def follow_rows(k: Knowledge, arrivals: DataFrame, checkpoint: str, trigger: dict | None = None, parsers: dict[str, Callable] | None = None, writer: str = "rows"):
    """The same where a stream carries the files: arrivals(path, kind, ts, length, content), as Spark's file stream or a
    table of uploads gives them. Of several rows of a path in a batch, the latest counts."""

    def apply(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            last = materialize(first_of(batch.select("path", "kind", "ts", "length", "content"), ["path"], [F.desc("ts")]), "arrived")
            gone = last.filter("kind = 'deleted'").select(F.col("path").alias("file_path"))
            bring_in(k, files.listed(last.filter("kind <> 'deleted'")), gone, number, writer, parsers)

    return watched(arrivals).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{DEBOUNCE_SECONDS} seconds"})).start()


def new_file_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the files that appear in a folder, as arrivals; Spark's file stream sees each path once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).load(folder).select("path", F.lit("created").alias("kind"), F.col("modificationTime").alias("ts"), "length", "content")


def reconcile(k: Knowledge, folder: str, batch: int, parsers: dict[str, Callable] | None = None, writer: str = "listing") -> None:
    """The periodic comparison of a folder with the catalogue, for changes that no event told: rewritten files are stored anew,
    documents of the folder without a file go."""
    spark = k.documents.spark
    listing = files.read_files(spark, folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    known = k.documents.rows().select("file_path").filter(F.substring_index("file_path", "/", -1) == F.substring(F.col("file_path"), len(root) + 2, 1 << 20)).filter(F.col("file_path").startswith(f"{root}/"))
    gone = known.join(listing.select("file_path"), "file_path", "left_anti")
    bring_in(k, listing, gone, batch, writer, parsers)
