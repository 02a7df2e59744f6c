"""Stored tables in hash buckets of a key: a batch of changes rewrites the buckets that hold changed keys and no others.

A table is a folder with one partition folder a bucket. The merged rows of the touched buckets are first written beside
the table, then put in place by Spark's dynamic partition overwrite, then the batch's number is noted for the buckets. A
batch that failed anywhere is given again under its number: with its merged rows written whole, these are put in place
again, else they are made from the unchanged table. A batch that was noted changes nothing. Numbers rise from batch to
batch of one writer, and every writer has its own; one writer at a time changes a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import without_nul
from .retrieval import first_of

BUCKET = "_bucket"
#: Buckets of a new table. A change rewrites its buckets whole, so a bucket should be a few files: about a GB.
BUCKETS = 64
_NOTED = "writer string, bucket int, batch long"


@dataclass(frozen=True)
class Table:
    """A bucketed table: rows of one `bucket_key` (as a document's id) lie in one bucket; `key` tells rows apart."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str
    bucket_key: str
    buckets: int

    def rows(self) -> DataFrame:
        """The rows as they are now; an empty frame before the first batch."""
        return self.stored().drop(BUCKET)

    def stored(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path}/rows")

    def noted(self) -> DataFrame:
        """(writer, bucket, batch): the latest batch of each writer that a bucket has taken."""
        if not exists(self.spark, f"{self.path}/batches"):
            return self.spark.createDataFrame([], _NOTED)
        return self.spark.read.schema(_NOTED).parquet(f"{self.path}/batches").groupBy("writer", "bucket").agg(F.max("batch").alias("batch"))


def table(spark: SparkSession, path: str, schema: T.StructType, key: str, bucket_key: str | None = None, buckets: int = BUCKETS) -> Table:
    """The table at a path, there or yet to be written. The number of buckets is the table's own: once written, it stays."""
    return Table(spark, path.rstrip("/"), T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]), key, bucket_key or key, buckets)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def bucket_of(t: Table, column: str):
    return F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(t.buckets)).cast("int")


def _apply(t: Table, touched: DataFrame, merged, batch: int, writer: str) -> list[int]:
    """Replaces the touched buckets by merged(their old rows); returns the buckets that were rewritten."""
    staged = f"{t.path}/staged-{writer}-{batch}"
    done = {r["bucket"] for r in t.noted().filter((F.col("writer") == writer) & (F.col("batch") >= batch)).collect()}  # no more than there are buckets
    whole = exists(t.spark, f"{staged}/rows/_SUCCESS") and exists(t.spark, f"{staged}/buckets/_SUCCESS")
    if not whole:
        todo = sorted({r[0] for r in touched.distinct().collect()} - done)
        if not todo:
            return []
        old = t.stored().filter(F.col(BUCKET).isin(todo))  # reads these folders only
        rows = merged(old, todo)
        t.spark.createDataFrame([(b,) for b in todo], f"{BUCKET} int").write.mode("overwrite").parquet(f"{staged}/buckets")
        rows.write.mode("overwrite").parquet(f"{staged}/rows")
    todo = sorted({r[0] for r in t.spark.read.schema(f"{BUCKET} int").parquet(f"{staged}/buckets").collect()} - done)
    if not todo:  # all was done but for taking away what was staged
        _remove(t.spark, staged)
        return []
    rows = t.spark.read.schema(t.stored().schema).parquet(f"{staged}/rows")
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{t.path}/rows")
    left = {r[0] for r in rows.select(BUCKET).distinct().collect()}
    for b in todo:
        if b not in left:  # an overwrite leaves a partition that gets no rows as it was
            _remove(t.spark, f"{t.path}/rows/{BUCKET}={b}")
    t.spark.createDataFrame([(writer, b, batch) for b in todo], _NOTED).coalesce(1).write.mode("append").parquet(f"{t.path}/batches")
    _remove(t.spark, staged)
    return todo


def upsert(t: Table, new: DataFrame, batch: int, order: list[str] | None = None, writer: str = "main") -> list[int]:
    """Puts new rows in the place of old ones with the same key; of several new ones of a key the last by `order`, without
    NUL characters. A key that moves to another bucket_key must be removed first. Returns the buckets rewritten."""
    if order:
        new = first_of(new, [t.key], [F.desc(c) for c in order])
    new = without_nul(new.select(t.schema.names)).withColumn(BUCKET, bucket_of(t, t.bucket_key))

    def merged(old: DataFrame, todo: list[int]) -> DataFrame:
        mine = new.filter(F.col(BUCKET).isin(todo))
        return old.join(mine.select(BUCKET, t.key).distinct(), [BUCKET, t.key], "left_anti").select(mine.columns).unionByName(mine)

    return _apply(t, new.select(BUCKET), merged, batch, writer)


def replace(t: Table, gone: DataFrame, new: DataFrame | None, batch: int, writer: str = "main") -> list[int]:
    """Takes out all rows of the bucket keys in `gone` (one column) and puts in the new rows, in one batch: a document's rows
    are replaced by those of its new text, or with `new` left out removed."""
    ids = gone.select(F.col(gone.columns[0]).cast("string").alias("_gone")).distinct().withColumn(BUCKET, bucket_of(t, "_gone"))
    fresh = None if new is None else without_nul(new.select(t.schema.names)).withColumn(BUCKET, bucket_of(t, t.bucket_key))
    touched = ids.select(BUCKET) if fresh is None else ids.select(BUCKET).unionByName(fresh.select(BUCKET))

    def merged(old: DataFrame, todo: list[int]) -> DataFrame:
        mine = ids.filter(F.col(BUCKET).isin(todo))
        left = old.join(mine, (old[BUCKET] == mine[BUCKET]) & (old[t.bucket_key].cast("string") == mine["_gone"]), "left_anti")
        return left if fresh is None else left.select(fresh.columns).unionByName(fresh.filter(F.col(BUCKET).isin(todo)))

    return _apply(t, touched, merged, batch, writer)


def cascade(gone: DataFrame, batch: int, *tables: Table, writer: str = "main") -> dict[str, list[int]]:
    """Removes documents from several tables, all bucketed by the document's id, in the buckets that hold any of them."""
    return {t.path: replace(t, gone, None, batch, writer) for t in tables}
