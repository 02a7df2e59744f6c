"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, new_path, shared_dir

__all__ = ["BLANKS", "as_bytes", "documents", "fresh", "materialize", "new_path", "release", "shared_dir", "shuffle_partitions", "sliced", "with_last"]

#: Bytes that separate words: space and \t \n \v \f \r, which is what bytes.split() and bytes.strip() take.
BLANKS = b" \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sliced(batches, rows: int = 500, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of fewer rows, so that Python values are made for a few texts at a time; with a size, slices of
    several rows hold no more bytes than that."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            parts = [b.slice(i, rows)]
            while parts:
                part = parts.pop()
                if size and part.num_rows > 1 and part.get_total_buffer_size() > size and part.nbytes > size:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def with_last(items: Iterable) -> Iterator[tuple[bool, object]]:
    """(whether it is the last one, item) for each item."""
    items = iter(items)
    for item in items:
        for following in items:
            yield False, item
            item = following
        yield True, item


def release() -> None:
    """Gives freed memory back to the system at the end of a task; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
