"""Embedding and dense search. The encoder is given by the caller."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialize

#: Questions that one pass over the vectors answers and that the driver holds at a time; more make more passes.
BLOCK = 4096
#: Vectors and questions that are multiplied at a time.
ROWS, QUESTIONS = 4096, 256


def embed(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", batch: int = 64) -> DataFrame:
    """texts with an embedding column: the encoder's vectors of batches of texts, scaled to unit length."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def of(values: pa.Array) -> pa.Array:
        rows, out = [v or "" for v in values.to_pylist()], []
        for i in range(0, len(rows), batch):
            v = np.asarray(encoder(rows[i : i + batch]), dtype=np.float32)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            out.extend((v / np.where(norm == 0, 1, norm)).tolist())
        return pa.array(out, type=pa.list_(pa.float32()))

    return texts.withColumn("embedding", of(F.col(text)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of unit length; a null or zero vector is a row of zeros."""
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    if column.null_count:
        width = next((len(v) for v in column if v.is_valid), 0)
        column = column.fill_null(pa.scalar([0.0] * width, column.type))
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def _merged(best: list[tuple[float, object]], scores: np.ndarray, keys: pa.Array, k: int) -> list[tuple[float, object]]:
    """The k best of a question with those of one more batch: keys are looked at only where the score is the k-th or better."""
    least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else -np.inf
    if len(best) == k:
        least = max(least, -best[-1][0])
    at = np.flatnonzero(scores >= least)
    if not len(at):
        return best
    return heapq.nsmallest(k, [*best, *zip((-scores[at]).tolist(), keys.take(pa.array(at)).to_pylist())])


def _pass(ids: list, questions: np.ndarray, vectors: DataFrame, key: str, key_type: T.DataType, id_type: T.DataType, k: int) -> DataFrame:
    """The k nearest vectors of each partition for a block of questions."""

    def run(batches):
        best: list[list[tuple[float, object]]] = [[] for _ in ids]
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                m = matrix(part.column(1)).T
                for q in range(0, len(ids), QUESTIONS):
                    for j, scores in enumerate(np.round(questions[q : q + QUESTIONS] @ m, 9), q):
                        best[j] = _merged(best[j], scores, part.column(0), k)
        schema = pa.schema([("query_id", to_arrow_type(id_type)), (key, to_arrow_type(key_type)), ("similarity", pa.float64())])
        rows = [(q, name, -s) for q, mine in zip(ids, best) for s, name in mine]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), schema.types)], schema=schema)

    out = T.StructType([T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("similarity", T.DoubleType())])
    return vectors.filter("embedding is not null").select(key, "embedding").mapInArrow(run, out)


def dense_search(questions: DataFrame, vectors: DataFrame, key: str = "chunk_id", k: int = 10, block: int = BLOCK) -> DataFrame:
    """questions(query_id, embedding), vectors(key, embedding) -> (query_id, key, similarity, position, score).

    The questions are taken in blocks that bound a task's memory; each pass multiplies a block with batches of vectors
    and keeps k per partition, so only k rows per question and partition are shuffled. Ties go to the smaller key. Ids
    and keys are long or string.
    """
    n_blocks = questions.count() // block + 1
    id_type, key_type = questions.schema["query_id"].dataType, vectors.schema[key].dataType
    found = None
    for b in range(n_blocks):
        rows = questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).select("query_id", "embedding").collect()
        if not rows:
            continue
        m = matrix(pa.array([r["embedding"] for r in rows], type=pa.list_(pa.float32())))
        one = _pass([r["query_id"] for r in rows], m, vectors, key, key_type, id_type, k)
        if n_blocks > 1:  # written before the next block is read, so that the driver holds one
            one = materialize(one, "near")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = questions.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("similarity", T.DoubleType())]))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).withColumn("score", F.greatest(F.lit(0.0), F.col("similarity")))
