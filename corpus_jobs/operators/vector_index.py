"""A trained vector index: inverted lists around fitted centroids, with residual codes of a product quantiser.

Fitting sees a bounded sample of the vectors (SAMPLE rows with the smallest hashes of their keys); every vector is indexed. A search
opens the lists whose centroids are nearest to a question, ranks their codes by table look-ups, and scores the best ones
exactly. Lists are cut into parts of at most about PART_ROWS rows, and the questions of a list into blocks, so a list or a
group of questions that holds a third of all rows is many keys. Only keys, codes and questions are shuffled; the vectors
themselves are read once more where the best codes are scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..storage import materialize
from .dense import matrix

#: Vectors that centroids and codes are fitted on.
SAMPLE = 65_536
#: Codes for each subspace; a code is a byte.
CODES = 256
SUBSPACES = 16
ROUNDS = 15
#: Rows of a part of a list, and questions of a block, that one task call compares.
PART_ROWS, BLOCK_QUESTIONS = 16_384, 512
#: Codes scored exactly for each of the k results.
RESCORE = 20
#: The lists opened for a question are as many as it takes to have this share of the NEAR nearest vectors of TRIALS
#: questions out of the sample, each against the whole sample.
SHARE, NEAR, TRIALS = 0.95, 10, 256


@dataclass(frozen=True)
class Model:
    """centroids (lists x dimensions) and codes (subspaces x codes x dimensions of a subspace)."""

    centroids: np.ndarray
    codes: np.ndarray
    probes: int = 1

    def nearest_lists(self, m: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids of each row, nearest first."""
        d = (self.centroids**2).sum(1) - 2 * m @ self.centroids.T
        near = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(m), 1))
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)

    def encoded(self, residuals: np.ndarray) -> np.ndarray:
        """The nearest code of each subspace, a byte each."""
        out = np.empty((len(residuals), len(self.codes)), np.uint8)
        for s, part in enumerate(np.split(residuals, len(self.codes), axis=1)):
            out[:, s] = ((self.codes[s] ** 2).sum(1) - 2 * part @ self.codes[s].T).argmin(1)
        return out


def _means(rows: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n centres by Lloyd's rounds from random rows; a centre that no row is nearest to is put on one of the farthest rows."""
    n = min(n, len(rows))
    centres = rows[rng.choice(len(rows), n, replace=False)].copy()
    for _ in range(ROUNDS):
        d = (centres**2).sum(1) - 2 * rows @ centres.T
        of, least = d.argmin(1), d.min(1) + (rows**2).sum(1)
        counts = np.bincount(of, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
        empty = np.flatnonzero(~full)
        centres[empty] = rows[np.argsort(-least, kind="stable")[: len(empty)]]
    return centres


def fit(vectors: DataFrame, key: str = "chunk_id", lists: int | None = None, subspaces: int = SUBSPACES, sample: int = SAMPLE, seed: int = 1) -> Model | None:
    """Centroids and codes from at most `sample` vectors. By default there is a list for each square root of the number of
    all vectors, at most one for 32 vectors of the sample. Vectors are scaled to unit length; null ones are left out. None
    for an empty table. The number of dimensions must be a multiple of `subspaces`. How many lists a search opens is set by
    the sample as well: few where vectors lie in groups, many where they lie anywhere."""
    rows = vectors.filter("embedding is not null")
    n = rows.count()
    taken = rows.select(F.xxhash64(key).alias("_h"), "embedding").orderBy("_h").limit(sample)
    m = matrix(taken.toArrow().column("embedding").combine_chunks())
    if not len(m):
        return None
    rng = np.random.default_rng(seed)
    centroids = _means(m, lists or max(1, min(round(n**0.5), len(m) // 32)), rng)
    residuals = m - centroids[Model(centroids, np.zeros((0, 0, 0))).nearest_lists(m, 1)[:, 0]]
    codes = [_means(part, CODES, rng) for part in np.split(residuals, subspaces, axis=1)]
    return Model(centroids, np.stack(codes), _probes_for(m, centroids, rng))


def _probes_for(m: np.ndarray, centroids: np.ndarray, rng: np.random.Generator) -> int:
    """How many lists hold SHARE of the nearest vectors, by the sample."""
    model = Model(centroids, np.zeros((0, 0, 0)))
    of, asked = model.nearest_lists(m, 1)[:, 0], m[rng.choice(len(m), min(TRIALS, len(m)), replace=False)]
    place = np.argsort(model.nearest_lists(asked, len(centroids)), axis=1)  # of a list in a question's order
    near = np.argsort(-(asked @ m.T), axis=1, kind="stable")[:, :NEAR]
    return int(np.quantile(np.take_along_axis(place, of[near], 1), SHARE, method="higher")) + 1


def _assigned(batches, model):
    """(list, code) of vectors, with their keys and the vectors."""
    model = model.value
    for b in batches:
        m = matrix(b.column(1))
        at = model.nearest_lists(m, 1)[:, 0] if len(m) else np.zeros(0, np.int64)
        codes = model.encoded(m - model.centroids[at]) if len(m) else np.zeros((0, len(model.codes)), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(1)], names=["list", b.schema.names[0], "code", "embedding"])


@dataclass(frozen=True)
class VectorIndex:
    model: Model
    #: (list, part, key, code, embedding), sorted by list, so that a list is a few row groups
    rows: DataFrame
    #: (list, parts): into how many parts a list is cut
    lists: DataFrame
    key: str


def build(vectors: DataFrame, model: Model, key: str = "chunk_id", part_rows: int = PART_ROWS) -> VectorIndex:
    """Every vector in its list. Keys are unique and long or string; rows with a null vector are not indexed."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kind = T.StructType([T.StructField("list", T.IntegerType()), vectors.schema[key], T.StructField("code", T.BinaryType()), vectors.schema["embedding"]])
    coded = materialize(vectors.filter("embedding is not null").select(key, "embedding").mapInArrow(partial(_assigned, model=sent), kind), "coded")
    counts = coded.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    lists = materialize(counts.select("list", F.ceil(F.col("n") / part_rows).cast("int").alias("parts")), "lists")
    dealt = coded.join(F.broadcast(lists), "list").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int"))  # a row for each centroid
    rows = dealt.select("list", "part", key, "code", "embedding").repartitionByRange("list", "part", key).sortWithinPartitions("list", "part")
    return VectorIndex(model, materialize(rows, "vectors"), lists, key)


def _probed(batches, model, probes: int):
    """(query_id, list, embedding) for the lists to open for each question."""
    model = model.value
    for b in batches:
        if b.num_rows:
            m = matrix(b.column(1))
            near = model.nearest_lists(m, min(probes, len(model.centroids)))
            take = pa.array(np.repeat(np.arange(len(m)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(near.ravel().astype(np.int32)), b.column(1).take(take)], names=["query_id", "list", "embedding"])


def _ranker(model, key: str, keep: int):
    def rank(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The `keep` nearest codes of a part of a list for each question of a block: look-ups of the distances from the
        question's residual to all codes, summed over subspaces."""
        names = pa.schema([asked.schema.field("query_id"), rows.schema.field("list"), rows.schema.field("part"), rows.schema.field(key), pa.field("distance", pa.float64())])
        if not asked.num_rows or not rows.num_rows:
            return names.empty_table()
        m, at = model.value, rows.column("list")[0].as_py()
        residual = matrix(asked.column("embedding").combine_chunks()) - m.centroids[at]
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        distance = np.zeros((len(residual), len(codes)), np.float32)
        for s, part in enumerate(np.split(residual, codes.shape[1], axis=1)):
            table = (m.codes[s] ** 2).sum(1) - 2 * part @ m.codes[s].T + (part**2).sum(1)[:, None]
            distance += table.astype(np.float32)[:, codes[:, s]]
        n = min(keep, len(codes))
        near = np.argpartition(distance, n - 1, axis=1)[:, :n]
        take = pa.array(near.ravel())
        columns = [asked.column("query_id").take(pa.array(np.repeat(np.arange(len(residual)), n))), *[rows.column(c).take(take) for c in ("list", "part", key)], pa.array(np.take_along_axis(distance, near, 1).ravel().astype(np.float64))]
        return pa.Table.from_arrays(columns, schema=names)

    return rank


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """The cosine of two vectors, to nine digits, as the exact search has it."""
    return pa.array(np.round((matrix(a) * matrix(b)).sum(1), 9) if len(a) else [], pa.float64())


def opened(questions: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """(query_id, list, embedding): the lists that are read for each question."""
    sent = questions.sparkSession.sparkContext.broadcast(index.model)
    kind = T.StructType([questions.schema["query_id"], T.StructField("list", T.IntegerType()), questions.schema["embedding"]])
    return questions.filter("embedding is not null").select("query_id", "embedding").mapInArrow(partial(_probed, model=sent, probes=probes or index.model.probes), kind)


def search(questions: DataFrame, index: VectorIndex, k: int = 10, probes: int | None = None, rescore: int = RESCORE, block: int = BLOCK_QUESTIONS) -> DataFrame:
    """questions(query_id, embedding) -> (query_id, key, similarity, position, score), as dense_search, of vectors in the
    opened lists, by default as many as the model says. Similarities are exact; a near vector in a list that is not opened, or with too distant a code, is missed.
    """
    key, spark = index.key, questions.sparkSession
    sent = spark.sparkContext.broadcast(index.model)
    asked = materialize(opened(questions, index, probes), "probes")
    per_list = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    lists = index.lists.join(per_list, "list")  # a row for each centroid
    # every block of a list's questions meets every part of its rows
    left = asked.join(F.broadcast(lists), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    left = left.select("query_id", "list", "block", "embedding", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = index.rows.select("list", "part", key, "code").join(F.broadcast(lists.select("list", "blocks")), "list")
    right = right.select("list", "part", key, "code", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    kind = T.StructType([questions.schema["query_id"], T.StructField("list", T.IntegerType()), T.StructField("part", T.IntegerType()), index.rows.schema[key], T.StructField("distance", T.DoubleType())])
    on = ("list", "part", "block")
    near = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_ranker(sent, key, k * rescore), kind)
    w = W.partitionBy("query_id").orderBy("distance", key)
    best = materialize(near.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= k * rescore).select("query_id", "list", "part", key), "near")
    asks = questions.select("query_id", F.col("embedding").alias("_asked"))
    full = best.join(index.rows.select("list", "part", key, "embedding"), ["list", "part", key]).join(asks, "query_id")
    scored = full.select("query_id", key, cosine("_asked", "embedding").alias("similarity"))
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return scored.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).withColumn("score", F.greatest(F.lit(0.0), F.col("similarity")))


def rows_read(questions: DataFrame, index: VectorIndex, probes: int | None = None) -> DataFrame:
    """(query_id, n_read): vectors of the lists that are opened for each question."""
    sizes = index.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    return opened(questions, index, probes).join(sizes, "list").groupBy("query_id").agg(F.sum("n").alias("n_read"))


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(query_id, n_exact, n_found): how many of a question's exact results were found."""
    both = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("_hit")), ["query_id", key], "left")
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("_hit").alias("n_found"))
