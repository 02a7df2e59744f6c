"""Reranking with a given pair scorer, and confidence per question."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.routing import words
from ..functions.text import canonical_id, squeezed
from ..storage import materialize

# Fixed values of the service.
KEEP = 5
THRESHOLD = 0.70
#: Pairs that a scorer gets at a time.
PAIRS = 256
TRUSTED = ["structured_record", "identifier_exact", "identifier_fts"]


def pair_scores(rows: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], question: str = "question", text: str = "text") -> DataFrame:
    """rows with model_score, the scorer's value for each (question, text) pair, in batches."""

    @F.arrow_udf(T.DoubleType())
    def of(q: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([float(x) for x in scorer([(a or "", b or "") for a, b in zip(q.to_pylist(), t.to_pylist())])], type=pa.float64())

    return rows.withColumn("model_score", of(F.col(question), F.col(text)))


def scored_by_length(rows: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]], question: str = "question", text: str = "text", batch: int = PAIRS) -> DataFrame:
    """(pair, model_score, length, padded) of each distinct pair of rows. Pairs are dealt over tasks by length and scored in
    its order, so a model that pads a batch to its longest pair (`padded`) pads little; no pair is scored twice."""
    q, t = (F.coalesce(F.col(c), F.lit("")) for c in (question, text))
    pairs = rows.select(pair_key(q, t).alias("pair"), q.alias("q"), t.alias("t")).dropDuplicates(["pair"])
    pairs = pairs.withColumn("length", (F.length("q") + F.length("t")).cast("long"))

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                scores = scorer(list(zip(part.column(1).to_pylist(), part.column(2).to_pylist())))
                longest = max(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([float(x) for x in scores], pa.float64()), part.column(3), pa.array([longest] * part.num_rows, pa.int64())], names=["pair", "model_score", "length", "padded"])

    dealt = pairs.repartitionByRange("length", "pair").sortWithinPartitions("length", "pair")
    return materialize(dealt.mapInArrow(run, "pair string, model_score double, length long, padded long"), "scores")


def pair_key(question: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(question).cast("string"), F.lit(":"), question, text), 256)


def with_scores(rows: DataFrame, scores: DataFrame, question: str = "question", text: str = "text") -> DataFrame:
    """rows with model_score from scored_by_length, put back by the pair's key."""
    key = pair_key(F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return rows.withColumn("_pair", key).join(scores.select(F.col("pair").alias("_pair"), "model_score"), "_pair").drop("_pair")


def scoring_report(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(n_rows, n_pairs, padding): pairs asked and scored, and the share of a model's input that is padding."""
    made = scores.agg(F.count(F.lit(1)).alias("n_pairs"), (1 - F.try_divide(F.sum("length"), F.sum("padded"))).alias("padding"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(made)  # one row each


def is_exact(identifiers: Column, text: Column, identifier: Column, ps_code: Column, origin: Column) -> Column:
    """Whether the chunk carries one of the identifiers, or holds it and comes from an identifier strategy."""
    own, code = (F.upper(F.translate(F.coalesce(c, F.lit("")), " ", "")) for c in (identifier, ps_code))
    inside, trusted = squeezed(F.coalesce(text, F.lit(""))), origin.isin(TRUSTED)
    return F.coalesce(F.exists(F.transform(identifiers, canonical_id), lambda x: (x == own) | (x == code) | (inside.contains(x) & trusted)), F.lit(False))


def rerank(rows: DataFrame, keep: int = KEEP) -> DataFrame:
    """rows(query_id, rank, chunk_id, is_exact, model_score) -> the first `keep` with their new score and rank.

    Exact rows come first, in their old order, with score 1; the others by model score, scaled to 0..1 within the
    question (a range of zero counts as one), to four decimals.
    """
    w = W.partitionBy("query_id", "is_exact")
    low, high = F.min("model_score").over(w), F.max("model_score").over(w)
    scaled = F.round((F.col("model_score") - low) / F.when(high == low, 1.0).otherwise(high - low), 4)
    scored = rows.withColumn("score", F.when(F.col("is_exact"), 1.0).otherwise(scaled))
    order = W.partitionBy("query_id").orderBy(F.desc("is_exact"), F.when(~F.col("is_exact"), -F.col("model_score")), "rank", "chunk_id")
    return scored.withColumn("new_rank", F.row_number().over(order)).filter(F.col("new_rank") <= keep).drop("rank").withColumnRenamed("new_rank", "rank")


def confidence(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """questions(query_id, question, intent), rows(query_id, rank, score, has_id, origin) -> (query_id, confidence)."""
    per = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("score", "rank").alias("top"),
        F.avg(F.when(F.col("rank") <= 5, F.col("score"))).alias("mean"),
        F.bool_or("has_id").alias("exact"),
        F.bool_or(F.col("has_id") & (F.col("origin") == "structured_record")).alias("record"),
    )
    value = (F.col("top") * 0.6 + F.col("mean") * 0.4) * F.when(F.col("n") == 1, 0.85).when(F.col("n") == 2, 0.92).otherwise(1.0)
    brief = (F.size(words(F.col("question"))) <= 2) & (F.col("top") > 0.5)
    value = F.when(brief, F.greatest(value, F.lit(0.80))).otherwise(value)
    value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4)
    out = F.when(F.col("n").isNull(), 0.0).when(F.col("intent") == "image_note", 0.92).when(F.col("record"), 0.98).when(F.col("exact"), 0.95).otherwise(value)
    return questions.join(per, "query_id", "left").select("query_id", out.alias("confidence"))


def answer_type(confidence_col: Column, n_rows: Column, threshold: float = THRESHOLD) -> Column:
    enough = (F.coalesce(n_rows, F.lit(0)) > 0) & (confidence_col >= threshold)
    return F.when(enough, "dataset").otherwise("general_knowledge")
