"""Mixing sources to target weights: every document is taken a whole number of times, so that the words of each source
come near a target.

Words are summed by source. Weights repeat over the sources in order and share a percentage of all words; a source is
never asked for more than a multiple of what it has, and what that leaves over is shared again by weight. A source's
target over its words is the rate of its documents: each is taken floor(rate) times, and once more if a number drawn from
the hash of its id is below the fraction. Everything is a DataFrame operation; the driver sees one row of sums a round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import row_numbers
from .common import documents, fresh, materialize

#: Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
SEED = "mix"


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1, the same for the same key and seed, from the first 52 bits of a hash."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(2.0**52)


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """sources(source, source_size), a row each -> with target, in words.

    Sources by code point, null last, have the weights in turn. The shares of `percent` of all words are cut at `most`
    times a source's own words, and the excess goes to the others by weight until no share is above. Each round is one sum
    over the table of sources.
    """
    ranked = row_numbers(sources.withColumns({"_all": F.lit(0), "_null": F.col("source").isNull()}), "_all", ["_null", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    limit = F.lit(most) * F.col("source_size").cast("double")
    first = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, capped, shared = first["size"] or 0, 0, first["weight"] or 0
    while shared:  # as the rest grows, sources above their limit stay above it
        share = F.col("weight") * F.lit(percent * total - 100 * most * capped).cast("long") / F.lit(100 * shared).cast("long")
        over = share > limit
        found = table.agg(F.sum(F.when(over, F.col("source_size"))).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if (found["size"] or 0, found["weight"] or 0) == (capped, shared):
            return table.select("source", "source_size", F.when(over, limit).otherwise(share).alias("target"))
        capped, shared = found["size"] or 0, found["weight"] or 0
    return table.select("source", "source_size", limit.alias("target"))  # more is asked for than all limits together


def planned(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs, all their rows and columns, with a struct column `name` of size, source_size, target and copies.

    A null text has size 0, and so has one without a word; null is a source of its own, and so is the empty string. Rows
    with one id are drawn alike, and so are rows without an id. A source without words has the target 0 and its documents
    0 copies. An empty table stays empty. `name` must not be a column of docs; docs may have any other columns.
    """
    source, size = F.col(f"`{source_col}`"), n_words(F.col(f"`{text_col}`"))
    by_source = docs.select(source.alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    # written, so Spark knows its size: sent to all tasks below its own threshold, else joined by a shuffle
    goal = materialize(targets(by_source, weights, percent, most), "targets").select(F.struct("source", "source_size", "target").alias(name))
    joined = docs.join(goal, source.eqNullSafe(F.col(f"`{name}`.source")), "left")
    at = F.col(f"`{name}`")
    rate = at["target"] / F.nullif(at["source_size"], F.lit(0))
    more = (draw(F.col(f"`{id_col}`"), seed) < rate - F.floor(rate)).cast("long")
    copies = F.coalesce(F.floor(rate).cast("long") + more, F.lit(0).cast("long"))
    return joined.withColumn(name, F.struct(size.alias("size"), at["source_size"].alias("source_size"), at["target"].alias("target"), copies.alias("copies")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken; options as those of planned."""
    name = fresh(docs, "mix")
    rows = planned(docs, name, **options).filter(F.col(f"`{name}`.copies") > 0)
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"`{name}`.copies")))).drop(name)


def op12_source_mixing(spark, sf_dir: str) -> DataFrame:
    rows = planned(documents(spark, sf_dir), "mix")
    return rows.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


#: The limits are found in one pass: sources in the order of limit over weight, those before the first that keeps within
#: its limit are cut.
SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 {" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))} END AS weight FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS i FROM w),
    c AS (SELECT *, CAST({PERCENT} * sum(source_size) OVER () - {100 * MOST} * (sum(source_size) OVER (ORDER BY i) - source_size) AS BIGINT) AS rest, CAST(100 * sum(weight) OVER (ORDER BY i DESC) AS BIGINT) AS shared FROM o),
    f AS (SELECT rest, shared FROM c WHERE weight * rest / shared <= {MOST} * CAST(source_size AS DOUBLE) ORDER BY i LIMIT 1),
    t AS (SELECT source, source_size, least({MOST} * CAST(source_size AS DOUBLE), weight * rest / shared) AS target FROM w, f),
    r AS (SELECT doc_id, size, source_size, target, target / nullif(source_size, 0) AS rate, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, CAST(size * coalesce(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END, 0) AS BIGINT) AS taken FROM r"""
