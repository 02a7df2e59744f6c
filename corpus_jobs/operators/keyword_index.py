"""A stored keyword index: postings written once, bucketed, with the largest contribution of each frequent term in every
block of chunks, so that searches read only the blocks that can still change a question's best chunks.

Chunks are dealt into blocks of about BLOCK. A term is frequent if it has at least OFTEN postings a block on average; there
are at most BLOCK / OFTEN times as many frequent terms as a chunk has distinct terms on average, whatever the table, so
that set may be broadcast. Five tables, all joined by equality:

    rare     term, block, chunk_id, scope, n_tokens, tf, places     of the other terms; bucketed by term
    often    the same of frequent terms; bucketed by term and block, so that no task gets all of a common word
    maxima   term, block, best     the largest part of a frequent term in a block; bucketed alike
    terms    term, df, frequent, best
    totals   n_rows, mean_len     one row

A part is a posting's BM25 contribution before the term's idf. places are column * 2**32 + position. scope is a collection that
the chunk is in, if the index is built with one: phrases may be asked of one collection.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..storage import materialize, new_path
from .keyword import B, COLUMNS, K1, LEAST_IDF, analysed, best_rows, stem_lists, token_lists

BLOCK, OFTEN = 64, 4
#: Blocks that are scored first for each question, as a multiple of k.
FIRST = 1
#: Postings of a bucket; a larger index has more buckets.
BUCKET_ROWS = 4_000_000
COLUMN = 1 << 32
#: Sums of the same parts in another order differ by less; bounds are taken that much higher.
SLACK = 1e-6

TABLES = ("rare", "often", "maxima", "terms")


@dataclass(frozen=True)
class Index:
    rare: DataFrame
    often: DataFrame
    maxima: DataFrame
    terms: DataFrame
    n_rows: int
    mean_len: float
    stemmed: bool

    def part(self) -> Column:
        return contribution(F.col("tf"), F.col("n_tokens"), self.mean_len)

    def idf(self) -> Column:
        return F.greatest(F.lit(LEAST_IDF), F.ln((self.n_rows - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def contribution(tf: Column, n_tokens: Column, mean_len: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / F.lit(mean_len)))


def _postings(batches, stemmed: bool):
    """(chunk_id, scope, n_tokens, term, places): a row for each term of a chunk, gathered without a shuffle, and one without a term
    for the chunk itself."""
    for b in batches:
        for low in range(0, b.num_rows, 1000):
            part = b.slice(low, 1000)
            words = [token_lists(part.column(c)) for c in range(2, part.num_columns)]
            words = [stem_lists(w) for w in words] if stemmed else words
            rows, lengths, terms, places, ends = [], [], [], [], [0]
            for i, values in enumerate(zip(*words)):
                mine: dict[str, list[int]] = {}
                for col, toks in enumerate(values):
                    for pos, t in enumerate(toks, col * COLUMN):
                        if t in mine:
                            mine[t].append(pos)
                        else:
                            mine[t] = [pos]
                terms.append(None)
                ends.append(len(places))
                for t, at in mine.items():
                    terms.append(t)
                    places += at
                    ends.append(len(places))
                rows += [i] * (len(mine) + 1)
                lengths += [sum(map(len, values))] * (len(mine) + 1)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int64()))
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(lengths, pa.int32()), pa.array(terms, pa.string()), lists], names=["chunk_id", "scope", "n_tokens", "term", "places"])


def build(chunks: DataFrame, name: str | None = None, stemmed: bool = True, columns: tuple[str, ...] = COLUMNS, block: int = BLOCK, scope: str | None = None) -> Index:
    """Writes the index of chunks(chunk_id, *columns) as tables of the session's catalogue, `name`_rare and so on, in the shared
    folder. Chunk ids are unique and not null; the texts of columns may be null or empty. `scope` is a column with the
    collection that a chunk is in."""
    spark, name = chunks.sparkSession, name or f"index_{uuid.uuid4().hex}"
    texts = chunks.select("chunk_id", (F.col(f"`{scope}`") if scope else F.lit(None).cast("string")).alias("scope"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(f"_{i}") for i, c in enumerate(columns)])
    kind = T.StructType([chunks.schema["chunk_id"], T.StructField("scope", texts.schema["scope"].dataType), T.StructField("n_tokens", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("places", T.ArrayType(T.LongType()))])
    rows = materialize(texts.mapInArrow(partial(_postings, stemmed=stemmed), kind), "postings")
    totals = materialize(rows.filter("term is null").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.avg("n_tokens"), F.lit(1.0)).alias("mean_len")), "totals")
    known = totals.first()
    blocks = max(1, -(-known["n_rows"] // block))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (rows.count() - known["n_rows"]) // BUCKET_ROWS)
    part = contribution(F.col("tf"), F.col("n_tokens"), known["mean_len"])
    posts = rows.filter("term is not null").select("term", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).alias("block"), "chunk_id", "scope", "n_tokens", F.size("places").alias("tf"), "places")
    terms = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(part).alias("best"))
    terms = materialize(terms.withColumn("frequent", F.col("df") >= OFTEN * blocks), "terms")
    frequent = F.broadcast(terms.filter("frequent").select("term"))  # bounded, see above

    def stored(df: DataFrame, table: str, *keys: str) -> DataFrame:
        df = df.repartition(buckets, *keys)  # a bucket is one file
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark, table)).saveAsTable(f"{name}_{table}")
        return spark.table(f"{name}_{table}")

    stored(posts.join(frequent, "term", "left_anti"), "rare", "term")
    often = stored(posts.join(frequent, "term", "left_semi"), "often", "term", "block")
    stored(often.groupBy("term", "block").agg(F.max(part).alias("best")), "maxima", "term", "block")
    stored(terms, "terms", "term")
    totals.write.option("path", new_path(spark, "totals")).saveAsTable(f"{name}_totals")
    return opened(spark, name, stemmed)


def opened(spark: SparkSession, name: str, stemmed: bool = True) -> Index:
    """The index that was built under a name, with the same stemming."""
    totals = spark.table(f"{name}_totals").first()
    return Index(*[spark.table(f"{name}_{t}") for t in TABLES], totals["n_rows"], totals["mean_len"], stemmed)


def phrase_search(questions: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """keyword.phrase_search over a stored index: the same rows. If the questions have a column `scope`, each is asked of
    the chunks of its collection only.

    The places of a question's rarest term are held against those of its next rarest, and what is left against the
    others; each of these joins is by term and block, or by term where a term is rare, and reads nothing else.
    """
    within = ["scope"] if "scope" in questions.columns else []
    asked = questions.select("query_id", *within, analysed(F.col("question"), index.stemmed).alias("q")).filter(F.size("q") > 0)
    words = asked.select("query_id", *within, F.size("q").alias("n"), F.posexplode("q").alias("off", "term"))
    # sorted, as Spark sizes the words as the questions they are split from, and could broadcast too many
    words = words.hint("merge").join(index.terms.select("term", "df", "frequent"), "term")
    order = W.partitionBy("query_id").orderBy("df", "off")
    words = words.withColumns({"no": F.row_number().over(order), "known": F.count(F.lit(1)).over(W.partitionBy("query_id"))})
    words = materialize(words.filter("known = n").drop("known", "df"), "words")  # a question with an unknown word finds nothing
    posts = ["term", "block", "chunk_id", "n_tokens", "places"]
    common = F.broadcast(words.filter("frequent").select("term").distinct())  # some of the index's frequent terms, which are few
    often_asked = index.often.join(common, "term", "left_semi")

    def both(frequent_on: list[str], rare_on: list[str], left: DataFrame) -> DataFrame:
        new = [c for c in posts if c not in left.columns]
        rare = left.filter("not frequent").join(index.rare.select(*rare_on, *new), rare_on)
        often = left.filter("frequent").join(often_asked.select(*frequent_on, *new), frequent_on)
        return rare.unionByName(often)

    first = both(["term", *within], ["term", *within], words.filter("no = 1"))
    places = first.select("query_id", "block", "chunk_id", "n_tokens", "off", F.explode("places").alias("at"))
    starts = places.filter(F.col("at") % COLUMN >= F.col("off")).select("query_id", "block", "chunk_id", "n_tokens", (F.col("at") - F.col("off")).alias("start"))

    def holding(starts: DataFrame, others: DataFrame) -> DataFrame:
        """The starts at which all the other words of the question stand in their place."""
        asks = starts.hint("merge").join(others.select("query_id", "term", "off", "frequent"), "query_id")
        met = both(["term", "block", "chunk_id"], ["term", "chunk_id"], asks).filter(F.array_contains("places", F.col("start") + F.col("off")))
        n = others.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
        seen = met.groupBy("query_id", "block", "chunk_id", "n_tokens", "start").agg(F.count(F.lit(1)).alias("seen"))
        return seen.join(n, "query_id").filter("seen = wanted").drop("seen", "wanted")

    starts = materialize(starts, "starts")
    one = starts.join(words.filter("n = 1").select("query_id").distinct(), "query_id", "left_semi")
    two = materialize(holding(starts, words.filter("no = 2")), "starts")
    pairs = two.join(words.filter("n = 2").select("query_id").distinct(), "query_id", "left_semi")
    found = one.unionByName(pairs).unionByName(holding(two, words.filter("no > 2")))
    hits = materialize(found.groupBy("query_id", "chunk_id", "n_tokens").agg(F.count(F.lit(1)).alias("tf")), "hits")
    df = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "query_id").select("query_id", "chunk_id", (-index.idf() * index.part()).alias("rank"))
    return best_rows(scored, k)


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, least): the k-th best score of a question, for those that have k."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"))
    best = scores.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= k)
    return best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select("query_id", "least")


@dataclass(frozen=True)
class Reads:
    """What a search takes from the index: (query_id, block) pairs that it scores, and the terms asked."""

    asked: DataFrame
    pairs: DataFrame
    scores: DataFrame


def _any_term(questions: DataFrame, index: Index, k: int) -> Reads:
    asked = questions.select("query_id", F.explode(F.array_distinct(analysed(F.col("question"), index.stemmed))).alias("term"))
    asked = materialize(asked.join(index.terms, "term").select("query_id", "term", "frequent", "best", index.idf().alias("idf")), "asked")
    often = asked.filter("frequent").select("query_id", "term", "idf")
    # chunks with a rare term, and the score that k of them reach without the frequent ones
    rare = asked.filter("not frequent").select("query_id", "term", "idf").join(index.rare.select("term", "block", "chunk_id", index.part().alias("part")), "term")
    rare_scores = materialize(rare.groupBy("query_id", "block", "chunk_id").agg(F.sum(F.col("idf") * F.col("part")).alias("score")), "partial")
    loose = asked.filter("frequent").groupBy("query_id").agg(F.sum(F.col("idf") * F.col("best")).alias("loose"))
    sure = loose.join(_kth(rare_scores, k), "query_id").filter(F.col("least") > F.col("loose") + SLACK).select("query_id", "least", "loose")
    sure = materialize(sure, "sure")  # no chunk without a rare term can be among the best of these
    most = rare_scores.groupBy("query_id", "block").agg(F.max("score").alias("bound"))
    near = most.join(sure, "query_id").filter(F.col("bound") + F.col("loose") + SLACK >= F.col("least")).select("query_id", "block")
    maxima = index.maxima.select("term", "block", "best")
    wide = often.join(sure, "query_id", "left_anti").join(maxima, "term")
    narrow = near.join(often, "query_id").join(maxima, ["term", "block"])
    add = [x.select("query_id", "block", (F.col("idf") * F.col("best")).alias("bound")) for x in (wide, narrow)]
    own = most.join(sure, "query_id", "left_anti").unionByName(most.join(near, ["query_id", "block"], "left_semi"))
    bounds = own.unionByName(add[0]).unionByName(add[1]).groupBy("query_id", "block").agg(F.sum("bound").alias("bound"))
    w = W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = materialize(bounds, "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        """Whole scores of all chunks of these blocks that hold any asked term."""
        more = pairs.join(often, "query_id").join(index.often.select("term", "block", "chunk_id", index.part().alias("part")), ["term", "block"])
        parts = rare_scores.join(pairs, ["query_id", "block"], "left_semi").select("query_id", "chunk_id", "score")
        both = parts.unionByName(more.select("query_id", "chunk_id", (F.col("idf") * F.col("part")).alias("score")))
        return both.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))

    # the blocks with the highest bounds give a k-th score, which most others cannot reach
    first = materialize(bounds.withColumn("no", F.row_number().over(w)).filter(F.col("no") <= FIRST * k).select("query_id", "block", "bound"), "first")
    early = materialize(scored(first.select("query_id", "block")), "early")
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(_kth(early, k), "query_id", "left")
    rest = materialize(rest.filter(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "block"), "rest")
    return Reads(asked, first.select("query_id", "block").unionByName(rest), early.unionByName(scored(rest)))


def any_term_search(questions: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """keyword.any_term_search over a stored index: the same rows, exactly.

    A question's rare terms are read whole. If k chunks already score more than all its frequent terms could add, only
    blocks with a rare term are looked at. Bounds of blocks come from the maxima; the blocks with the highest bounds are
    scored first, and of the others only those whose bound reaches the k-th score found there. A chunk lies in one block,
    so all its terms are read or none of the frequent ones.
    """
    scores = _any_term(questions, index, k).scores
    return best_rows(scores.select("query_id", "chunk_id", (-F.col("score")).alias("rank")), k)


def postings_read(questions: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """(query_id, n_read, n_stored): postings that any_term_search reads for a question, and those stored of its terms."""
    reads = _any_term(questions, index, k)
    stored = reads.asked.join(index.terms.select("term", "df"), "term").groupBy("query_id").agg(F.sum("df").alias("n_stored"), F.sum(F.when(~F.col("frequent"), F.col("df")).otherwise(0)).alias("n_rare"))
    often = reads.asked.filter("frequent").select("query_id", "term")
    read = reads.pairs.join(often, "query_id").join(index.often.select("term", "block"), ["term", "block"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return stored.join(read, "query_id", "left").select("query_id", (F.col("n_rare") + F.coalesce("n", F.lit(0))).alias("n_read"), "n_stored")
