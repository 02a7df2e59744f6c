"""Ranked lexical search: the documents that score highest for each of a table of items, exactly.

The items are taken in blocks of bounded text. One pass over the documents keeps, for each, its length and the counts of
the block's terms; the counts of documents by term follow from that. A second pass goes over these rows only. A task
turns a run of rows into posting lists and works through an item's terms one at a time, rarest first. Each new document
gets an accumulator until the bounds of the terms that remain add up to less than the k-th partial score (or the k-th
score of the task's earlier runs), so that a document without one cannot come among the best; from there on only
documents that have one are updated, exactly. Each task gives k rows an item, and the best of these are the result.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import as_bytes, documents, materialize, release, sliced
from .decontamination import blocks

BEST = 50
#: Rows of which a task makes posting lists at a time.
RUN = 16_384
#: Bytes of a text outside terms become spaces, A-Z become a-z; bytes beyond ASCII belong to terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])


def terms(text: str | None) -> list[bytes]:
    """The runs of letters and digits of ASCII and of anything beyond it, with A-Z in lower case."""
    return as_bytes(text).translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n: int, n_docs: int, all_terms: int) -> int:
    """A document's length factor; its products pass 64 bits on large tables, so they are Python's."""
    return 100 - 50 + (50 * n * n_docs) // all_terms


def _counted(batches, numbers):
    """(doc_id, n, terms, counts) of the rows with at least one term: which of the numbered terms a text has, and how often."""
    get = numbers.value.get
    for b in sliced(batches, 200):
        ids, ns, keys, values, ends = [], [], [], [], [0]
        for d, t in zip(b.column(0).to_pylist(), b.column(1)):
            found = terms(t.as_py())
            if found:
                c = Counter(map(get, found))
                c.pop(None, None)
                ids.append(d)
                ns.append(len(found))
                keys.extend(c.keys())
                values.extend(c.values())
                ends.append(len(keys))
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (keys, values)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], schema=_COUNTS)
    release()


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by ascending id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        take = scores >= least
        ids, scores = ids[take], scores[take]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, least: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, accumulators) of the rows that may be among the k best of an item.

    lists: for each of its terms, rarest first, the rows that hold it and what it adds to each. No row with a score under
    `least` needs to come out. While the bounds of the terms from here on reach both `least` and the k-th partial score,
    rows without an accumulator may still get there, and get one.
    """
    bounds = [int(add.max()) if len(add) else 0 for _, add in lists]
    rest = sum(bounds)
    partial_score, has, made, open_ = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), 0, True
    for (rows, add), bound in zip(lists, bounds):
        if open_:
            kth = least
            if made >= k and rest < partial_score.max():
                kth = max(kth, int(np.partition(partial_score[has], made - k)[made - k]))
            open_ = rest >= kth
        if open_:
            has[rows] = True
            made = int(np.count_nonzero(has))
        else:
            kept = has[rows]
            rows, add = rows[kept], add[kept]
        partial_score[rows] += add  # a row is once in a list
        rest -= bound
    found = np.flatnonzero(has)
    return found, partial_score[found], made


def _runs(batches):
    """(ids, ns, lengths, terms, counts) of runs of rows."""
    held, rows = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= RUN:
            yield held
            held, rows = [], 0
    if held:
        yield held


def _ranked(batches, block, k: int):
    """(item, doc_id, score): the k best rows of the task for each item. Rows without an id come after all others."""
    items, weights, n_docs, all_terms = block.value
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
    for held in _runs(batches):
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("doc_id").to_numpy() if not table.column("doc_id").null_count else np.array([np.iinfo(np.int64).max if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        lists = table.column("terms").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        keys, tf = lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        m = np.array([norm(n, n_docs, all_terms) for n in table.column("n").to_pylist()], np.int64)
        rows = np.repeat(np.arange(len(ids)), lengths)
        add = weights[keys] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[rows]))
        order = np.argsort(keys, kind="stable")
        keys, rows, add = keys[order], rows[order], add[order]
        starts = np.searchsorted(keys, np.arange(len(weights) + 1))
        for i, mine in enumerate(items):
            least = int(best[i][1][-1]) if len(best[i][1]) == k else 0
            got, scores, _ = accumulate([(rows[starts[t] : starts[t + 1]], add[starts[t] : starts[t + 1]]) for t in mine], len(ids), k, least)
            able = scores > 0
            best[i] = _best(np.concatenate([best[i][0], ids[got[able]]]), np.concatenate([best[i][1], scores[able]]), k)
    for i, (ids, scores) in enumerate(best):
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(scores)], names=["item", "doc_id", "score"])
    release()


def _of_block(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, k: int) -> DataFrame:
    """(item_id, doc_id, score): at least the k best rows for each item of a block, a few more from other tasks."""
    spark = docs.sparkSession
    asked = [(key, list(dict.fromkeys(terms(text)))) for key, text in items]
    numbers = {t: n for n, t in enumerate(dict.fromkeys(t for _, mine in asked for t in mine))}
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    sent = spark.sparkContext.broadcast(numbers)  # no more than the block's text, whose size is bounded
    counts = materialize(rows.mapInArrow(partial(_counted, numbers=sent), "doc_id long, n long, terms array<int>, counts array<int>"), "term-counts")
    all_ = counts.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n")).first()
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # at most a row for each term of the block
    weights = np.array([weight(all_["n_docs"], df.get(n, 0)) for n in range(len(numbers))] or [0], np.int64)
    order = [sorted((numbers[t] for t in mine if numbers[t] in df), key=lambda n: (df[n], n)) for _, mine in asked]
    block = spark.sparkContext.broadcast((order, weights, all_["n_docs"], all_["n"] or 1))  # bounded by the block's text as well
    kind = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = counts.mapInArrow(partial(_ranked, block=block, k=k), kind)
    names = spark.createDataFrame([(n, key) for n, (key, _) in enumerate(asked)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", T.LongType())]))
    return found.join(names, "item").select("item_id", "item", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k rows of docs with the highest scores above 0, equal ones by ascending id.

    A null or empty text, or one without a term, is found by nothing and not counted; an item of that kind finds nothing. Rows
    with one id are rows of their own, as many as there are, and rows without an id come after others of the same score.
    Items with one id are ranked each on their own. Ids are whole numbers. Empty tables give no rows. All other columns
    are left alone. With one block of items the documents are read once, with more once for each.
    """
    out = None
    for block in blocks(items, item_col, item_text):
        one = _of_block(docs, block, id_col, text_col, k)
        w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else materialize(out, "ranked").unionByName(ranked)
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""WITH d AS (SELECT doc_id, {_TERMS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0), a AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
    t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM f, a),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l)))) AS BIGINT) AS score
          FROM q JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc_id), a GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {BEST}"""
