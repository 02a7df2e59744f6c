"""Stored keyword and vector indexes against the exact searches."""

import random

import numpy as np
import pytest
from corpus_jobs.operators import dense, keyword, keyword_index, vector_index
from corpus_jobs.storage import materialize
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def texts(n, seed=1):
    """Few very common words, many rare ones, some repeated phrases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        body = [words[min(int(rng.paretovariate(0.7)) - 1, 399)] for _ in range(rng.randrange(1, 60))]
        if i % 17 == 0:
            body += "the running rivers ran by the mill".split()
        out.append((f"c{i}", f"d{i % 9}", " ".join(body) if i % 50 else None, f"file{i % 7}.txt"))
    return out


QUESTIONS = [
    (1, "w0"), (2, "w0 w1 w2"), (3, "w0 w200 w1"), (4, "running rivers"), (5, "the running rivers ran by the mill"), (6, "never said"), (7, ""), (8, None),
    (9, "w0 w0"), (10, "w1 w0 w1"), (11, "w5 the the"), (12, "w399 w398 w0 w1 w2 w3"), (13, "file3 txt"), (14, "d4"), (15, "w0 unknownword"),
]


@pytest.mark.parametrize("stemmed,block,k", [(False, 4, 1), (True, 16, 10)])
def test_indexed_search_is_the_plain_one(spark, stemmed, block, k):
    chunks = spark.createDataFrame(texts(900), "chunk_id string, document_id string, text string, file_name string").repartition(5)
    asked = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    index = keyword_index.build(chunks, stemmed=stemmed, block=block)
    plain = materialize(keyword.index(chunks, stemmed), "index")
    assert index.terms.filter("frequent").count() > 0
    columns = ("query_id", "position", "chunk_id", "rank", "score")
    assert rows(keyword_index.phrase_search(asked, index, k), *columns) == rows(keyword.phrase_search(asked, plain, k, stemmed), *columns)
    assert rows(keyword_index.any_term_search(asked, index, k), *columns) == rows(keyword.any_term_search(asked, plain, k, stemmed), *columns)


def test_index_reads_less_than_it_stores(spark):
    """Rare terms decide; the common word beside them is read in few blocks."""
    chunks = spark.createDataFrame([(f"c{i}", "", "common " * (1 + i % 3) + f"filler{i} " * 5 + (f"rare{i % 40} " * 3 if i < 800 else ""), "") for i in range(4000)], "chunk_id string, document_id string, text string, file_name string")
    index = keyword_index.build(chunks, stemmed=False, block=16)
    asked = spark.createDataFrame([(i, f"common rare{i}") for i in range(10)], "query_id long, question string")
    for r in keyword_index.postings_read(asked, index).collect():
        assert r["n_stored"] == 4020 and r["n_read"] < 500


def test_index_keeps_no_term_in_one_bucket(spark):
    chunks = spark.createDataFrame([(f"c{i}", "", "everywhere", "") for i in range(3000)], "chunk_id string, document_id string, text string, file_name string")
    index = keyword_index.build(chunks, stemmed=False)
    files = index.often.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 2500
    assert "Exchange" not in index.often.groupBy("term", "block").count()._jdf.queryExecution().executedPlan().toString()


def test_empty_index(spark):
    chunks = spark.createDataFrame([], "chunk_id string, document_id string, text string, file_name string")
    index, asked = keyword_index.build(chunks), spark.createDataFrame(QUESTIONS, "query_id long, question string")
    assert keyword_index.any_term_search(asked, index).collect() == keyword_index.phrase_search(asked, index).collect() == []


def clustered(n, dims=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    of = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 40, n))  # a third around one centre
    return [(i, (centres[c] + 0.4 * rng.normal(size=dims)).tolist()) for i, c in enumerate(of)]


def test_vector_index_finds_nine_in_ten(spark):
    data = clustered(6000)
    v = spark.createDataFrame([*data, (6000, None)], "vec_id long, embedding array<float>").repartition(6)
    asked = v.filter("vec_id % 100 = 0 and vec_id < 6000").select(F.col("vec_id").alias("query_id"), "embedding")
    model = vector_index.fit(v, "vec_id", subspaces=8, sample=2000)
    index = vector_index.build(v, model, "vec_id", part_rows=300)
    assert index.rows.count() == 6000 and index.rows.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 450
    found = materialize(vector_index.search(asked, index, block=7), "found")
    exact = {(r["query_id"], r["vec_id"]): (r["position"], r["similarity"]) for r in dense.dense_search(asked, v, "vec_id").collect()}
    got = {(r["query_id"], r["vec_id"]): r["similarity"] for r in found.collect()}
    assert len(got) == len(exact) == 600
    assert sum(x in got for x in exact) >= 0.9 * len(exact)
    assert all(abs(got[x] - exact[x][1]) < 1e-9 for x in got if x in exact)  # scores are exact
    share = vector_index.recall(found, dense.dense_search(asked, v, "vec_id"), "vec_id").agg(F.sum("n_found"), F.sum("n_exact")).first()
    assert share[0] == sum(x in got for x in exact) and share[1] == 600
    read = vector_index.rows_read(asked, index).agg(F.avg("n_read")).first()[0]
    assert read < 6000 / 2
    everything = vector_index.search(asked, index, probes=10_000, rescore=600)
    assert rows(everything, "query_id", "vec_id", "position", "similarity") == sorted((q, x, p, round(s, 6)) for (q, x), (p, s) in exact.items())


def test_vector_index_of_nothing_and_of_few(spark):
    kind = "vec_id string, embedding array<float>"
    assert vector_index.fit(spark.createDataFrame([], kind), "vec_id") is None
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b2", [0.0, 1.0]), ("z", [0.0, 0.0])], kind)
    index = vector_index.build(few, vector_index.fit(few, "vec_id", subspaces=2), "vec_id")
    got = vector_index.search(few.select(F.col("vec_id").alias("query_id"), "embedding"), index, k=2).collect()
    assert sorted((r["query_id"], r["position"], r["vec_id"]) for r in got) == [("a", 1, "a"), ("a", 2, "b"), ("b", 1, "b"), ("b", 2, "b2"), ("b2", 1, "b"), ("b2", 2, "b2"), ("z", 1, "a"), ("z", 2, "b")]


def test_dense_search_is_all_pairs(spark):
    """Ties by key, blocks of questions, keys as text, null vectors."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    data = [(f"v{i}", base[i % 40].tolist()) for i in range(200)] + [("none", None)]
    v = spark.createDataFrame(data, "key string, embedding array<float>").repartition(5)
    asked = v.filter("key <> 'none'").select(F.col("key").alias("query_id"), "embedding").limit(50)
    m = np.array([x for _, x in data[:-1]], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = []
    for q in asked.collect():
        x = np.array(q["embedding"], dtype=float)
        s = np.round(m @ (x / np.linalg.norm(x)), 9)
        best = sorted((-v, k) for v, (k, _) in zip(s.tolist(), data))[:7]
        want += [(q["query_id"], i + 1, k) for i, (_, k) in enumerate(best)]
    for block in (4096, 9):
        got = dense.dense_search(asked, v, "key", k=7, block=block).collect()
        assert sorted((r["query_id"], r["position"], r["key"]) for r in got) == sorted(want)
