"""Windows over ranges against plain windows, with a group that holds most rows."""

import random

import pytest
from corpus_jobs import ranges
from corpus_jobs.functions import routing
from corpus_jobs.operators import catalog, conversations, retrieval
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(5)
    data = []
    for i in range(1500):
        conv = "huge" if i % 5 else rng.choice(["a", "b", "c", None, ""])
        data.append((conv, rng.randrange(200), i, rng.choice(["user", "assistant"]), f"line {i} " + (f"SIH {10000 + i}" if rng.random() < 0.1 else "")))
    return spark.createDataFrame(data, "conversation_id string, created_at long, seq long, role string, content string").repartition(6)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_history_of_a_huge_conversation(messages, many_parts):
    got = {r["seq"]: (r["last_id"], r["history"]) for r in routing.with_history(messages).collect()}
    rows = sorted(messages.collect(), key=lambda r: (r["created_at"], r["seq"]))
    by: dict = {}
    for r in rows:
        by.setdefault(r["conversation_id"], []).append(r)
    assert len(got) == len(rows)
    for mine in by.values():
        for i, r in enumerate(mine):
            last = mine[max(0, i - 10) : i]
            ids = [x["content"].split("SIH ")[1] for x in last if "SIH " in x["content"]]
            history = "\n".join(("User" if x["role"] == "user" else "Assistant") + ": " + x["content"] for x in last)
            assert got[r["seq"]] == (f"SIH{ids[-1]}" if ids else None, history)


def test_no_part_is_long(messages, many_parts):
    rows = ranges.with_rows_before(messages, "conversation_id", ["created_at", "seq"], 10)
    sizes = [r["count"] for r in rows.groupBy("_part", "conversation_id").count().collect()]
    assert max(sizes) < 1500 / 23 * 3
    assert rows.filter("not _before").count() == 1500


@pytest.mark.parametrize("n", [1, 7, 300])
def test_rows_before_reach_over_several_parts(messages, many_parts, n):
    w = W.partitionBy("_part", "conversation_id").orderBy("created_at", "seq").rowsBetween(-n, -1)
    plain = W.partitionBy("conversation_id").orderBy("created_at", "seq").rowsBetween(-n, -1)
    got = ranges.with_rows_before(messages, "conversation_id", ["created_at", "seq"], n).withColumn("x", F.sum("seq").over(w)).filter("not _before")
    assert sorted(map(tuple, got.select("seq", "x").collect())) == sorted(map(tuple, messages.select("seq", F.sum("seq").over(plain)).collect()))


def test_running_sums_and_numbers(messages, many_parts):
    plain = W.partitionBy("conversation_id").orderBy("created_at", F.desc("seq"))
    want = sorted(map(tuple, messages.select("seq", F.sum("created_at").over(plain.rowsBetween(W.unboundedPreceding, 0)), F.row_number().over(plain)).collect()))
    order = ["created_at", F.desc("seq")]
    got = ranges.running(messages, "conversation_id", order, F.col("created_at"), "x").join(ranges.row_numbers(messages, "conversation_id", order, "n").select("seq", "n"), "seq")
    assert sorted(map(tuple, got.select("seq", "x", "n").collect())) == want


def test_recent_is_limited_before_the_shuffle(messages):
    plan = conversations.recent(messages, 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_one_name_for_all_uploads(spark, many_parts):
    uploads = spark.createDataFrame([("same.txt", i) for i in range(400)] + [("same_7.txt", 400), ("other.txt", 401)], "filename string, seq long").repartition(5)
    there = spark.createDataFrame([("same.txt",), ("same_3.txt",), ("same_100.txt",)], "filename string")
    got = {r["seq"]: r["dest"] for r in catalog.numbered_names(uploads, there).collect()}
    free = iter([n for n in range(1, 500) if n not in (3, 7, 100)])
    assert got == {i: f"same_{next(free)}.txt" for i in range(400)} | {400: "same_7.txt", 401: "other.txt"}


def test_a_common_identifier_is_cut_before_the_join(spark):
    chunks = spark.createDataFrame([(f"c{i:03}", "SIH10001", "" if i % 2 else "SIH-10001") for i in range(300)] + [("d", "SIH2", None), ("e", None, "sih 2")], "chunk_id string, identifier string, ps_code string").repartition(4)
    asked = spark.createDataFrame([(q, "sih 10001") for q in range(50)] + [(99, "SIH2")], "query_id long, ident string")
    got = retrieval.identifier_lookup(asked, chunks, 3)
    assert sorted((r["query_id"], r["chunk_id"]) for r in got.collect()) == sorted([(q, f"c{i:03}") for q in range(50) for i in range(3)] + [(99, "d"), (99, "e")])
    assert {r["rank"] for r in got.collect()} == {1, 2, 3}


def test_a_long_section_is_chunked_in_parts(spark):
    from corpus_jobs.operators import chunking

    rng = random.Random(9)
    words = lambda n: " ".join(rng.choice(["one", "two.", "three"]) for _ in range(n))
    text = lambda n: "\n\n".join(words(rng.choice([0, 1, 20, 150, 500])) + rng.choice(["", " ", "\n"]) for _ in range(n))
    data = [("d1", 0, text(400), "f"), ("d1", 1, text(3), "f"), ("d2", 0, None, "g"), ("d2", 1, "", "g"), ("d3", 0, "short " * 4000, "h"), ("d3", 1, words(40_000), "h")]
    sections = spark.createDataFrame(data, "document_id string, section_index int, text string, file_name string")
    assert len(chunking.parts(data[0][2], 5000)) > 10
    plain = sorted(map(tuple, chunking.chunk_sections(sections).collect()), key=str)
    got = chunking.chunk_long_sections(sections, part=5000)
    assert got.columns == chunking.chunk_sections(sections).columns
    assert sorted(map(tuple, got.collect()), key=str) == plain
    for _, _, t, _ in data:
        for part in (1, 500, 10**6):
            assert [c for p in chunking.parts(t, part) for c in chunking.chunk(p)] == chunking.chunk(t)
