"""Streams over several input files against the batch results."""

import datetime as dt

from corpus_jobs.operators import catalog
from corpus_jobs.streaming import watch
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def drain(query):
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()


def write(spark, folder, n, rows):
    spark.createDataFrame([(p, k, T0 + dt.timedelta(seconds=s)) for p, k, s in rows], "path string, kind string, ts timestamp").coalesce(1).write.parquet(f"{folder}/{n}")


def events(spark, folder):
    return spark.readStream.schema("path string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_debounce_over_batches(spark, tmp_path):
    write(spark, tmp_path / "in", 1, [("a.txt", "created", s) for s in (1.9, 0, 1)] + [("b.txt", "created", 0)])
    write(spark, tmp_path / "in", 2, [("a.txt", "modified", s) for s in (4, 2.5, 4.6)])
    q = watch.debounced(events(spark, tmp_path / "in")).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    got = sorted((r["path"], (r["ts"] - T0).total_seconds()) for r in spark.table("kept").collect())
    assert got == [("a.txt", 0.0), ("a.txt", 2.5), ("a.txt", 4.6), ("b.txt", 0.0)]


def test_ordered_debounce_is_the_batch_fold(spark, tmp_path):
    """Events out of order over several batches give the rows of one batch over all; then the state is empty."""
    import random

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watch.ROCKSDB)
    rng = random.Random(3)
    rows = [(f"{rng.choice('abc')}.txt", "modified", round(rng.uniform(10, 40), 2)) for _ in range(120)]
    order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 4))  # up to four seconds late
    batches = [order[i : i + 30] for i in range(0, 120, 30)] + [[("z.txt", "modified", 60.0)], [("z.txt", "modified", 200.0)], [("y.txt", "modified", 400.0)], [("y.txt", "modified", 800.0)]]
    try:
        for n, b in enumerate(batches):
            write(spark, tmp_path / "in", n, b)
        q = watch.debounced_in_order(events(spark, tmp_path / "in"), late=10).writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        drain(q)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["path"], round((r["ts"] - T0).total_seconds(), 2)) for r in spark.table("ordered").collect())
    want = []
    for path in "abc":
        times = sorted(s for p, _, s in rows if p == f"{path}.txt")
        want += [(f"{path}.txt", t) for t, ok in zip(times, watch.accepted([t for t in times], None, 2.0)) if ok]
    assert [x for x in got if x[0] not in ("z.txt", "y.txt")] == sorted(want)
    assert ("z.txt", 60.0) in got and ("z.txt", 200.0) in got
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    assert max(held) >= 6 and held[-1] <= 2, held  # lists and values of paths; of the last event at most its own


def test_tables_stay_fresh(spark, tmp_path):
    write(spark, tmp_path / "in", 1, [("/d/a.txt", "created", 0), ("/d/.x.txt", "created", 0), ("/d/a.exe", "deleted", 0), ("/d/b.txt", "deleted", 1)])
    docs = spark.createDataFrame([("1", "/d/a.txt"), ("2", "/d/b.txt")], "id string, file_path string")
    seen, left = [], []
    both = watch.keep_fresh(
        events(spark, tmp_path / "in"), lambda: docs, lambda: {"documents": (docs, "id")},
        lambda batch, n: seen.extend(r["path"] for r in batch.collect()),
        lambda tables, n: left.extend(r["id"] for r in tables["documents"].collect()), str(tmp_path / "c"), trigger={"availableNow": True},
    )
    for q in both:
        drain(q)
    assert seen == ["/d/a.txt"] and left == ["1"]


def test_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.txt", ".b.txt", "c.exe"):
        (tmp_path / "in" / name).write_text("x")
    q = watch.new_files(spark, str(tmp_path / "in")).select(F.substring_index("path", "/", -1).alias("name")).writeStream.format("memory").queryName("files").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    assert [r["name"] for r in spark.table("files").collect()] == ["a.txt"]


def test_store_twice(spark, tmp_path):
    first = spark.createDataFrame([("1", "a\0b"), ("2", "c")], "id string, v string")
    catalog.store(spark, None, first, str(tmp_path / "1"), "id")
    catalog.store(spark, str(tmp_path / "1"), spark.createDataFrame([("2", "d"), ("3", "e")], "id string, v string"), str(tmp_path / "2"), "id")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "2")).collect())) == [("1", "ab"), ("2", "d"), ("3", "e")]
