"""Bucketed tables and the streams that keep them, against one batch over the final files."""

import datetime as dt
import os

import pytest
from corpus_jobs.operators import bucketed
from corpus_jobs.plans import jobs
from corpus_jobs.sources import files
from corpus_jobs.streaming import arrivals
from pyspark.sql import types as T

T0 = dt.datetime(2024, 1, 1)
KIND = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "doc", "v")])


def stored_files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, fs in os.walk(f"{path}/rows") for f in fs if f.endswith(".parquet")}


def values(t):
    return sorted((r["id"], r["doc"], r["v"]) for r in t.rows().collect())


@pytest.fixture
def table(spark, tmp_path):
    t = bucketed.table(spark, str(tmp_path / "t"), KIND, "id", "doc", buckets=16)
    bucketed.upsert(t, spark.createDataFrame([(f"r{i}", f"d{i % 40}", "a\0b") for i in range(400)], KIND), 1)
    return t


def test_upsert_rewrites_touched_buckets_only(spark, table):
    before = stored_files(table.path)
    new = [("r0", "d0", "second"), ("r0", "d0", "third"), ("new", "d40", "x")]
    touched = bucketed.upsert(table, spark.createDataFrame(new, KIND), 2, order=["v"])
    after = stored_files(table.path)
    assert len(touched) <= 2
    assert {f: t for f, t in before.items() if not any(f"_bucket={b}/" in f for b in touched)}.items() <= after.items()
    assert not any(f in after for f in before if any(f"_bucket={b}/" in f for b in touched))
    want = {f"r{i}": (f"d{i % 40}", "ab") for i in range(400)} | {"r0": ("d0", "third"), "new": ("d40", "x")}
    assert values(table) == sorted((i, *x) for i, x in want.items())


def test_a_repeated_batch_changes_nothing(spark, table):
    new = spark.createDataFrame([("r1", "d1", "x"), ("r2", "d2", "y")], KIND)
    assert bucketed.upsert(table, new, 2)
    rows, stored = values(table), stored_files(table.path)
    assert bucketed.upsert(table, new, 2) == bucketed.upsert(table, new, 1) == []
    assert values(table) == rows and stored_files(table.path) == stored
    assert bucketed.upsert(table, new.limit(0), 3) == []
    assert bucketed.upsert(table, new, 2, writer="other")  # numbers are each writer's own


@pytest.mark.parametrize("step", ["staged", "placed", "noted"])
def test_a_batch_that_broke_off_is_finished(spark, table, monkeypatch, step):
    """The process ends after the merged rows are staged, put in place or noted; the batch is given again."""
    new = spark.createDataFrame([("r1", "d1", "x"), ("r9", "d9", "y")], KIND)
    gone = spark.createDataFrame([("d1",), ("d2",)], "id string")

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    with monkeypatch.context() as m:
        if step == "staged":  # the first thing read after staging
            read = type(spark.read).parquet
            m.setattr(type(spark.read), "parquet", lambda self, *p: stop() if any("/staged-" in x for x in p) else read(self, *p))
        elif step == "placed":
            write = type(spark.range(1).write).parquet
            m.setattr(type(spark.range(1).write), "parquet", lambda self, p, *a, **b: stop() if p.endswith("/batches") else write(self, p, *a, **b))
        else:
            m.setattr(bucketed, "_remove", lambda s, p: stop() if "/staged-" in p else None)
        with pytest.raises(Stop):
            bucketed.replace(table, gone, new, 7)
    bucketed.replace(table, gone, new, 7)
    want = {f"r{i}": (f"d{i % 40}", "ab") for i in range(400) if i % 40 not in (1, 2)} | {"r1": ("d1", "x")}
    assert [x for x in values(table) if x[0] != "r9"] == sorted((i, *x) for i, x in want.items() if i != "r9")
    assert not [d for d in os.listdir(table.path) if d.startswith("staged")]


def test_cascade_empties_buckets(spark, table, tmp_path):
    other = bucketed.table(spark, str(tmp_path / "u"), KIND, "id", "doc", buckets=4)
    bucketed.upsert(other, spark.createDataFrame([("only", "d3", "v")], KIND), 1)
    bucketed.cascade(spark.createDataFrame([("d3",), ("d4",), ("unknown",)], "id string"), 2, table, other)
    assert values(other) == [] and {r[1] for r in values(table)} == {f"d{i}" for i in range(40)} - {"d3", "d4"}


# --- streams ---------------------------------------------------------------------------------------------------------


def seen(k):
    docs = sorted((r["filename"], r["file_hash"], r["status"], r["chunks"]) for r in k.documents.rows().collect())
    names = {r["document_id"]: r["filename"] for r in k.documents.rows().collect()}
    return docs, sorted((names[r["document_id"]], r["text"]) for r in k.chunks.rows().collect())


def in_one_batch(spark, folder):
    known = spark.createDataFrame([], "id string, file_path string, file_hash string, status string, created_at timestamp")
    out = jobs.ingest(files.read_files(spark, folder), known)
    names = {r["document_id"]: r["filename"] for r in out["documents"].collect()}
    docs = sorted((r["filename"], r["file_hash"], r["status"], r["chunks"]) for r in out["documents"].collect())
    return docs, sorted((names[r["document_id"]], r["text"]) for r in out["chunks"].collect())


def events(spark, folder, n, rows):
    spark.createDataFrame([(p, k, T0 + dt.timedelta(seconds=s)) for p, k, s in rows], "path string, kind string, ts timestamp").coalesce(1).write.parquet(f"{folder}/{n}")


def drain(q):
    try:
        assert q.awaitTermination(180)
    finally:
        q.stop()


def test_stream_ends_in_the_tables_of_a_batch(spark, tmp_path):
    """Several batches with a rewrite, a deletion and a batch that is given again after it failed; then a listing finds
    what no event told."""
    data, told = tmp_path / "data", str(tmp_path / "told")
    data.mkdir()
    k = arrivals.knowledge(spark, str(tmp_path / "know"), buckets=4)

    def put(name, text):
        (data / name).write_text(text)
        return f"{data}/{name}"

    def run(fail=False):
        stream = spark.readStream.schema("path string, kind string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{told}/*")
        q = arrivals.follow(k, stream, str(tmp_path / "check"), trigger={"availableNow": True})
        if fail:
            with pytest.raises(Exception, match="broke off"):
                drain(q)
        else:
            drain(q)

    events(spark, told, 1, [(put("a.txt", "first"), "created", 0), (put("b.md", "# Head\nbody"), "created", 0), (put(".c.txt", "hidden"), "created", 0)])
    events(spark, told, 2, [(put("d.txt", "fourth"), "created", 5), (put("b.md", "# Other\nwords\n# More\nlines"), "modified", 6), (put("empty.txt", " "), "created", 6)])
    run()
    assert seen(k) == in_one_batch(spark, str(data))
    os.remove(data / "a.txt")
    events(spark, told, 3, [(f"{data}/a.txt", "deleted", 9), (put("d.txt", "fourth again"), "modified", 12)])
    from unittest import mock

    with mock.patch.object(arrivals.bucketed, "replace", side_effect=[bucketed.replace(k.chunks, k.chunks.rows().select("document_id").limit(0), None, 0), RuntimeError("broke off")]):
        run(fail=True)
    run()
    assert seen(k) == in_one_batch(spark, str(data))
    put("d.txt", "rewritten without an event")
    os.remove(data / "b.md")
    arrivals.reconcile(k, str(data), 1)
    assert seen(k) == in_one_batch(spark, str(data)) and len(seen(k)[0]) == 2


def test_new_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_text(f"text {i}")
    k = arrivals.knowledge(spark, str(tmp_path / "know"), buckets=4)
    drain(arrivals.follow_rows(k, arrivals.new_file_rows(spark, str(tmp_path / "in")), str(tmp_path / "c"), {"availableNow": True}))
    assert seen(k) == in_one_batch(spark, str(tmp_path / "in"))
