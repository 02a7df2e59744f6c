"""Files to tables to answers, end to end on a handful of files."""

import pytest
from corpus_jobs.plans import jobs
from corpus_jobs.sources import files
from pyspark.sql import functions as F

PAGES = b"Intro\nSIH 26037 Title: Clean water | Track: Software\nTheme: Rivers\nSponsor: Office of Rivers\nDescription: measure wells\x0cSIH 26038 Title: Dry land"
KNOWN = "id string, file_path string, file_hash string, status string, created_at timestamp"


def pdf(content):
    return [(t, {"page_number": i + 1, "source_type": "pdf"}) for i, t in enumerate(content.decode().split("\x0c"))]


@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    for name, body in {"plan.pdf": PAGES, "notes.md": b"# Wells\nWells run dry in spring.\n# Rivers\nRivers carry water.", "t.txt": b"monday tuesday period", "empty.txt": b" ", "x.docx": b"?", "rows.csv": b"well,depth\nA,12\nB,NA"}.items():
        (folder / name).write_bytes(body)
    return files.read_files(spark, str(folder))


@pytest.fixture(scope="module")
def tables(spark, listing):
    return jobs.ingest(listing, spark.createDataFrame([], KNOWN), {"pdf": pdf})


def test_documents(tables):
    got = {r["filename"]: r for r in tables["documents"].collect()}
    assert {n: r["status"] for n, r in got.items()} == {"plan.pdf": "indexed", "notes.md": "indexed", "t.txt": "indexed", "empty.txt": "failed", "x.docx": "failed", "rows.csv": "indexed"}
    assert got["empty.txt"]["error_message"] == jobs.NO_TEXT and got["x.docx"]["error_message"] == "No parser for type: docx"
    assert tables["chunks"].filter("file_name = 'rows.csv'").first()["text"] == "well: A\ndepth: 12\n\nwell: B"
    assert got["t.txt"]["dataset_type"] == "timetable" and got["notes.md"]["chunks"] == 2


def test_records(tables):
    got = {r["identifier"]: r for r in tables["records"].collect()}
    assert got["SIH26037"]["track"] == "Software" and got["SIH26037"]["sponsoring_ministry"] == "Office of Rivers" and got["SIH26038"]["page_number"] == 2


def test_written_tables_can_be_removed(spark, monkeypatch):
    import os

    from corpus_jobs import storage

    monkeypatch.setattr(storage, "_written", [])
    paths = [storage.new_path(spark, "gone") for _ in range(2)]
    spark.range(3).write.parquet(paths[0])
    storage.remove_written(spark)
    assert not os.path.exists(paths[0]) and storage._written == []


def test_unchanged_files_change_nothing(spark, listing, tables):
    known = tables["documents"].select(F.col("document_id").alias("id"), "file_path", "file_hash", "status", "created_at")
    again = jobs.ingest(listing, known, {"pdf": pdf})
    assert sorted(r["filename"] for r in again["documents"].collect()) == ["empty.txt", "x.docx"]


def test_answers(spark, tables):
    asked = spark.createDataFrame([(1, "What is SIH 26037?"), (2, "rivers carry water"), (3, "page 2"), (4, "nothing of the kind"), (5, "SIH26038")], "query_id long, question string")
    out = jobs.answer(asked, tables["chunks"], tables["records"], lambda pairs: [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in pairs])
    conf = {r["query_id"]: r["confidence"] for r in out["confidence"].collect()}
    assert conf[1] == conf[5] == 0.98 and conf[4] == 0.0 and 0 <= conf[2] <= 1
    contexts = {r["query_id"]: r["context"] for r in out["contexts"].collect()}
    assert set(contexts) == {1, 2, 3, 5} and contexts[1].startswith("--- Record 1 ---\nPS Code: SIH26037\nTrack: Software")
    assert "Rivers carry water." in contexts[2]
    cards = {(r["query_id"], r["file_name"]): r for r in out["cards"].collect()}
    assert cards[1, "plan.pdf"]["page"] == 1 and cards[5, "plan.pdf"]["pages"][-1] == 2
    # an exact identifier that is found takes no keyword rows
    assert out["candidates"].filter("query_id = 5 and list_no > 2").count() == 0


def test_pairs_are_scored_once_and_by_length(spark):
    from corpus_jobs.operators import ranking

    rows = spark.createDataFrame([(i, f"q{i % 2}", "word " * (1 + i * 7 % 400)) for i in range(1600)] + [(1600, None, "x"), (1601, "", "x"), (1602, "x", None)], "id long, question string, text string").repartition(5)
    scores = ranking.scored_by_length(rows, lambda pairs: [len(q) * 1000 + len(t) for q, t in pairs], batch=32)
    got = {r["id"]: r["model_score"] for r in ranking.with_scores(rows, scores).collect()}
    assert got == {r["id"]: len(r["question"] or "") * 1000.0 + len(r["text"] or "") for r in rows.collect()}
    report = ranking.scoring_report(rows, scores).first()
    distinct = len({(r["question"] or "", r["text"] or "") for r in rows.collect()})
    assert (report["n_rows"], report["n_pairs"]) == (1603, distinct) and report["padding"] < 0.1
    assert ranking.with_scores(rows.limit(0), ranking.scored_by_length(rows.limit(0), len)).count() == 0
