"""Cases worked out by hand."""

import random
import re

import pytest
from corpus_jobs.functions import dates, records, routing, text
from corpus_jobs.operators import answers, catalog, chunking, conversations, keyword, ocr, ranking, retrieval
from corpus_jobs.sources import files
from corpus_jobs.streaming import watch
from pyspark.sql import functions as F


def of(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


def test_identifiers(spark):
    got = of(spark, routing.identifiers, "Compare SIH 26037 and ABC-2026-001", "sih-26037 SIH26037", "26037", "tell me more about 26037", "")
    assert got == [["SIH26037", "ABC-2026-001"], ["SIH26037"], ["26037"], [], []]


def test_canonical(spark):
    assert of(spark, text.canonical_id, "ABC-2026 _001") == ["ABC2026001"]


def test_page(spark):
    assert of(spark, routing.target_page, "page 4", "the 3rd page", "step 4", "page 99999999999") == [4, 3, None, None]


def test_follow_up(spark):
    assert of(spark, routing.is_follow_up, "what is it about", "what is it?", "give me the list") == [True, False, True]


@pytest.mark.parametrize("question,intent", [("SIH26037", "exact_identifier"), ("What is SIH26037?", "identifier_detail"), ("summarize page 3", "page_lookup"), ("my notes", "image_note"), ("discount table", "table_list"), ("solar panels", "keyword"), ("compare SIH26037 with PS102", "comparison"), ("who sponsors it", "follow_up")])
def test_intent(spark, question, intent):
    assert routing.plan(spark.createDataFrame([(question,)], "message string")).first()["intent"] == intent


def test_follow_up_is_resolved(spark):
    rows = [("c", 1, 1, "user", "see DOC123"), ("c", 2, 2, "user", "who sponsors it"), ("c", 3, 3, "user", "Its theme and THE SAME")]
    m = spark.createDataFrame(rows, "conversation_id string, created_at int, seq int, role string, content string")
    got = routing.with_history(m).orderBy("seq").select(routing.resolve(F.col("content"), F.col("last_id"))).collect()
    assert [r[0] for r in got] == [None, "who sponsors DOC123", "DOC123's theme and DOC123"]


def test_clean_text(spark):
    assert of(spark, text.clean_text, "a\r\n\n\n\nb  c\x07", "　ﬁ ①\x85", None, "a\rb") == ["a\n\nb c", "fi 1", None, "a\nb"]


def test_safe_filename(spark):
    assert of(spark, text.safe_filename, "../x/a:b?.txt", " .. ", "é.pdf") == ["a_b_.txt", "unnamed_file", "e\u0301.pdf"]


def test_clean_answer(spark):
    assert of(spark, text.clean_answer, " x (Evidence 12: p 3)\n\n\n\n[Source: a, b]y ") == ["x \n\ny"]


def test_field(spark):
    assert of(spark, lambda c: records.field_value(c, ["theme"]), "Theme: Water | Track: Hardware", "theme|\n", "none") == ["Water", "", ""]


def test_problem_text(spark):
    assert of(spark, records.problem_text, "x" * 1500, "a Details: b\nc ") == ["x" * 1000, "b\nc"]


def test_dataset_type(spark):
    assert of(spark, lambda c: files.dataset_type(F.lit("a.pdf"), c), "monday tuesday period", "marks only", "HOD and professor") == ["timetable", "general", "faculty"]


def test_days(spark):
    day = F.lit("2024-01-05").cast("date")  # a Friday
    assert of(spark, lambda c: dates.day_reference(c, day), "today", "TOMORROW", "day after tomorrow", "next monday", "friday", "soon") == ["Friday", "Saturday", "Sunday", "Monday", "Friday", None]
    got = of(spark, lambda c: dates.timetable_question(c, day), "class the day after tomorrow at 9.15", "hello")
    assert got[0]["day"] == "Saturday" and got[0]["time"] == "9.15" and got[1] is None


def sections_of(spark, reader, content, **columns):
    df = spark.createDataFrame([("f", content)], "file_path string, content binary")
    return reader(df).orderBy("section_index").collect()


def test_markdown(spark):
    got = sections_of(spark, files.markdown_sections, b"intro\n# A\nx\n#b\n## C\ny")
    assert [(r["section"], r["text"]) for r in got] == [("", "intro"), ("A", "# A\nx\n#b"), ("C", "## C\ny")]


def test_latin1_text(spark):
    assert sections_of(spark, files.text_sections, "é x".encode("latin-1"))[0]["text"] == "é x"


def test_json(spark):
    got = sections_of(spark, files.json_sections, b'{"a":{"b":[1,{"c":null}]},"d":{}}')
    assert [r["text"] for r in got] == ["a.b[0]: 1\na.b[1].c: None"]
    assert len(sections_of(spark, files.json_sections, b'"' + b"x" * 7000 + b'"')) == 3


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n" + "".join(f"{i},{'NA' if i % 2 else i}\n" for i in range(45)))
    (tmp_path / "u.csv").write_bytes('x,"y, z"\né,"two\nlines"\n1,2,3\n,\n5'.encode("latin-1"))
    (tmp_path / "v.csv").write_text("")
    every = files.csv_sections(files.read_files(spark, str(tmp_path))).withColumn("file_path", F.substring_index("file_path", "/", -1))
    assert [tuple(r) for r in every.filter("file_path <> 't.csv'").collect()] == [("u.csv", 0, "x: é\ny, z: two\nlines\n\nx: 5", "csv", "x, y, z", "1-2")]
    got = every.filter("file_path = 't.csv'").orderBy("section_index").collect()
    assert [r["row_range"] for r in got] == ["1-20", "21-40", "41-45"]
    assert got[0]["text"].startswith("a: 0\nb: 0\n\na: 1\n\na: 2") and got[0]["columns"] == "a, b"


def test_files_are_listed(spark, tmp_path):
    for name in ("a.txt", ".hidden.txt", "b.exe", "c.MD"):
        (tmp_path / name).write_text("x")
    got = files.read_files(spark, str(tmp_path)).select("filename", "file_type", "size_bytes").collect()
    assert sorted(map(tuple, got)) == [("a.txt", "txt", 1), ("c.MD", "markdown", 1)]


# --- chunks -------------------------------------------------------------------------------------------------------------


def test_chunks_by_hand():
    assert chunking.chunk("") == chunking.chunk(None) == chunking.chunk(" \n\n ") == []
    a, b = "a" * 500, "b" * 500
    assert chunking.chunk(f"{a}\n\n{b}") == [a, "a" * 120 + "\n\n" + b]
    assert [len(c) for c in chunking.chunk("w" * 2000)] == [800, 800, 640]
    assert chunking.chunk("w" * 1200) == ["w" * 1200]
    assert chunking.chunk(f"{a}\n\n{'c' * 900}\n\n{b}") == [a, "c" * 900, b]  # nothing is carried over a long paragraph


def test_chunks_hold_all_words():
    rng = random.Random(1)
    for _ in range(100):
        t = "".join(rng.choice(["word ", "other. ", "x" * 50 + " ", "\n", "\n\n"]) for _ in range(rng.randrange(200)))
        got = chunking.chunk(t, 200, 40)
        assert set(re.findall(r"\w+", t)) <= set(re.findall(r"\w+", " ".join(got)))
        assert all(c == c.strip() and c for c in got)


# --- search -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("falling", "fall"), ("is", "is")])
def test_stems(word, stem):
    assert keyword.stem(word) == stem


def test_phrase_stays_within_a_column(spark):
    chunks = spark.createDataFrame([("c1", "d", "Rivers were running", "wild.txt"), ("c2", "d", "running wild", ""), ("c3", "d", "the river runs", "")], "chunk_id string, document_id string, text string, file_name string")
    asked = spark.createDataFrame([(1, "running wild"), (2, "river"), (3, "absent words"), (4, "  ")], "query_id long, question string")
    got = keyword.phrase_search(asked, keyword.index(chunks)).select("query_id", "chunk_id").collect()
    assert sorted(map(tuple, got)) == [(1, "c2"), (2, "c1"), (2, "c3")]


def test_fusion(spark):
    rows = [(1, 1, 1, "a", "x", 1, 0.1), (1, 2, 1, "a", "y", 10, 0.2), (1, 2, 2, "b", "z", 1, 0.3)]
    got = retrieval.fuse(spark.createDataFrame(rows, "query_id int, list_no int, rank int, chunk_id string, tag string, meta_keys int, score double")).orderBy("chunk_id").collect()
    assert [round(r["score"], 6) for r in got] == [0.032787, 0.016129] and got[0]["best"]["tag"] == "y"


def test_ratio(spark):
    rows = [(1, "A", 1.0), (1, "A", 0.34), (1, "B", 0.35), (1, "B", 0.34)]
    got = retrieval.ratio_filter(spark.createDataFrame(rows, "query_id int, document_id string, score double"), [F.desc("score")]).collect()
    assert sorted((r["document_id"], r["score"]) for r in got) == [("A", 0.34), ("A", 1.0), ("B", 0.35)]


def test_rerank(spark):
    rows = [(1, 1, "a", False, 3.0), (1, 2, "b", False, 1.0), (1, 3, "c", False, 2.0), (2, 1, "a", False, 9.0), (3, 1, "a", False, 9.0), (3, 2, "b", True, None)]
    got = ranking.rerank(spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, is_exact boolean, model_score double")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == [(1, "a", 1.0), (1, "c", 0.5), (1, "b", 0.0), (2, "a", 0.0), (3, "b", 1.0), (3, "a", 0.0)]


def test_confidence(spark):
    q = spark.createDataFrame([(1, "a b c d", "semantic"), (2, "a b c d", "semantic"), (3, "a b", "semantic"), (4, "a", "semantic")], "query_id int, question string, intent string")
    rows = [(1, 1, 1.0), (1, 2, 0.5), (1, 3, 0.0), (2, 1, 0.6), (3, 1, 0.6)]
    rows = spark.createDataFrame(rows, "query_id int, rank int, score double").withColumns({"has_id": F.lit(False), "origin": F.lit("semantic")})
    assert {r[0]: r[1] for r in ranking.confidence(q, rows).collect()} == {1: 0.8, 2: 0.51, 3: 0.8, 4: 0.0}


@pytest.mark.parametrize("sizes,want", [((3000, 2000), 3000 + 2 + 900 + 3), ((3800, 500), 3800), ((100, 200), 302)])
def test_context(spark, sizes, want):
    rows = [(1, i + 1, chr(97 + i) * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "query_id int, rank int, text string")
    assert len(answers.context(df, F.col("text")).first()["context"]) == want


def test_cards(spark):
    rows = [(1, 1, "A", "c1", 0.5, 3), (1, 2, "A", "c2", 0.9, 1), (1, 3, "A", "c3", 0.9, 3)]
    df = spark.createDataFrame(rows, "query_id int, rank int, document_id string, chunk_id string, score double, page_number int")
    df = df.withColumns({"text": F.col("chunk_id"), "file_name": F.lit("f"), "file_type": F.lit("pdf"), "slide_number": F.lit(None).cast("int"), "section": F.lit("")})
    r = answers.source_cards(df).first()
    assert (r["pages"], r["page"], r["chunk_id"], r["chunk_count"], r["slides"], r["section"]) == ([1, 3], 1, "c3", 3, [], None)


def test_grounded(spark):
    long = "The values are 1.5, 77 and 88 in this rather long answer of ours."
    got = of(spark, lambda c: answers.grounded(c, F.lit("only 77")), long, "1.5 77 88", long + " not found", "", "There are 2 numbers and 77 in this rather long answer, no more")
    assert got == [False, True, True, True, True]


# --- tables ---------------------------------------------------------------------------------------------------------------


def test_names(spark):
    ups = spark.createDataFrame([("a.txt", 1), ("a.txt", 2), ("b", 3), ("c.txt", 4), ("c.txt", 5), ("c_1.txt", 6)], "filename string, seq int")
    got = catalog.numbered_names(ups, spark.createDataFrame([("a.txt",), ("b_1",)], "filename string"))
    assert {r["seq"]: r["dest"] for r in got.collect()} == {1: "a_1.txt", 2: "a_2.txt", 3: "b", 4: "c.txt", 5: "c_2.txt", 6: "c_1.txt"}


def test_title(spark):
    assert of(spark, conversations.title_of, "x" * 40, "short", "") == ["x" * 35 + "...", "short", "New Conversation"]


def test_layout(spark):
    rows = [("i", 0, "word", 90.0, 1, 1, 5, 5, 10, 10), ("i", 1, "blurred", 20.0, 1, 1, 20, 4, 10, 20)]
    r = ocr.layout_lines(spark.createDataFrame(rows, "image_id string, word_no int, text string, conf double, block_num int, line_num int, left int, top int, width int, height int")).first()
    assert (r["text"], r["confidence"], tuple(r["bbox"])) == ("word [unclear]", 0.55, (5, 4, 25, 20))


def test_structured_text(spark):
    rows = [("i", "b0", 1, 1, "Notes", "heading"), ("i", "b1", 1, 2, "- item", "bullet"), ("i", "b2", 2, 1, "text", "paragraph")]
    df = spark.createDataFrame(rows, "image_id string, block_id string, block_num int, line_number int, text string, type string")
    assert ocr.structured_text(df).first()["structured_ocr"] == "### Notes\n\n  • item\ntext"


def test_debounce_fold():
    assert watch.accepted([0, 1, 1.9, 2.5, 4, 4.6], None, 2.0) == [True, False, False, True, False, True]


def test_debounce_batch_is_the_fold(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(0, 60_000_000)) for i, k in enumerate(rng.choices("abc", k=300))]
    got = watch.debounced_batch(spark.createDataFrame(rows, "path string, event_id int, us long"), 2.0)
    want = set()
    for k in "abc":
        mine = sorted((u, i) for p, i, u in rows if p == k)
        want |= {i for (_, i), ok in zip(mine, watch.accepted([u / 1e6 for u, _ in mine], None, 2.0)) if ok}
    assert {r["event_id"] for r in got.collect()} == want


def test_debounce_batch_of_one_long_run_gathers_no_key(spark):
    """One unbroken series of one path, over many parts: the same events as the fold, and no array or window of a key."""
    rng = random.Random(5)
    times, t = [], 0
    for _ in range(3000):
        t += rng.choice((0, 10_000, 300_000, 1_100_000))
        times.append(t)
    rows = [("long", i, t) for i, t in enumerate(times)] + [(k, 5000 + i, t) for k in (None, "a", "z") for i, t in enumerate(times[:40])]
    got = watch.debounced_batch(spark.createDataFrame(rows, "path string, event_id int, us long"), 2.0)
    want = [(k, i) for k in ("long", None, "a", "z") for (_, i, _), ok in zip([r for r in rows if r[0] == k], watch.accepted([r[2] / 1e6 for r in rows if r[0] == k], None, 2.0)) if ok]
    assert sorted(((r["path"], r["event_id"]) for r in got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
