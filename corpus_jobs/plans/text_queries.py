"""Queries of sources and scalar functions."""

from pyspark.sql import functions as F

from ..functions import dates, records, routing, text
from ..operators import chunking, marks
from ..sources import csv_files, files
from ..storage import new_path
from .inputs import frame, table
from .registry import query
from .routing_sql import PLANNED


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g'), '\r\n?', chr(10), 'g'), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS cleaned FROM documents""")
def f1_clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS short FROM documents")
def f2_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def f3_text_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.text_hash(F.col("text")).alias("hash"))


@query(r"""SELECT page_id, CASE WHEN n = '' THEN 'unnamed_file' ELSE n END AS name FROM (
    SELECT page_id, regexp_replace(regexp_replace(regexp_replace(' ..' || replace(url, ':', '?') || '.txt. ', '^.*/', ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS n FROM pages)""")
def f4_safe_filename(spark, sf):
    raw = F.concat(F.lit(" .."), F.translate("url", ":", "?"), F.lit(".txt. "))
    return table(spark, sf, "pages").select("page_id", text.safe_filename(raw).alias("name"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


# A text is one paragraph here, as no document holds an empty line; sentences are packed one after another.
@query(f"""WITH RECURSIVE t AS (SELECT doc_id, source, trim(text, {_BLANKS}) AS para FROM documents),
    s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(para, '. ', '.' || chr(10)), chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> '') AS parts FROM t WHERE length(para) > 800),
    p AS (SELECT doc_id, parts, 0 AS i, '' AS held, CAST(NULL AS VARCHAR) AS done FROM s
      UNION ALL SELECT doc_id, parts, i + 1,
        CASE WHEN i = len(parts) THEN '' WHEN held = '' THEN parts[i + 1] WHEN length(held) + 1 + length(parts[i + 1]) <= 800 THEN held || ' ' || parts[i + 1]
          WHEN trim(right(held, 120), {_BLANKS}) = '' THEN parts[i + 1] ELSE trim(right(held, 120), {_BLANKS}) || ' ' || parts[i + 1] END,
        CASE WHEN i = len(parts) OR (held <> '' AND length(held) + 1 + length(parts[i + 1]) > 800) THEN held END FROM p WHERE i <= len(parts)),
    c AS (SELECT doc_id, i, 0 AS j, para AS text FROM (SELECT doc_id, 0 AS i, para FROM t WHERE length(para) <= 800 AND para <> '')
      UNION ALL SELECT doc_id, i, 0, done FROM p WHERE done <> '' AND length(done) <= 1600
      UNION ALL SELECT doc_id, i, j, substr(done, CAST(j + 1 AS INT), 800) FROM (SELECT doc_id, i, done, unnest(range(0, length(done), 680)) AS j FROM p WHERE length(done) > 1600)),
    n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS k FROM c)
    SELECT CAST(doc_id AS VARCHAR) AS document_id, 0 AS section_index, source, k AS chunk_index, text, CAST(doc_id AS VARCHAR) || '_0_' || CAST(k AS VARCHAR) AS chunk_id FROM n JOIN t USING (doc_id)""")
def f5_chunks(spark, sf):
    sections = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("section_index"), "text", "source")
    return chunking.chunk_sections(sections)


@query("""SELECT event_id, coalesce(event_type, '') AS event_type, coalesce(props, '') AS props, 'events' AS file_name, '{"user":' || CAST(user_id AS STRING) || '}' AS nested FROM events""")
def f6_simple_metadata(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "props", F.lit("events").alias("base"), F.struct(F.col("user_id").alias("user")).alias("nested"))
    merged = rows.withColumns(chunking.merged_metadata({"file_name": "base"}, []))
    return chunking.simple_metadata(merged, ["event_type", "props", "nested"]).select("event_id", "event_type", "props", "file_name", "nested")


_COUNT = lambda words, col: " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words)


@query(f"""SELECT conv_id, turn, CASE WHEN contains(s, 'timetable') OR {_COUNT(files.TIMETABLE_WORDS, 't')} >= 3 THEN 'timetable'
    WHEN contains(s, 'marks') OR {_COUNT(files.MARKSHEET_WORDS, 't')} >= 3 THEN 'marksheet'
    WHEN contains(s, 'faculty') OR {_COUNT(files.FACULTY_WORDS, 't')} >= 2 THEN 'faculty' ELSE 'general' END AS dataset_type
    FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'faculty' WHEN 1 THEN 'marks' ELSE 'notes' END AS s,
                 lower(substr(CASE conv_id % 4 WHEN 0 THEN 'Monday Tuesday period ' WHEN 1 THEN 'Marks and grade, pass ' WHEN 2 THEN 'professor HOD ' ELSE '' END || text, 1, 2000)) AS t FROM conversations)""")
def f7_dataset_type(spark, sf):
    lead = F.expr("CASE conv_id % 4 WHEN 0 THEN 'Monday Tuesday period ' WHEN 1 THEN 'Marks and grade, pass ' WHEN 2 THEN 'professor HOD ' ELSE '' END")
    name = F.expr("CASE turn % 4 WHEN 0 THEN 'Faculty.pdf' WHEN 1 THEN 'marks.csv' ELSE 'notes.timetable' END")
    return table(spark, sf, "conversations").select("conv_id", "turn", files.dataset_type(name, F.concat(lead, "text")).alias("dataset_type"))


_CODES = "SELECT *, 'SIH' || CAST(10000 + o_orderkey % 89999 AS STRING) AS c1, 'SIH' || CAST(1000 + o_custkey % 8999 AS STRING) AS c2 FROM orders"


@query(f"""WITH o AS ({_CODES}), r AS (
    SELECT c1 AS identifier, o_orderstatus AS track, 'Plan ' || o_orderpriority AS problem_statement_title, 'Water' AS theme, 'Office ' || CAST(o_custkey AS STRING) AS sponsoring_ministry, 'build ' || CAST(o_custkey AS STRING) || ' wells' AS problem_statement, * EXCLUDE (c1, c2) FROM o
    UNION ALL SELECT c2, 'Soft', 'N' || CAST(o_custkey AS STRING), '', '', 'SIH ' || substr(c2, 4) || chr(10) || 'Category: Soft | name: N' || CAST(o_custkey AS STRING), * EXCLUDE (c1, c2) FROM o)
    SELECT 'd' || CAST(o_orderkey % 50 AS STRING) || '_' || identifier || '_' || CAST(o_orderkey AS STRING) AS id, identifier, track, problem_statement_title, theme, sponsoring_ministry, problem_statement, CAST(o_orderkey AS INT) AS page_number FROM r""")
def f8_structured_records(spark, sf):
    found = records.extract(frame(spark, sf, "pages"))
    return found.select("id", "identifier", "track", "problem_statement_title", "theme", "sponsoring_ministry", "problem_statement", "page_number")


@query("SELECT p_partkey, p_type AS theme, '' AS track FROM part")
def f9_field_value(spark, sf):
    line = F.concat(F.lit("Theme: "), "p_type", F.lit(" | Name: "), "p_name")
    return table(spark, sf, "part").select("p_partkey", records.field_value(line, records.LABELS["theme"]).alias("theme"), records.field_value(line, records.LABELS["track"]).alias("track"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE substr(text, 1, 1000) END AS problem FROM documents")
def f10_problem_text(spark, sf):
    block = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SIH 1 Details | "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", records.problem_text(block).alias("problem"))


@query("""SELECT id AS chunk_id, document_id, 'PS CODE: ' || ps_code || chr(10) || 'TITLE: ' || problem_statement_title || chr(10) || 'TRACK: ' || track || chr(10) || 'THEME: ' || theme || chr(10) || 'SPONSOR: ' || chr(10) || 'PROBLEM STATEMENT: ' AS text FROM $records""")
def f11_record_chunks(spark, sf):
    return records.record_chunks(frame(spark, sf, "records")).select("chunk_id", "document_id", "text")


@query(f"WITH {PLANNED} SELECT query_id, array_to_string(ids, ',') AS identifiers FROM asked")
def f12_identifiers(spark, sf):
    return frame(spark, sf, "questions").select("query_id", F.array_join(routing.identifiers(F.col("message")), ",").alias("identifiers"))


@query("SELECT p_partkey, upper(replace(replace(replace(p_name || ' - _x', ' ', ''), '-', ''), '_', '')) AS canonical FROM part")
def f13_canonical_id(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.canonical_id(F.concat("p_name", F.lit(" - _x"))).alias("canonical"))


@query(f"WITH {PLANNED} SELECT query_id, page FROM planned")
def f14_target_page(spark, sf):
    return frame(spark, sf, "questions").select("query_id", routing.target_page(F.col("message")).alias("page"))


@query(f"WITH {PLANNED} SELECT query_id, array_to_string(fields, ',') AS fields FROM planned")
def f15_target_fields(spark, sf):
    return frame(spark, sf, "questions").select("query_id", F.array_join(routing.target_fields(F.col("message")), ",").alias("fields"))


@query(f"WITH {PLANNED} SELECT query_id, follow_up FROM planned")
def f16_follow_up(spark, sf):
    return frame(spark, sf, "questions").select("query_id", routing.is_follow_up(F.col("message")).alias("follow_up"))


@query(f"WITH {PLANNED} SELECT query_id, intent, array_to_string(comparison, ',') AS comparison FROM planned")
def f17_intent(spark, sf):
    p = routing.plan(frame(spark, sf, "questions"))
    return p.select("query_id", "intent", F.array_join("comparison_ids", ",").alias("comparison"))


@query("SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM conversations")
def f18_clean_answer(spark, sf):
    raw = F.concat(F.lit("(Evidence 3: page 2)"), "text", F.lit("[Source: a.pdf, Page 1]\n\n\n\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.clean_answer(raw).alias("answer"))


def _asked(spark, sf, *phrases):
    """The texts of conversations, with a phrase behind, before or instead of each by turns."""
    phrase = F.element_at(F.array(*map(F.lit, phrases)), (F.col("conv_id") % len(phrases) + 1).cast("int"))
    said = F.when(F.col("turn") % 3 == 0, phrase).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" "), phrase)).otherwise(F.concat(phrase, F.lit(" "), "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", said.alias("asked"), F.expr("date_add(date '2024-01-01', cast((conv_id + turn) % 31 as int))").alias("today"))


def _asked_sql(*phrases):
    phrase = f"({list(phrases)})[conv_id % {len(phrases)} + 1]"
    return f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {phrase} WHEN 1 THEN text || ' ' || {phrase} ELSE {phrase} || ' ' || text END AS asked, DATE '2024-01-01' + CAST((conv_id + turn) % 31 AS INT) AS today FROM conversations"


_MARKS = ("Who is the TOPPER", "top 5 in class", "mean marks", "compare A with B in maths", "pass rate?", "least total", "rank of A", "hello", "marks of A and result of B")
_KINDS = " ".join(f"WHEN regexp_matches(lower(asked), '{p}') THEN '{k}'" for k, p in marks.QUESTIONS.items())


@query(f"SELECT conv_id, turn, CASE {_KINDS} END AS kind FROM ({_asked_sql(*_MARKS)})")
def f19_marks_question(spark, sf):
    return _asked(spark, sf, *_MARKS).select("conv_id", "turn", marks.question_type(F.col("asked")).alias("kind"))


_TIMES = ("what class is today at 10:30", "lab tomorrow", "who teaches maths today?", "no question", "which room on friday at 9.15", "class yesterday and next")
_DAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
_TIMETABLE = f"""i AS (SELECT *, lower(asked) AS t, {" OR ".join(f"regexp_matches(lower(asked), '{p}')" for p in dates.TIMETABLE_PATTERNS)} AS asks FROM ({_asked_sql(*_TIMES)})),
    d AS (SELECT *, regexp_extract(t, '{_DAYS}') AS named FROM i),
    f AS (SELECT *, CASE WHEN asks THEN CASE WHEN contains(t, 'today') THEN dayname(today) WHEN contains(t, 'tomorrow') THEN dayname(today + 1) WHEN contains(t, 'yesterday') THEN dayname(today - 1)
      WHEN named <> '' THEN upper(named[1]) || named[2:] END END AS day, CASE WHEN asks THEN nullif(regexp_extract(t, '\\d{{1,2}}[:.]\\d{{2}}'), '') END AS time,
      CASE WHEN asks THEN nullif(upper(trim(regexp_extract(t, 'who teaches\\s+(.+?)(\\?|$)', 1))), '') END AS subject FROM d)"""


@query(f"WITH {_TIMETABLE} SELECT conv_id, turn, day, time, subject FROM f")
def f20_timetable_question(spark, sf):
    info = dates.timetable_question(F.col("asked"), F.col("today"))
    return _asked(spark, sf, *_TIMES).select("conv_id", "turn", info.alias("i")).select("conv_id", "turn", "i.day", "i.time", "i.subject")


@query(f"""WITH {_TIMETABLE} SELECT conv_id, turn, asked || coalesce(' ' || chr(10) || '[System context: The user is asking about ' || day || '. Today is ' || dayname(today) || '.]', '')
    || coalesce(' [Time reference: ' || time || ']', '') || coalesce(' [Subject: ' || subject || ']', '') AS context FROM f WHERE asks""")
def f20_timetable_context(spark, sf):
    rows = _asked(spark, sf, *_TIMES).withColumn("info", dates.timetable_question(F.col("asked"), F.col("today"))).filter("info is not null")
    return rows.select("conv_id", "turn", dates.timetable_context(F.col("asked"), F.col("info")).alias("context"))


_REFERENCES = ("Today", "tomorrow ", "yesterday", "day after tomorrow", "next friday", "some day", " SUNDAY")


@query(f"""SELECT conv_id, turn, CASE t {" ".join(f"WHEN '{w}' THEN dayname(today + {n})" for w, n in dates.DAY_OFFSETS.items())} ELSE CASE WHEN named <> '' THEN upper(named[1]) || named[2:] END END AS day
    FROM (SELECT *, regexp_extract(t, '^(?:next )?({_DAYS})$', 1) AS named FROM (SELECT *, regexp_replace(lower(asked), '^\\s+|\\s+$', '', 'g') AS t FROM ({_asked_sql(*_REFERENCES)})))""")
def f21_day_reference(spark, sf):
    return _asked(spark, sf, *_REFERENCES).select("conv_id", "turn", dates.day_reference(F.col("asked"), F.col("today")).alias("day"))


_NAMED = "SELECT doc_id, 'file' || CAST(doc_id AS STRING) || (['.txt', '.MD', '.exe', ''])[doc_id % 4 + 1] AS filename, text FROM documents"


@query(f"SELECT filename, (['txt', 'markdown'])[doc_id % 4 + 1] AS file_type, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS file_hash FROM ({_NAMED}) WHERE doc_id % 4 < 2")
def s1_listing(spark, sf):
    name = F.concat(F.lit("/data/file"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, [".txt", ".MD", ".exe", ""])), (F.col("doc_id") % 4 + 1).cast("int")))
    rows = table(spark, sf, "documents").select(name.alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    return files.listed(rows).select("filename", "file_type", "size_bytes", "file_hash")


@query("SELECT doc_id, trim(text, ' ' || chr(10)) AS text FROM documents WHERE trim(text, ' ' || chr(10)) <> ''")
def s2_text_source(spark, sf):
    latin = F.col("doc_id") % 2 == 0
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), F.when(latin & (F.decode(F.encode("text", "ISO-8859-1"), "ISO-8859-1") == F.col("text")), F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")).alias("content"))
    return files.text_sections(rows).select(F.col("file_path").alias("doc_id"), "text")


@query("""SELECT conv_id, turn, 0 AS section_index, '' AS section FROM conversations WHERE turn % 2 = 0
    UNION ALL SELECT conv_id, turn, 1 - CAST(turn % 2 AS INT), 'Head ' || role FROM conversations UNION ALL SELECT conv_id, turn, 2 - CAST(turn % 2 AS INT), 'Next' FROM conversations""")
def s3_markdown_source(spark, sf):
    head = F.when(F.col("turn") % 2 == 0, "intro\n").otherwise("")
    body = F.concat(head, F.lit("# Head "), "role", F.lit("\n"), F.regexp_replace("text", "^#+", ""), F.lit("\n#no head\n###  Next\nend"))
    rows = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("file_path"), F.encode(body, "UTF-8").alias("content"))
    return files.markdown_sections(rows).select("file_path.conv_id", "file_path.turn", "section_index", "section")


@query("""WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, 'p_name: ' || p_name || chr(10) || 'p_size: ' || CAST(p_size AS STRING) AS t FROM part)
    SELECT p_brand, CAST((rn - 1) // 20 AS INT) AS section_index, string_agg(t, chr(10) || chr(10) ORDER BY rn) AS text, CAST(min(rn) AS STRING) || '-' || CAST(max(rn) AS STRING) AS row_range FROM r GROUP BY ALL""")
def s4_table_source(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", F.col("p_size").cast("string").alias("p_size"))
    return files.table_sections(rows, "p_brand", ["p_partkey"], ["p_name", "p_size"]).select("p_brand", "section_index", "text", "row_range")


@query("""WITH f AS (SELECT CAST(p_partkey // 50 AS VARCHAR) AS f, p_partkey, p_partkey // 50 % 2 = 0 AS even, p_name, p_size FROM part),
    r AS (SELECT f, even, row_number() OVER (PARTITION BY f ORDER BY p_partkey) AS rn, CASE WHEN even THEN 'p_name: ' || p_name || chr(10) || 'p_size: ' || CAST(p_size AS STRING) ELSE 'Size, mm: ' || CAST(p_size AS STRING) END AS t FROM f WHERE even OR p_size % 7 > 0)
    SELECT f, CAST((rn - 1) // 20 AS INT) AS section_index, string_agg(t, chr(10) || chr(10) ORDER BY rn) AS text, CASE WHEN any_value(even) THEN 'p_name, p_size' ELSE 'Size, mm, Note' END AS columns, CAST(min(rn) AS STRING) || '-' || CAST(max(rn) AS STRING) AS row_range FROM r GROUP BY f, (rn - 1) // 20""")
def s4_csv_source(spark, sf):
    even = F.expr("p_partkey div 50 % 2 = 0")
    line = F.when(even, F.concat(F.lit('"'), "p_name", F.lit('",'), F.col("p_size").cast("string"))).otherwise(F.concat(F.when(F.col("p_size") % 7 > 0, F.col("p_size").cast("string")).otherwise("NA"), F.lit(",")))
    rows = table(spark, sf, "part").select(F.expr("cast(p_partkey div 50 as string)").alias("file_path"), even.alias("even"), F.struct("p_partkey", line.alias("line")).alias("x"))
    head = F.when(F.col("even"), F.lit("p_name,p_size\n")).otherwise(F.lit('"Size, mm",Note\n'))
    whole = rows.groupBy("file_path", "even").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n").alias("body"))  # fifty rows a file
    found = files.csv_sections(whole.select("file_path", F.encode(F.concat(head, "body", F.lit("\n1,2,3,4\n")), "UTF-8").alias("content")))
    return found.select(F.col("file_path").alias("f"), "section_index", "text", "columns", "row_range")


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn, 'key: ' || CAST(p_partkey AS STRING) || chr(10) || 'name: ' || p_name || chr(10) || 'note: size "' || CAST(p_size AS STRING) || '",' || chr(10) || p_type AS t FROM part)
    SELECT substr(p_brand, 7) AS brand, CAST((rn - 1) // 20 AS INT) AS section_index, string_agg(t, chr(10) || chr(10) ORDER BY rn) AS text, 'key, name, note' AS columns, CAST(min(rn) AS STRING) || '-' || CAST(max(rn) AS STRING) AS row_range FROM r GROUP BY p_brand, (rn - 1) // 20""")
def s4_split_csv(spark, sf):
    """A file for each brand, with quoted line feeds, commas and quotes, written by Spark and read in splits."""
    note = F.concat(F.lit('size "'), F.col("p_size").cast("string"), F.lit('",\n'), "p_type")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), note.alias("note"), F.substring("p_brand", 7, 9).alias("brand"))
    folder = new_path(spark, "csv")
    rows.repartition("brand").sortWithinPartitions("brand", "key").write.partitionBy("brand").csv(folder, header=True, quote='"', escape='"', lineSep="\n")
    found = csv_files.sections(spark, f"{folder}/*/*.csv", piece=1 << 16)
    return found.select(F.regexp_extract("file_path", "brand=([0-9]+)", 1).alias("brand"), "section_index", "text", "columns", "row_range")


@query("""SELECT event_id, 0 AS section_index, 'event.type: ' || event_type || chr(10) || 'list[0]: 1' || chr(10) || 'list[1].user: ' || CAST(user_id AS STRING) || chr(10) || 'none: None' AS text FROM events""")
def s5_json_source(spark, sf):
    body = F.concat(F.lit('{"event": {"type": "'), "event_type", F.lit('", "empty": {}}, "list": [1, {"user": '), F.col("user_id").cast("string"), F.lit('}], "none": null}'))
    rows = table(spark, sf, "events").select(F.col("event_id").alias("file_path"), F.encode(body, "UTF-8").alias("content"))
    return files.json_sections(rows).select(F.col("file_path").alias("event_id"), "section_index", "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN doc_id % 3 = 1 THEN NULL ELSE 0 END AS section_index,
    CASE doc_id % 3 WHEN 1 THEN 'No parser for type: zip' WHEN 2 THEN 'No readable content found' END AS error FROM documents""")
def x1_parser(spark, sf):
    kind = F.element_at(F.array(F.lit("txt"), F.lit("zip"), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), kind.alias("file_type"), F.encode("text", "UTF-8").alias("content"))
    out = files.parsed(rows, {"txt": lambda b: [(b.decode() or " x", {})], "none": lambda b: []})
    return out.select(F.col("file_path").cast("long").alias("doc_id"), "section_index", "error")
