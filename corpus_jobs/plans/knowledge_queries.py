"""Queries of the catalogue, conversations, statistics, marks, recognised text and file events."""

from pyspark.sql import functions as F

from ..functions import routing
from ..operators import analytics, bucketed, catalog, conversations, marks, ocr
from ..sources import files
from ..storage import new_path
from ..streaming import arrivals, watch
from .inputs import frame, table
from .registry import query
from .routing_sql import holds


@query("SELECT id FROM $catalog WHERE filename NOT LIKE '%.exe' AND size_bytes > 0 AND size_bytes <= 52428800")
def p1_admission(spark, sf):
    return files.admitted(frame(spark, sf, "catalog")).select("id")


@query(f"""SELECT conv_id, turn, {holds("lower(t)", ocr.FORBIDDEN)} AS forbidden FROM (SELECT conv_id, turn, (['[IMAGE: x] ', 'OCR processing complete', 'plain ', ''])[(conv_id + turn) % 4 + 1] || text AS t FROM conversations)""")
def p3_forbidden_text(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ["[IMAGE: x] ", "OCR processing complete", "plain ", ""])), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", ocr.is_forbidden(F.concat(lead, "text")).alias("forbidden"))


def _listing(spark, sf):
    """The files that the catalogue may know by id, by path, by bare name, or not at all."""
    n = F.col("doc_id")
    path = F.when(n % 4 == 1, F.concat(F.lit("data/file"), n.cast("string"))).otherwise(F.concat(F.lit("other/file"), n.cast("string")))
    name = F.when(n % 4 == 2, F.concat(F.lit("data/file"), n.cast("string"))).otherwise(F.lit("new.txt"))
    body = F.when(n % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", path.alias("file_path"), name.alias("filename"), F.md5(body).alias("file_hash"), F.when(n % 4 == 0, F.concat(F.lit("d"), n.cast("string"))).alias("target_id"))


@query("""SELECT d.doc_id, CASE WHEN doc_id % 4 = 3 THEN 'new' WHEN doc_id % 5 > 0 AND status = 'indexed' THEN 'unchanged' ELSE 'changed' END AS change,
    CASE WHEN doc_id % 4 < 3 THEN id ELSE substr(sha256('other/file' || CAST(doc_id AS STRING)), 1, 16) END AS document_id, CASE WHEN doc_id % 4 < 3 THEN created_at END AS created_at
    FROM documents d JOIN $catalog ON id = 'd' || CAST(doc_id AS STRING)""")
def j5_changes(spark, sf):
    return catalog.changes(_listing(spark, sf), frame(spark, sf, "catalog")).select("doc_id", "change", "document_id", "created_at")


@query("SELECT file_hash, count(*) AS n, min(id) AS first_id FROM $catalog GROUP BY file_hash HAVING count(*) > 1")
def j6_duplicate_content(spark, sf):
    return catalog.duplicates(frame(spark, sf, "catalog"))


@query("""SELECT e.event_id, min(c.id) AS same_as FROM (SELECT event_id, md5(text) AS h FROM events LEFT JOIN documents ON doc_id = event_id % 5000) e LEFT JOIN $catalog c ON c.file_hash = e.h GROUP BY e.event_id""")
def j6_same_content(spark, sf):
    events, docs = table(spark, sf, "events"), table(spark, sf, "documents")
    listing = events.join(docs, F.col("doc_id") == F.col("event_id") % 5000, "left").select("event_id", F.md5("text").alias("file_hash"))
    return catalog.same_content(listing, frame(spark, sf, "catalog")).select("event_id", "same_as")


def _stored_rows(spark, name, rows, bucket_key=None):
    """Rows as a table in buckets, written by a first batch."""
    t = bucketed.table(spark, new_path(spark, name), rows.schema, "id", bucket_key, buckets=16)
    bucketed.upsert(t, rows, 1)
    return t


@query("""SELECT 'pages' AS t, o_orderkey AS k FROM orders WHERE o_orderkey % 50 NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')
    UNION ALL SELECT 'records', p_partkey FROM part WHERE p_size NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')""")
def j7_delete_cascade(spark, sf):
    gone = table(spark, sf, "documents").filter("source = 'src1'").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    pages = frame(spark, sf, "pages").select(F.col("o_orderkey").cast("string").alias("id"), "document_id", "o_orderkey")
    tables = {n: _stored_rows(spark, n, rows, "document_id") for n, rows in (("pages", pages), ("records", frame(spark, sf, "records")))}
    bucketed.cascade(gone, 2, *tables.values())
    records = tables["records"].rows().select(F.lit("records").alias("t"), F.substring("id", 2, 12).cast("long").alias("k"))
    return tables["pages"].rows().select(F.lit("pages").alias("t"), F.col("o_orderkey").alias("k")).unionByName(records)


@query("""WITH c AS (SELECT 'd' || CAST(doc_id AS STRING) AS document_id, bool_or(doc_id % 5 = 0) AS broken FROM documents WHERE doc_id % 7 > 0 GROUP BY ALL)
    SELECT id FROM $catalog LEFT JOIN c ON id = document_id WHERE file_type = 'image' AND coalesce(broken, true)""")
def j8_images_to_reprocess(spark, sf):
    chunks = table(spark, sf, "documents").select(F.concat(F.expr("if(doc_id % 7 = 0, 'other', 'd')"), F.col("doc_id").cast("string")).alias("document_id"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Visual Content "), "text")).otherwise("t").alias("text"))
    return catalog.images_to_reprocess(frame(spark, sf, "catalog"), chunks).select("id")


@query("SELECT id FROM $catalog WHERE NOT (size_bytes % 3 = 0 AND status = 'indexed')")
def j9_stale_previews(spark, sf):
    c = frame(spark, sf, "catalog")
    manifests = c.select(F.col("id").alias("document_id"), F.when(F.col("size_bytes") % 3 == 0, F.col("file_hash")).otherwise("old").alias("file_hash"), F.when(F.col("status") == "indexed", "ready").otherwise("failed").alias("status"))
    return catalog.stale_previews(c, manifests).select("id")


@query("""SELECT 'message' AS t, conversation_id, count(*) AS n FROM $messages WHERE conv_id % 3 > 0 GROUP BY conversation_id UNION ALL SELECT 'conversation', conversation_id, 1 FROM (SELECT DISTINCT conversation_id, conv_id FROM $messages) WHERE conv_id % 3 > 0""")
def j10_delete_conversations(spark, sf):
    m = frame(spark, sf, "messages")
    convs, left = conversations.deleted(m.select("conversation_id").distinct(), m, m.filter("conv_id % 3 = 0"))
    return left.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit("message")).unionByName(convs.withColumn("n", F.lit(1).cast("long")).withColumn("t", F.lit("conversation")))


@query("""WITH c AS (SELECT 'd' || CAST(conv_id AS STRING) AS document_id, string_agg(text, chr(10) || chr(10) || '--- CHUNK BREAK ---' || chr(10) || chr(10) ORDER BY turn) AS full_text, count(*) AS n, arg_min(turn, turn) FILTER (turn % 2 = 1) AS raw, count(*) FILTER (turn % 3 = 0) AS blocks FROM conversations GROUP BY conv_id)
    SELECT id, coalesce(n, chunks) AS chunks_count, coalesce(full_text, 'No text extracted yet.') AS full_text, coalesce('raw ' || CAST(raw AS STRING), full_text, 'No text extracted yet.') AS raw_ocr, coalesce(blocks, 0) AS n_blocks FROM $catalog LEFT JOIN c ON id = document_id""")
def j11_documents_with_text(spark, sf):
    turn = F.col("turn")
    chunks = table(spark, sf, "conversations").select(
        F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("document_id"), F.lit(0).alias("section_index"), turn.alias("chunk_index"), turn.cast("string").alias("chunk_id"), "text",
        F.when(turn % 2 == 1, F.concat(F.lit("raw "), turn.cast("string"))).alias("raw_ocr"), F.lit("").alias("structured_ocr"), F.when(turn % 3 == 0, F.lit('[{"block_id":"b0","text":"t"}]')).otherwise("no json").alias("layout_blocks"),
    )
    out = analytics.documents_with_text(frame(spark, sf, "catalog"), chunks)
    return out.select("id", "chunks_count", "full_text", "raw_ocr", F.size("layout_blocks").alias("n_blocks"))


@query("""SELECT id, CASE WHEN u THEN 'new' ELSE status END AS status, CASE WHEN u THEN id || ' v2' ELSE filename END AS filename FROM (SELECT *, size_bytes % 2 = 0 AS u FROM $catalog)""")
def s6_upsert(spark, sf):
    c = frame(spark, sf, "catalog").select("id", "filename", "status", "size_bytes")
    new = c.filter("size_bytes % 2 = 0").withColumn("status", F.lit("n\0ew"))
    both = new.withColumns({"filename": F.concat("id", F.lit(" v1")), "v": F.lit(1)}).unionByName(new.withColumns({"filename": F.concat("id", F.lit(" v2")), "v": F.lit(2)}))
    t = _stored_rows(spark, "catalog", c)
    bucketed.upsert(t, both, 2, ["v"])
    return t.rows().select("id", "status", "filename")


@query("""SELECT doc_id, CASE WHEN p + CASE WHEN g % 3 = 0 THEN 1 ELSE 0 END = 0 THEN 'f' || g || '.txt' ELSE 'f' || g || '_' || CAST(p + CASE WHEN g % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN g % 2 = 0 AND p + CASE WHEN g % 3 = 0 THEN 1 ELSE 0 END >= 2 THEN 1 ELSE 0 END AS STRING) || '.txt' END AS dest
    FROM (SELECT doc_id, doc_id % 97 AS g, row_number() OVER (PARTITION BY doc_id % 97 ORDER BY doc_id) - 1 AS p FROM documents)""")
def u3_names(spark, sf):
    g = (F.col("doc_id") % 97).cast("string")
    uploads = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), g, F.lit(".txt")).alias("filename"), F.col("doc_id").alias("seq"))
    groups = table(spark, sf, "documents").select((F.col("doc_id") % 97).alias("g")).distinct()
    bare = groups.filter("g % 3 = 0").select(F.concat(F.lit("f"), F.col("g").cast("string"), F.lit(".txt")).alias("filename"))
    second = groups.filter("g % 2 = 0").select(F.concat(F.lit("f"), F.col("g").cast("string"), F.lit("_2.txt")).alias("filename"))
    return catalog.numbered_names(uploads, bare.unionByName(second)).select("doc_id", "dest")


@query("SELECT id, created_at FROM $catalog ORDER BY created_at DESC, id")
def l1_documents(spark, sf):
    return catalog.newest_first(frame(spark, sf, "catalog")).select("id", "created_at")


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status IN ('pending', 'processing')) AS pending, count(*) FILTER (status = 'failed') AS failed, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size FROM $catalog""")
def a1_document_stats(spark, sf):
    return analytics.document_stats(frame(spark, sf, "catalog"))


@query("SELECT file_type, count(*) AS count FROM $catalog GROUP BY file_type")
def a2_by_type(spark, sf):
    return analytics.documents_by_type(frame(spark, sf, "catalog"))


@query("SELECT count(*) AS total, round(coalesce(CAST(sum(CAST(response_time AS DECIMAL(18, 6))) AS DOUBLE) / count(response_time), 0), 6) AS avg_time, round(coalesce(CAST(sum(CAST(confidence AS DECIMAL(18, 6))) AS DOUBLE) / count(confidence), 0), 6) AS avg_conf FROM $log")
def a3_query_stats(spark, sf):
    s = analytics.query_stats(frame(spark, sf, "log"))
    return s.select("total", F.round("avg_time", 6).alias("avg_time"), F.round("avg_conf", 6).alias("avg_conf"))


@query("""SELECT (SELECT count(*) FROM $catalog) AS total_documents, (SELECT count(*) FROM $log) AS total_queries, (SELECT round(CAST(sum(CAST(response_time AS DECIMAL(18, 6))) AS DOUBLE) / count(response_time), 1) FROM $log) AS avg_response_time_ms, (SELECT round(CAST(sum(CAST(confidence AS DECIMAL(18, 6))) AS DOUBLE) / count(confidence), 4) FROM $log) AS avg_confidence,
    (SELECT string_agg(file_type || '=' || CAST(n AS STRING), ',' ORDER BY file_type) FROM (SELECT file_type, count(*) AS n FROM $catalog GROUP BY file_type)) AS by_type""")
def a4_report(spark, sf):
    r = analytics.report(frame(spark, sf, "catalog"), frame(spark, sf, "log"))
    by = F.array_join(F.transform("documents_by_type", lambda x: F.concat(x.file_type, F.lit("="), x["count"].cast("string"))), ",")
    return r.select("total_documents", "total_queries", "avg_response_time_ms", "avg_confidence", by.alias("by_type"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, seq) AS p FROM $messages),
    g AS (SELECT conversation_id, CASE WHEN any_value(conv_id) % 2 = 0 THEN 'New Conversation' END AS given, min(created_at) AS created_at, max(created_at) AS updated_at, count(*) AS n_messages, arg_min(content, p) AS first, arg_min(content, p) FILTER (role = 'user') AS said FROM m GROUP BY conversation_id)
    SELECT conversation_id, CASE WHEN given IS NULL THEN t(first) WHEN said IS NULL THEN given ELSE t(said) END AS title, created_at, updated_at, n_messages FROM g""".replace("t(first)", "CASE WHEN length(first) > 35 THEN substr(first, 1, 35) || '...' ELSE first END").replace("t(said)", "CASE WHEN length(said) > 35 THEN substr(said, 1, 35) || '...' ELSE said END"))
def a5_conversations(spark, sf):
    m = frame(spark, sf, "messages")
    titles = m.filter("conv_id % 2 = 0").select("conversation_id", F.lit("New Conversation").alias("title")).distinct()
    return conversations.roll_up(m, titles)


@query("""SELECT conversation_id, seq, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, seq) AS n FROM (SELECT * FROM $messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, seq DESC) <= 3)""")
def w2_recent_messages(spark, sf):
    return conversations.recent(frame(spark, sf, "messages"), 3).select("conversation_id", "seq", "n")


@query("SELECT conversation_id, max(created_at) AS updated_at FROM $messages GROUP BY conversation_id ORDER BY 2 DESC, 1")
def l2_conversations(spark, sf):
    return conversations.latest_first(conversations.roll_up(frame(spark, sf, "messages"))).select("conversation_id", "updated_at")


@query("""SELECT conversation_id, string_agg(CAST(seq AS STRING) || ':' || CASE WHEN seq % 2 = 0 THEN 'f' || CAST(seq AS STRING) ELSE '' END, ',' ORDER BY created_at, seq) AS messages FROM $messages GROUP BY conversation_id""")
def l3_conversation_messages(spark, sf):
    m = frame(spark, sf, "messages")
    out = conversations.with_messages(m.select("conversation_id").distinct(), m)
    text = F.array_join(F.transform("messages", lambda x: F.concat(x.seq.cast("string"), F.lit(":"), F.array_join(F.transform(x.sources, lambda s: s.file_name), "+"))), ",")
    return out.select("conversation_id", text.alias("messages"))


_HISTORY = """h AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, seq) AS p, (conv_id + seq) % 3 = 0 AS has FROM $messages)"""


@query(f"""WITH {_HISTORY} SELECT conversation_id, seq, CASE WHEN max(CASE WHEN has THEN p END) OVER w IS NULL THEN 'who sponsors it' ELSE 'who sponsors SIH' || CAST(10000 + last(CASE WHEN has THEN seq END IGNORE NULLS) OVER w AS STRING) END AS resolved
    FROM h WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w1_follow_up(spark, sf):
    h = routing.with_history(frame(spark, sf, "messages"))
    return h.select("conversation_id", "seq", F.coalesce(routing.resolve(F.lit("who sponsors it"), F.col("last_id")), F.lit("who sponsors it")).alias("resolved"))


@query(f"""WITH {_HISTORY} SELECT conversation_id, seq, CASE WHEN p = 1 THEN 'it?' ELSE 'Previous Conversation Context:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || content, chr(10)) OVER w || chr(10) || chr(10) || 'Current Question: it?' END AS question
    FROM h WINDOW w AS (PARTITION BY conversation_id ORDER BY created_at, seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w3_expanded_question(spark, sf):
    h = routing.with_history(frame(spark, sf, "messages"))
    return h.select("conversation_id", "seq", routing.expanded(F.lit("it?"), F.col("history")).alias("question"))


@query("SELECT event_type AS question, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def s7_query_log(spark, sf):
    from ..storage import new_path

    path = new_path(spark, "log")
    rows = frame(spark, sf, "log")
    analytics.append_log(rows.filter("created_at % 2 = 0"), path)
    analytics.append_log(rows.filter("created_at % 2 <> 0"), path)
    return spark.read.parquet(path).groupBy("question").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("response_time"), 2).alias("total"))


@query("SELECT id AS document_id, file_hash, 'ready' AS status, CAST(size_bytes AS INT) AS page_count, filename FROM $catalog WHERE file_type = 'pdf'")
def s8_preview_manifests(spark, sf):
    from ..storage import new_path

    # folders of files that hold one JSON text over several lines each, as a preview service leaves them
    path = new_path(spark, "previews")
    c = frame(spark, sf, "catalog").filter("file_type = 'pdf'")
    one = F.struct(F.col("id").alias("document_id"), "filename", "file_hash", F.lit("ready").alias("status"), F.col("size_bytes").cast("int").alias("page_count"))
    shelf = F.expr("cast(substring(id, 2) as long) div 500")
    files_of = c.groupBy(shelf.alias("shelf")).agg(F.to_json(F.collect_list(one), {"pretty": "true"}).alias("value"))  # at most 500 documents
    files_of.withColumn("folder", F.col("shelf") % 8).select("folder", "value").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(path)
    return files.preview_manifests(spark, path, "part-*").select("document_id", "file_hash", "status", "page_count", "filename")


@query("SELECT p_partkey, CAST(p_size + p_retailprice AS DOUBLE) AS total_marks FROM part")
def a6_row_totals(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("roll_no"), F.col("p_name").alias("student"), "p_size", "p_retailprice")
    return marks.with_total(t).select(F.col("roll_no").alias("p_partkey"), "total_marks")


@query("""SELECT * FROM (SELECT 'top' AS which, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) UNION ALL SELECT * FROM (SELECT 'lowest', c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1)""")
def a7_topper_lowest(spark, sf):
    c = table(spark, sf, "customer")
    top, low = marks.extreme(c, "c_acctbal", "c_custkey"), marks.extreme(c, "c_acctbal", "c_custkey", highest=False)
    return top.select(F.lit("top").alias("which"), "c_name", "c_acctbal").unionByName(low.select(F.lit("lowest").alias("which"), "c_name", "c_acctbal"))


@query("SELECT p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def a8_best_in_subject(spark, sf):
    return marks.extreme(table(spark, sf, "part"), "p_retailprice", "p_partkey").select("p_name", "p_retailprice")


@query("SELECT round(avg(p_size), 2) AS p_size, round(avg(p_retailprice), 2) AS p_retailprice FROM part")
def a9_averages(spark, sf):
    return marks.averages(table(spark, sf, "part"), ["p_size", "p_retailprice"])


@query("""SELECT subject, round(avg(v), 2) AS average, max(v) AS highest, min(v) AS lowest, round(stddev_samp(v), 2) AS std_dev FROM (
    SELECT 'l_quantity' AS subject, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY subject""")
def a10_subject_analysis(spark, sf):
    return marks.subject_analysis(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) AS total, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS percentage FROM orders")
def a11_pass_rate(spark, sf):
    o = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "Passed").otherwise("no").alias("result"))
    return marks.pass_rate(o)


@query("""WITH a AS (SELECT * FROM supplier WHERE s_name LIKE '%1' ORDER BY s_suppkey LIMIT 1), b AS (SELECT * FROM supplier WHERE s_name LIKE '%2%' ORDER BY s_suppkey LIMIT 1)
    SELECT 's_acctbal' AS subject, a.s_acctbal AS first, b.s_acctbal AS second FROM a, b UNION ALL SELECT 's_nationkey', CAST(a.s_nationkey AS DOUBLE), CAST(b.s_nationkey AS DOUBLE) FROM a, b""".replace("'%1'", "'%1%'"))
def a12_compare(spark, sf):
    return marks.compare(table(spark, sf, "supplier"), "1", "2", "s_suppkey", ["s_acctbal", "s_nationkey"], "s_name")


@query("SELECT c_name, c_acctbal AS total_marks, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 10")
def l4_top_students(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_acctbal", "total")
    return marks.top_students(c, 10, "c_custkey").select("c_name", "total_marks", "rank")


_LINES = """w AS (SELECT *, CASE WHEN conf > 0 AND conf < 35 THEN '[unclear]' ELSE trim(text) END AS t FROM $ocr_words WHERE trim(text) <> ''),
    l AS (SELECT image_id, block_num, line_num, string_agg(t, ' ' ORDER BY word_no) AS text, min("left") AS x, min(top) AS y, max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h, round(avg(conf) / 100, 2) AS confidence FROM w GROUP BY image_id, block_num, line_num)"""
_TYPE = "CASE WHEN text LIKE '*%' THEN 'bullet' WHEN contains(text, 'Notes') THEN 'heading' ELSE 'paragraph' END"


@query(f"""WITH {_LINES} SELECT image_id, 'b' || CAST(row_number() OVER (PARTITION BY image_id ORDER BY block_num, line_num) - 1 AS STRING) AS block_id, text, {_TYPE} AS type, x, y, w, h, confidence FROM l""")
def a13_layout_lines(spark, sf):
    return ocr.layout_lines(frame(spark, sf, "ocr_words")).select("image_id", "block_id", "text", "type", "bbox.x", "bbox.y", "bbox.w", "bbox.h", "confidence")


@query(f"""WITH {_LINES} SELECT image_id, regexp_replace(string_agg(CASE {_TYPE} WHEN 'heading' THEN chr(10) || '### ' || text || chr(10) WHEN 'bullet' THEN '  • ' || regexp_replace(text, '^[•* -]+', '') ELSE text END, chr(10) ORDER BY block_num, line_num), '^\\s+|\\s+$', '', 'g') AS structured_ocr FROM l GROUP BY image_id""")
def a13_structured_text(spark, sf):
    return ocr.structured_text(ocr.layout_lines(frame(spark, sf, "ocr_words")))


@query("""WITH r AS (SELECT conv_id, turn, 2 AS e, lower(role) || ' says  this' AS line FROM conversations UNION ALL SELECT conv_id, turn, 1, upper(role) || ' says this' FROM conversations),
    f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(replace(line, '  ', ' ')) ORDER BY e) = 1)
    SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY e) AS raw_ocr, 'low' AS ocr_confidence FROM f GROUP BY conv_id, turn""")
def a14_line_merge(spark, sf):
    c = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("image_id"), "role")
    two = c.select("image_id", F.lit(2).alias("engine_no"), F.concat(F.lit("ab\n"), F.lower("role"), F.lit(" says  this\n")).alias("text"))
    one = c.select("image_id", F.lit(1).alias("engine_no"), F.concat(F.upper("role"), F.lit(" says this\nvisual content")).alias("text"))
    return ocr.merged_lines(one.unionByName(two)).select("image_id.conv_id", "image_id.turn", "raw_ocr", "ocr_confidence")


@query(f"""SELECT page_id FROM (SELECT page_id, regexp_extract(p, '[^/]*$') AS name FROM (SELECT page_id, url || (['.pdf', '/a.JPG', '/.a.txt', '.exe', ''])[page_id % 5 + 1] AS p FROM pages))
    WHERE NOT starts_with(name, '.') AND lower(regexp_extract(name, '[^./](\\.[^./]+)$', 1)) IN ({", ".join(f"'{e}'" for e in files.EXTENSIONS)})""")
def t1_watched_files(spark, sf):
    end = F.element_at(F.array(*map(F.lit, [".pdf", "/a.JPG", "/.a.txt", ".exe", ""])), (F.col("page_id") % 5 + 1).cast("int"))
    return watch.watched(table(spark, sf, "pages").select("page_id", F.concat("url", end).alias("path"), F.lit("created").alias("kind"))).select("page_id")


@query("""SELECT doc_id, sha256(t) AS file_hash, strlen(t) AS size_bytes, 'indexed' AS status FROM (SELECT doc_id, CASE WHEN source = 'src2' THEN text || ' rewritten' ELSE text END AS t FROM documents WHERE source IS DISTINCT FROM 'src1' AND text IS NOT NULL)""")
def t1_arrival_stream(spark, sf):
    """All documents arrive as files, those of one source are rewritten later and those of another deleted; the stream takes
    them in several batches and leaves the tables of the last state."""
    folder = new_path(spark, "uploads")
    docs = table(spark, sf, "documents").filter("text is not null").select(F.concat(F.lit("/files/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "source")
    steps = [("created", docs), ("modified", docs.filter("source = 'src2'").withColumn("text", F.concat("text", F.lit(" rewritten")))), ("deleted", docs.filter("source = 'src1'"))]
    for n, (kind, rows) in enumerate(steps):
        content = F.encode("text", "UTF-8")
        rows.select("path", F.lit(kind).alias("kind"), F.timestamp_seconds(F.lit(n)).alias("ts"), F.length(content).cast("long").alias("length"), content.alias("content")).write.parquet(f"{folder}/{n}")
    stream = spark.readStream.schema("path string, kind string, ts timestamp, length long, content binary").option("maxFilesPerTrigger", 8).parquet(f"{folder}/*")
    k = arrivals.knowledge(spark, new_path(spark, "knowledge"), buckets=8)
    arrivals.follow_rows(k, stream, new_path(spark, "progress"), {"availableNow": True}).awaitTermination()
    return k.documents.rows().select(F.regexp_extract("filename", r"\d+", 0).cast("long").alias("doc_id"), "file_hash", "size_bytes", "status")


@query("""WITH RECURSIVE e AS (SELECT '/data/' || CAST(user_id AS STRING) || '.txt' AS path, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
    k AS (SELECT path, event_id, us, p FROM e WHERE p = 1
          UNION ALL SELECT x.path, x.event_id, x.us, x.p FROM (SELECT e.*, row_number() OVER (PARTITION BY e.path ORDER BY e.p) AS r FROM k JOIN e ON e.path = k.path AND e.p > k.p AND e.us - k.us >= 14400000000) x WHERE x.r = 1)
    SELECT path, event_id FROM k""")
def t2_debounce(spark, sf):
    """Each user's file; events of one file are hours apart, so the interval is four hours."""
    path = F.concat(F.lit("/data/"), F.col("user_id").cast("string"), F.lit(".txt"))
    events = table(spark, sf, "events").select(path.alias("path"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return watch.debounced_batch(events, 14400.0).select("path", "event_id")


@query("""SELECT id FROM $catalog WHERE size_bytes % 4 > 0""")
def t3_delete_events(spark, sf):
    c = frame(spark, sf, "catalog")
    events = c.select(F.concat("file_path", F.lit(".txt")).alias("path"), F.when(F.col("size_bytes") % 4 == 0, "deleted").otherwise("modified").alias("kind"), "id")
    gone = watch.deletions(watch.watched(events)).select("id")
    return catalog.without(gone, catalog=(c, "id"))["catalog"].select("id")
