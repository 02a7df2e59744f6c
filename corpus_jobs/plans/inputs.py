"""Inputs of the registered queries, derived from the given tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "catalog": """
        SELECT 'd' || CAST(d.doc_id AS STRING) AS id,
               'file' || CAST(d.doc_id AS STRING) || CASE d.doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' WHEN 2 THEN '.csv' WHEN 3 THEN '.png' ELSE '.exe' END AS filename,
               'data/file' || CAST(d.doc_id AS STRING) AS file_path,
               CASE d.doc_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'image' ELSE 'pdf' END AS file_type,
               d.n_chars AS size_bytes, d.n_chars % 17 AS chunks, md5(d.text) AS file_hash,
               CASE WHEN l.quality = 1 THEN 'indexed' WHEN l.quality = 0 THEN 'failed' WHEN d.doc_id % 2 = 0 THEN 'pending' ELSE 'processing' END AS status,
               (d.doc_id * 7919) % 100003 AS created_at
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "log": """
        SELECT event_type AS question, 'dataset' AS answer_type, CAST(event_id % 101 AS DOUBLE) / 100 AS confidence, 'm' AS model,
               value AS response_time, event_id AS created_at
        FROM {events}""",
    "messages": """
        SELECT CAST(conv_id AS STRING) AS conversation_id, (turn * 3) % 7 AS created_at, turn AS seq, role, conv_id,
               CASE WHEN (conv_id + turn) % 3 = 0 THEN text || ' see DOC-' || lpad(CAST(conv_id % 1000 AS STRING), 5, '0') || ' and SIH ' || CAST(10000 + turn AS STRING) ELSE text END AS content,
               CASE WHEN turn % 2 = 0 THEN '[{"file_name":"f' || CAST(turn AS STRING) || '","document_id":"d1","score":0.5}]' ELSE 'not json' END AS sources
        FROM {conversations}""",
    "questions": """
        SELECT conv_id * 100 + turn AS query_id, CAST(conv_id AS STRING) AS conversation_id, turn AS k, conv_id,
               CASE WHEN turn % 2 = 1 THEN text || ' ' ELSE '' END || CASE (conv_id + turn) % 12
                 WHEN 0 THEN 'What is the theme of DOC-' || lpad(CAST(conv_id % 100000 AS STRING), 5, '0') || '?'
                 WHEN 1 THEN 'SIH ' || lpad(CAST(conv_id % 100000 AS STRING), 5, '0')
                 WHEN 2 THEN 'Compare SIH' || lpad(CAST(conv_id % 100000 AS STRING), 5, '0') || ' and ABC-2026-001'
                 WHEN 3 THEN 'who sponsors it'
                 WHEN 4 THEN 'summarize page ' || CAST(turn + 1 AS STRING)
                 WHEN 5 THEN 'the ' || CAST(turn + 3 AS STRING) || 'th page'
                 WHEN 6 THEN 'my notes'
                 WHEN 7 THEN 'discount table'
                 WHEN 8 THEN 'solar panels'
                 WHEN 9 THEN 'Why do rivers carry more water in spring than in autumn'
                 WHEN 10 THEN lpad(CAST(conv_id % 100000 AS STRING), 5, '0')
                 ELSE 'give me an overview of the projects' END || CASE WHEN (conv_id + turn) % 5 = 4 THEN ' ' || text ELSE '' END AS message
        FROM {conversations}""",
    "pages": """
        SELECT 'd' || CAST(o_orderkey % 50 AS STRING) AS document_id, 'catalogue.pdf' AS file_name, CAST(o_orderkey AS INT) AS page_number, o_orderkey,
               'Intro ' || o_orderstatus || chr(10) || 'sih-' || CAST(10000 + o_orderkey % 89999 AS STRING) || ' Title: Plan ' || o_orderpriority || ' | Track: ' || o_orderstatus || chr(10)
               || 'Theme: Water' || chr(10) || 'Sponsor: Office ' || CAST(o_custkey AS STRING) || chr(10) || 'Description: build ' || CAST(o_custkey AS STRING) || ' wells'
               || chr(10) || 'SIH ' || CAST(1000 + o_custkey % 8999 AS STRING) || chr(10) || 'Category: Soft | name: N' || CAST(o_custkey AS STRING) AS text
        FROM {orders}""",
    "records": """
        SELECT 'r' || CAST(p_partkey AS STRING) AS id, 'd' || CAST(p_size AS STRING) AS document_id, 'SIH' || CAST(10000 + p_partkey % 89999 AS STRING) AS identifier,
               CASE WHEN p_partkey % 3 = 0 THEN 'SIH' || CAST(10000 + p_partkey % 89999 AS STRING) ELSE 'PS-' || CAST(p_partkey AS STRING) END AS ps_code, p_type AS track,
               p_name AS problem_statement_title, p_brand AS theme, '' AS sponsoring_ministry, '' AS problem_statement, p_size AS page_number, 'raw ' || p_name AS raw_text
        FROM {part}""",
    "chunks": """
        SELECT 'c' || CAST(p_partkey AS STRING) AS chunk_id, 'd' || CAST(p_size AS STRING) AS document_id, p_brand AS file_name, p_size AS page_number,
               CASE WHEN p_partkey % 6 = 0 THEN 'About sih: ' || CAST(10000 + p_partkey % 89999 AS STRING) || ' ' || p_name WHEN p_partkey % 2 = 0 THEN 'About sih ' || CAST(10000 + p_partkey % 89999 AS STRING) || ' ' || p_name ELSE p_name END AS text,
               CASE WHEN p_partkey % 4 = 1 THEN 'SIH' || CAST(10000 + p_partkey % 89999 AS STRING) ELSE '' END AS identifier, '' AS ps_code,
               CASE WHEN p_size % 2 = 0 THEN 'png' ELSE 'pdf' END AS file_type, CASE WHEN p_partkey % 10 = 0 THEN 'image' ELSE 'pdf' END AS source_type
        FROM {part}""",
    "asked": """
        SELECT p_partkey AS query_id, 'sih-' || CAST(10000 + p_partkey % 89999 AS STRING) AS ident, 1 AS ident_no FROM {part}
        UNION ALL
        SELECT p_partkey AS query_id, 'PS ' || CAST(p_partkey + 1 AS STRING) AS ident, 2 AS ident_no FROM {part}""",
    "candidates": """
        SELECT l_orderkey AS query_id, 1 + l_linenumber % 3 AS list_no, 'c' || CAST(l_partkey % 40 AS STRING) AS chunk_id, 'd' || CAST(l_suppkey % 5 AS STRING) AS document_id,
               l_quantity / 10 AS score, CAST(1 + l_suppkey % 6 AS INT) AS meta_keys, l_linenumber, l_partkey, l_suppkey,
               row_number() OVER (PARTITION BY l_orderkey, 1 + l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank
        FROM {lineitem}""",
    "ranked": """
        SELECT l_orderkey AS query_id, CAST(n AS INT) AS rank, 'c' || CAST(l_partkey AS STRING) AS chunk_id, 'd' || CAST(l_suppkey % 3 AS STRING) AS document_id,
               round(l_discount * 10, 1) AS score, l_extendedprice % 97 / 97 AS model_score, l_linestatus = 'O' AND l_returnflag = 'N' AND n = 2 AS is_exact,
               CASE WHEN l_orderkey % 4 = 0 THEN 'image_note' ELSE 'semantic' END AS intent, l_suppkey % 4 = 0 AS is_image,
               'text ' || l_shipmode_text || ' ' || CAST(l_partkey % 3 AS STRING) AS text, CAST(l_partkey % 6 AS INT) AS page_number, CAST(l_suppkey % 3 AS INT) AS slide_number,
               'file' || CAST(l_suppkey % 3 AS STRING) || '.pdf' AS file_name, 'pdf' AS file_type, CASE WHEN l_partkey % 5 = 0 THEN 'S' || CAST(l_partkey % 2 AS STRING) ELSE '' END AS section
        FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode_text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM {lineitem}) x""",
    "ocr_words": """
        SELECT CAST(conv_id AS STRING) AS image_id, CAST(conv_id % 3 AS INT) AS block_num, CAST(turn % 4 AS INT) AS line_num, CAST(turn AS INT) AS word_no,
               CASE WHEN turn % 9 = 8 THEN ' ' WHEN turn % 4 = 3 THEN 'Notes' WHEN turn % 4 = 2 THEN '* w' || CAST(turn AS STRING) ELSE 'w' || CAST(turn AS STRING) END AS text,
               CAST((conv_id * 13 + turn * 31) % 100 AS DOUBLE) AS conf, CAST(turn * 10 AS INT) AS "left", CAST(conv_id % 50 AS INT) AS top, CAST(8 + turn AS INT) AS width, CAST(12 AS INT) AS height
        FROM {conversations}""",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name].replace('"left"', "`left`")
    used = set(re.findall(r"\{(\w+)\}", sql))
    views = {}
    for t in used:
        views[t] = f"corpus_jobs_{t}"
        table(spark, sf_dir, t).createOrReplaceTempView(views[t])
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: views[m[1]], sql))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(sql: str) -> str:
    """SQL with the named inputs that it uses, `$name`, as common table expressions."""
    used = list(dict.fromkeys(re.findall(r"\$(\w+)", sql)))
    ctes = ", ".join(f"in_{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', SQL[n])})" for n in used)
    body = re.sub(r"\$(\w+)", r"in_\1", sql).strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
