"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import ctw, decontamination, langid, line_dedup, mixing, packing, phrases, pii, quality, ranked_search, simhash, token_counts, token_files

QUERIES = {
    f.__name__: f
    for f in (
        simhash.op1_simhash_near_dedup,
        quality.op2_host_quality_rules,
        pii.op3_pii_crf,
        decontamination.op4_benchmark_decontamination,
        ctw.op5_ctw_scores,
        langid.op6_language_id,
        packing.op7_nnls_packing,
        token_files.op8_orc_token_ids,
        token_counts.op9_token_counts,
        line_dedup.op10_line_dedup,
        ranked_search.op11_ranked_search,
        mixing.op12_source_mixing,
        phrases.op13_phrase_collocations,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINE_DEDUP = f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM l),
    h AS (SELECT k, min(doc_id) AS owner FROM k WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (owner IS NULL OR owner = doc_id), '')) AS kept_sha256
    FROM k LEFT JOIN h USING (k) GROUP BY doc_id"""

_RULES = {rule: sql.replace("m.", "").format(a="{0}") for rule, sql in quality.SOFT_RULES.items()}
_ALLOWED = """1 + (1 - (f_{0} + s_{0} * p_{0}) / (n + s_{0})) AS allowed_{0}"""
_RHO = """((q_{0} - all_n * p_{0} * p_{0}) / nullif(p_{0} * (1 - p_{0}), 0) - k + 1) / nullif(spare, 0) AS rho_{0}"""
_STRENGTH = """CASE WHEN rho_{0} > 0 THEN least(1e6, greatest(10.0, (1 - rho_{0}) / rho_{0})) ELSE 1e6 END AS s_{0}"""

_QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
    g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS c FROM i),
    r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (SELECT unnest(range(5)) AS o) WHERE c > 1 GROUP BY doc_id),
    e AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    m AS (SELECT doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
          coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN r USING (doc_id) LEFT JOIN e USING (doc_id)),
    h AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER ({sql.format(1)}) AS f_{rule}" for rule, sql in _RULES.items())} FROM m GROUP BY source),
    p AS (SELECT sum(n) AS all_n, sum(n) - sum(n * n) / sum(n) - count(*) + 1 AS spare, count(*) AS k, {", ".join(f"sum(f_{rule}) / sum(n) AS p_{rule}, sum(f_{rule} * f_{rule} / n) AS q_{rule}" for rule in _RULES)} FROM h),
    o AS (SELECT *, {", ".join(_RHO.format(rule) for rule in _RULES)} FROM p),
    t AS (SELECT h.*, o.*, {", ".join(_STRENGTH.format(rule) for rule in _RULES)} FROM h, o),
    v AS (SELECT source, {", ".join(_ALLOWED.format(rule) for rule in _RULES)} FROM t),
    b AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, v.* EXCLUDE (source) FROM m LEFT JOIN v ON m.source IS NOT DISTINCT FROM v.source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"({sql.format('allowed_' + rule)})" for rule, sql in _RULES.items())}) AS kept FROM b"""

#: The other operators' results need hashes, models, tokenizers or edit distances that SQL does not have.
ORACLE_SQL: dict[str, str] = {"op2_host_quality_rules": _QUALITY, "op10_line_dedup": _LINE_DEDUP, "op11_ranked_search": ranked_search.SQL, "op12_source_mixing": mixing.SQL, "op13_phrase_collocations": phrases.SQL}
