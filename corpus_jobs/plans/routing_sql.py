"""What questions ask for, worked out in DuckDB SQL from the fixed words and patterns: the oracle of the routing queries."""

from ..functions import routing


def holds(column: str, words: list[str]) -> str:
    """Whether any of the words stands in the column."""
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in quoted) + ")"


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '\\s+'), lambda w: w <> '')"


_CODED = f"list_transform(regexp_extract_all(n, '{routing.CODED_ID}', 1), lambda x: 'SIH' || x)"
_GENERIC = f"list_filter(list_transform(regexp_extract_all(n, '{routing.GENERIC_ID}', 1), lambda x: upper(x)), lambda x: NOT starts_with(replace(replace(x, '-', ''), '_', ''), 'SIH'))"
_FIELDS = ", ".join(f"CASE WHEN {holds('lower(n)', words)} THEN '{field}' END" for field, words in routing.FIELD_WORDS.items())
_STARTS = " OR ".join(f"starts_with(l, '{s}')" for s in routing.FOLLOW_UP_STARTS)
_FOLLOW = ", ".join(f"'{w}'" for w in routing.FOLLOW_UP_WORDS)
_ALONE = "len(list_filter(ids, lambda x: upper(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) = upper(regexp_replace(n, '[^a-zA-Z0-9]', '', 'g')))) > 0"

#: `planned` after `WITH`: query_id, n (stripped message), l (in lower case), ids, page, fields, follow_up, comparison, intent.
PLANNED = f"""said AS (SELECT query_id, regexp_replace(message, '^\\s+|\\s+$', '', 'g') AS n FROM $questions),
    found AS (SELECT query_id, n, lower(n) AS l, list_concat({_CODED}, {_GENERIC}) AS coded, CASE WHEN len({_words("n")}) <= 3 THEN regexp_extract_all(n, '{routing.BARE_NUMBER}', 1) ELSE [] END AS bare,
      TRY_CAST(coalesce(nullif(regexp_extract(n, '{routing.PAGE_ORDINAL}', 1), ''), nullif(regexp_extract(n, '{routing.PAGE_CARDINAL}', 1), '')) AS INT) AS page, list_filter([{_FIELDS}], lambda x: x IS NOT NULL) AS fields FROM said),
    asked AS (SELECT *, CASE WHEN len(coded) > 0 THEN list_filter(coded, lambda x, i: list_position(coded, x) = i) ELSE bare END AS ids,
      len({_words("l")}) <= 8 AND len(list_filter({_words("l")}, lambda w: w IN ({_FOLLOW}))) > 0 OR {_STARTS} AS follow_up FROM found),
    planned AS (SELECT *, CASE WHEN len(ids) >= 2 AND {holds("l", routing.COMPARISON_WORDS)} THEN ids[1:2] ELSE [] END AS comparison,
      CASE WHEN {holds("l", routing.COMPARISON_WORDS)} AND len(ids) >= 2 THEN 'comparison' WHEN follow_up AND len(ids) = 0 THEN 'follow_up' WHEN coalesce(page, 0) <> 0 AND len(ids) = 0 THEN 'page_lookup'
        WHEN {holds("l", routing.SUMMARY_WORDS)} THEN 'summary' WHEN {holds("l", routing.IMAGE_WORDS)} THEN 'image_note' WHEN {holds("l", routing.LIST_WORDS)} THEN 'table_list'
        WHEN len(ids) > 0 AND {_ALONE} THEN 'exact_identifier' WHEN len(ids) > 0 THEN 'identifier_detail'
        WHEN len({_words("l")}) <= 4 AND NOT {holds("l", routing.QUESTION_WORDS)} THEN 'keyword' ELSE 'semantic' END AS intent FROM asked)"""

TEMPLATE = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{t}'" for i, t in routing.TEMPLATES.items()) + " ELSE 'system' END"
