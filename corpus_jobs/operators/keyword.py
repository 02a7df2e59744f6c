"""Keyword search: postings, whole-question phrases and any-term search, ranked by BM25."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..storage import materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("chunk_id", "document_id", "text", "file_name")


def fold(text: str | None) -> list[str]:
    """Letter and digit runs in lower case without diacritics."""
    if not text:
        return []
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text.lower())


def token_lists(text: pa.Array) -> list[list[str]]:
    return [fold(t) for t in text.to_pylist()]


@F.arrow_udf(T.ArrayType(T.StringType()))
def tokens(text: pa.Array) -> pa.Array:
    return pa.array(token_lists(text), type=pa.list_(pa.string()))


# --- stemming: Porter's suffix rules, as published in 1980 -----------------------------------------------------------

# Suffixes and what replaces them.
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: The longest suffix that fits decides.
_RULES2, _RULES3 = (sorted(step, key=lambda r: -len(r[0])) for step in (_STEP2, _STEP3))
_ENDS4 = sorted(_STEP4, key=lambda e: -len(e))
#: Words whose stems a worker remembers.
MAX_STEMS = 500_000


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short_end(w: str) -> bool:
    return len(w) > 2 and _kinds(w).endswith("cvc") and w[-1] not in "wxy"


def stem(w: str) -> str:
    if len(w) < 3 or not (w.isascii() and w.isalpha()):
        return w
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + put
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            base = w[: -len(end)]
            if w.endswith(end) and "v" in _kinds(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and base[-1] not in "aeioulsz":
                    base = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    base += "e"
                w = base
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_RULES2, _RULES3):
        for end, put in rules:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + put
                break
    for end in _ENDS4:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


class _Stems(dict):
    """Stems by word, worked out when first asked for; one for each worker."""

    def __missing__(self, word: str) -> str:
        self[word] = out = stem(word)
        return out


_stems = _Stems()


def stem_lists(rows: list[list[str] | None]) -> list[list[str]]:
    if len(_stems) > MAX_STEMS:
        _stems.clear()
    return [[_stems[w] for w in row or ()] for row in rows]


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems(words: pa.Array) -> pa.Array:
    return pa.array(stem_lists(words.to_pylist()), type=pa.list_(pa.string()))


# --- index -----------------------------------------------------------------------------------------------------------


def analysed(text: Column, stemmed: bool) -> Column:
    return stems(tokens(text)) if stemmed else tokens(text)


def index(chunks: DataFrame, stemmed: bool = True, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """chunks -> (chunk_id, col, toks): the terms of every indexed column, in order.

    A search reads the index several times; write it once (storage.materialize, or a table) rather than tokenise again.
    """
    each = F.array(*[F.struct(F.lit(i).alias("col"), F.coalesce(F.col(c), F.lit("")).alias("value")) for i, c in enumerate(columns)])
    rows = chunks.select("chunk_id", F.explode(each).alias("x")).select("chunk_id", "x.col", "x.value")
    return rows.select("chunk_id", "col", analysed(F.col("value"), stemmed).alias("toks"))


def postings(indexed: DataFrame) -> DataFrame:
    """(chunk_id, col, pos, term): one row per token; written bucketed by term where an index is kept."""
    return indexed.select("chunk_id", "col", F.posexplode("toks").alias("pos", "term"))


def asked_postings(indexed: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms(term) of a table of questions. Terms meet the postings as a set that is written first, so
    Spark knows its size and sends it to the scan below its own threshold; then no other posting is shuffled or counted."""
    return postings(indexed).join(materialize(terms.distinct(), "terms"), "term", "left_semi")


def lengths(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("chunk_id").agg(F.sum(F.size("toks")).alias("n_tokens"))


def _bm25(hits: DataFrame, lens: DataFrame, group: list[str]) -> DataFrame:
    """hits(query_id, chunk_id, *group, tf) -> rank per query and chunk, negative and smaller for better ones."""
    totals = lens.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("n_tokens").alias("mean_len"))
    df = hits.groupBy("query_id", *group).agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_len")))
    scored = hits.join(df, ["query_id", *group]).join(lens, "chunk_id").join(F.broadcast(totals))  # totals is one row
    return scored.groupBy("query_id", "chunk_id").agg((-F.sum(part)).alias("rank"))


def best_rows(ranked: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.round("rank", 9), "chunk_id")  # sums differ in their last digits with their order
    score = F.when(F.col("rank") == 0, 0.5).otherwise(1 / (1 + F.abs("rank")))
    return ranked.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).withColumn("score", score)


def phrase_search(questions: DataFrame, indexed: DataFrame, k: int = 10, stemmed: bool = True) -> DataFrame:
    """questions(query_id, question) -> (query_id, chunk_id, rank, position, score) of the k best chunks that hold the
    whole question as one phrase within one column.

    Only the question's rarest term is joined with the postings; each place is then checked against the chunk's terms,
    so frequent words never meet in a join.
    """
    asked = questions.select("query_id", analysed(F.col("question"), stemmed).alias("q")).filter(F.size("q") > 0)
    posts = materialize(asked_postings(indexed, asked.select(F.explode("q").alias("term"))), "postings")
    common = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.select("query_id", "q", F.posexplode("q").alias("off", "term")).join(common, "term", "left")
    rare = terms.groupBy("query_id", "q").agg(F.min_by(F.struct("term", "off"), F.struct(F.coalesce("df", F.lit(0)), "off")).alias("r"))
    places = posts.join(rare.select("query_id", "q", "r.term", "r.off"), "term").filter("pos >= off").select("query_id", "q", "chunk_id", "col", (F.col("pos") - F.col("off")).alias("start"))
    found = places.join(indexed, ["chunk_id", "col"]).filter(F.slice("toks", F.col("start") + 1, F.size("q")) == F.col("q"))
    hits = found.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    return best_rows(_bm25(hits, lengths(indexed), []), k)


def any_term_search(questions: DataFrame, indexed: DataFrame, k: int = 10, stemmed: bool = True) -> DataFrame:
    """Like phrase_search, for chunks that hold any of the question's terms; scores add up over distinct terms."""
    asked = questions.select("query_id", F.explode(F.array_distinct(analysed(F.col("question"), stemmed))).alias("term"))
    counts = materialize(asked_postings(indexed, asked.select("term")).groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf")), "counts")
    return best_rows(_bm25(counts.join(asked, "term"), lengths(indexed), ["term"]), k)
