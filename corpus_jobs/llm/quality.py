"""Quality rules whose strictness depends on the host that a document comes from.

Every document is measured on its own. The base rules reject it outright. The softer rules have limits that a clean
document may pass a little now and then: by how much depends on its host. Failures are counted by host, the rates are
shrunk towards the corpus by a beta prior fitted to the hosts' own rates (method of moments), and a host's verdict on a
rule is an allowance that falls from twice the limit, where hardly a document fails, to the limit itself, where all do.
It is joined back, and a document beyond its host's allowance is rejected. A document that fails no rule is kept on
every host.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, as_bytes, documents, fresh, materialize, release

#: Fixed by the operator's contract.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"

MEASURES = T.StructType([T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])

#: Soft rules on the measures, as SQL over the struct m: true where the document is beyond {a} times the limit.
SOFT_RULES = {
    "symbols": "m.n_symbols * 10 > {a} * m.n_words",
    "dup_lines": "m.n_dup_lines * 10 > {a} * m.n_lines * 3",
    "word_length": "{a} * m.word_chars < 3 * m.n_words or m.word_chars > {a} * 10 * m.n_words",
}
#: Share of a limit by which documents of a host without failures may be beyond it.
LENIENCE = 1.0
#: Documents that the prior counts for, at least and at most.
MIN_STRENGTH, MAX_STRENGTH = 10.0, 1e6


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of so many words that is found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*[words[i : i + n] for i in range(window)]))
    if len(set(windows)) == n:
        return 0
    often, total, done = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            total += i + window - max(i, done)
            done = i + window
    return total


def measure(text: str | None) -> tuple[int, ...]:
    b = as_bytes(text)
    words = b.split()
    if not words:
        return 0, 0, sum(map(b.count, ([bytes([s]) for s in SYMBOLS]))), 0, 0, 0
    lines = [x for x in b.split(b"\n") if x.strip(BLANKS)]
    chars = len(text) - sum(b.count(bytes([c])) for c in BLANKS)
    return len(words), chars, sum(b.count(bytes([s])) for s in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines)


@F.arrow_udf(MEASURES)
def measures(text: pa.Array) -> pa.Array:
    rows = [measure(t) for t in (x.as_py() for x in text)]
    columns = zip(*rows) if rows else [[] for _ in MEASURES]
    release()
    return pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=MEASURES.names)


def base_failed(m: str = "m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def fails(rule: str, allowed: str = "1") -> Column:
    return F.expr(SOFT_RULES[rule].format(a=allowed))


def host_verdicts(measured: DataFrame, lenience: float = LENIENCE) -> DataFrame:
    """measured(host, m) -> one row per host: n, and for each soft rule rate_<rule> (shrunk) and allowed_<rule>, how many times
    the limit its documents may come to.

    The beta prior of a rule has the corpus rate p as its mean. Its strength a + b follows from how far the hosts' rates
    lie apart beyond what chance would do (method of moments for unequal sizes): with S = sum n (rate - p)^2 over k
    hosts and N documents, rho = (S / (p (1 - p)) - (k - 1)) / (N - sum n^2 / N - (k - 1)) and a + b = (1 - rho) / rho,
    held between MIN_STRENGTH and MAX_STRENGTH; so a few documents hardly move a host's verdict. A null host is one of its own.
    """
    counts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(fails(r)).alias(f"f_{r}") for r in SOFT_RULES])
    counts = materialize(counts, "hosts")
    n = F.sum("n")
    totals = [n.alias("all_n"), (n - F.sum(F.col("n") * F.col("n")) / n - F.count(F.lit(1)) + 1).alias("spare"), F.count(F.lit(1)).alias("k")]
    moments = counts.agg(*totals, *[x for r in SOFT_RULES for x in ((F.sum(f"f_{r}") / n).alias(f"p_{r}"), F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"q_{r}"))])
    both = counts.join(F.broadcast(moments))  # one row
    out = ["host", "n"]
    for r in SOFT_RULES:
        p = F.col(f"p_{r}")
        apart = F.try_divide(F.col(f"q_{r}") - F.col("all_n") * p * p, p * (1 - p)) - F.col("k") + 1
        rho = F.try_divide(apart, F.col("spare"))
        strength = F.when(rho > 0, F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(MIN_STRENGTH), (1 - rho) / rho))).otherwise(MAX_STRENGTH)
        rate = (F.col(f"f_{r}") + strength * p) / (F.col("n") + strength)
        out += [rate.alias(f"rate_{r}"), (1 + lenience * (1 - rate)).alias(f"allowed_{r}")]
    return materialize(both.select(*out), "verdicts")


def judged(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """measured with its columns, base_failed and kept. The verdict table is read from files, so Spark knows its size:
    it is broadcast below spark.sql.autoBroadcastJoinThreshold, else joined by a shuffle that splits a hot host."""
    v = verdicts.select(F.col("host").alias("v_host"), *[f"allowed_{r}" for r in SOFT_RULES])
    # a null host is told apart from an empty one by its own column, which keeps an equality join
    key = lambda c: [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))]
    on = [a == b for a, b in zip(key("host"), key("v_host"))]
    soft = F.lit(False)
    for r in SOFT_RULES:
        soft = soft | fails(r, f"allowed_{r}")
    return measured.join(v, on[0] & on[1], "left").select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & ~soft).alias("kept"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, m, base_failed, kept) per row of docs; a null or empty text has no words and fails the base rules."""
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m"))
    measured = materialize(measured, "measured")
    return judged(measured, host_verdicts(measured))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their columns. Texts are measured once for the hosts and once for the
    documents, which costs less than carrying whole texts through a shuffle or a second copy."""
    whole = fresh(docs, "whole")
    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m"))
    verdicts = host_verdicts(docs.select(F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m")))
    kept = judged(measured, verdicts).filter("kept")
    return kept.select(*[F.col(whole).getField(c).alias(c) for c in docs.columns])


def op2_host_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir)).select("doc_id", *[f"m.{c}" for c in MEASURES.names if c != "n_lines"], "base_failed", "kept")
