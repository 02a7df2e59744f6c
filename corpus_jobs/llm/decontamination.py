"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of m characters may differ from its place in a document by k = m / 10 edits. It is cut into k + 1
pieces; at least one of them stands in the document unchanged, and all pieces of a block of items are looked up in one
pass over a text by an Aho-Corasick automaton. A piece hit climbs a binary tree over the pieces: a run of j pieces may
hold at most j - 1 edits (if a run's two halves both exceed their share, so does the run), which is checked at every
level by Myers' bit-parallel distance, so that chance hits die on short strings and only real ones reach the root.

Texts and items are compared in lower case with runs of blanks as one space. Items of fewer than MIN_ITEM_CHARS characters
are looked for as well, but without edits and as whole words, since their pieces would stand everywhere.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, fresh, materialize, release

EDITS_PER_CHAR = 0.1
#: A shorter item is looked for without edits, as whole words.
MIN_ITEM_CHARS = 25
#: Characters of benchmark text in one block, which bounds the automaton and what the driver holds at a time; more text
#: makes more blocks, not larger ones, and each is a pass over the documents.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[int]:
    """Cut points, 0 to len(item), of budget + 1 nearly equal pieces."""
    return [i * len(item) // (budget + 1) for i in range(budget + 2)]


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of pattern to a substring of text, end of the first such substring): Myers' bit vectors."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether no word goes on beyond either end of text[start:end]."""
    begins = start == 0 or not (text[start - 1].isalnum() and text[start].isalnum())
    return begins and (end == len(text) or not (text[end - 1].isalnum() and text[end].isalnum()))


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDITS_PER_CHAR, least: int = MIN_ITEM_CHARS):
        self.items, self.cuts, owners = [], [], {}
        for key, text in items:
            item = normal(text)
            if not item:
                continue
            cuts = pieces(item, int(len(item) * rate) if len(item) >= least else 0)
            for p in range(len(cuts) - 1):
                owners.setdefault(item[cuts[p] : cuts[p + 1]], []).append((len(self.items), p))
            self.items.append((key, item))
            self.cuts.append(cuts)
        self.least = least
        self.automaton = ahocorasick.Automaton()
        for word, at in owners.items():
            self.automaton.add_word(word, (len(word), at))
        if owners:
            self.automaton.make_automaton()

    def climbs(self, item: str, cuts: list[int], p: int, text: str, start: int) -> tuple[int, int, int] | None:
        """(distance, first character, end) of the item around piece p found at start; None if a run exceeds its share."""
        lo, hi = 0, len(cuts) - 1
        runs = []
        while hi - lo > 1:
            runs.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if p < mid else (mid, hi)
        found = (0, start, start + cuts[p + 1] - cuts[p])
        for lo, hi in reversed(runs):
            budget = hi - lo - 1
            first = max(0, start - (cuts[p] - cuts[lo]) - budget)
            last = start + (cuts[hi] - cuts[p]) + budget
            d, end = best_end(item[cuts[lo] : cuts[hi]], text[first:last])
            if d > budget:
                return None
            found = d, first, first + end
        return found

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item key, least distance, end in the normalised text) of every item that the text holds."""
        t = normal(text)
        best: dict[int, tuple[int, int]] = {}
        if not self.items or not t:
            return []
        tried: set[tuple[int, int]] = set()
        for last, (n, owners) in self.automaton.iter(t):
            start = last - n + 1
            for i, p in owners:
                at = (i, start - self.cuts[i][p])  # where the item would start without edits before the piece
                if at in tried:
                    continue
                key, item = self.items[i]
                if key in best and best[key][0] == 0 or len(item) < self.least and not whole_words(t, start, last + 1):
                    continue
                got = self.climbs(item, self.cuts[i], p, t, start)
                if got is None:
                    continue
                tried.add(at)
                if key not in best or got[0] < best[key][0]:
                    best[key] = got[0], got[2]
        return sorted(((k, d, e) for k, (d, e) in best.items()), key=lambda x: (x[0] is not None, x[0]))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = BLOCK_CHARS):
    """Yields the benchmark as lists of (id, text), a block at a time, each of about so many characters."""
    items = benchmark.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).filter("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = total // chars + 1
    for b in range(n):
        yield [(r["k"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("k"), F.lit(n)) == b).collect()]


FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType()), T.StructField("end", T.LongType())]))
_matchers: dict[str, Matcher] = {}


def _finder(items: list[tuple[int, str]], rate: float, least: int, token: str):
    @F.arrow_udf(FOUND)
    def find(text: pa.Array) -> pa.Array:
        if token not in _matchers:  # once in each Python worker; only the latest block is held
            _matchers.clear()
            _matchers[token] = Matcher(items, rate, least)
        rows = [[{"item_id": k, "distance": d, "end": e} for k, d, e in _matchers[token].find(t)] for t in (x.as_py() for x in text)]
        release()
        return pa.array(rows, type=pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())])))

    return find


def _finders(benchmark: DataFrame, rate: float, least: int):
    """Yields a function for each block, made when it is asked for, so that one block at a time is held."""
    for items in blocks(benchmark):
        yield _finder(items, rate, least, uuid.uuid4().hex)


def _matches(docs: DataFrame, benchmark: DataFrame, text_col: str, rate: float, least: int, keys: list[Column]) -> DataFrame:
    """keys with item_id, distance and end. The result of every block but a single one is written before the next is read."""
    out, held = None, None
    for find in _finders(benchmark, rate, least):
        if held is not None:
            one = materialize(held, "found")
            out = one if out is None else out.unionByName(one)
        held = docs.select(*keys, F.explode(find(F.col(text_col))).alias("x")).select("*", "x.item_id", "x.distance", "x.end").drop("x")
    return held if out is None else out.unionByName(materialize(held, "found"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = EDITS_PER_CHAR, least: int = MIN_ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, end): one row per row of docs and item that it holds within the budget.

    end is the end of the best place in the text as compared (lower case, single spaces). Null or empty texts hold
    nothing; null and empty items are not looked for; items with the same id are one item, at its best, and so are those
    without an id. Repeated rows of docs come out each on their own. Item ids are whole numbers.
    """
    return _matches(docs, benchmark, text_col, rate, least, [F.col(id_col).alias("doc_id")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = EDITS_PER_CHAR, least: int = MIN_ITEM_CHARS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns.

    With one block of benchmark text this is a narrow filter without a shuffle. With several, the texts that hold an item
    are found block by block and taken out by their hash.
    """
    finders = _finders(benchmark, rate, least)
    first, second = next(finders), next(finders, None)
    if second is None:
        return docs.filter(F.size(first(F.col(text_col))) == 0)
    name = fresh(docs, "text_hash")
    found = _matches(docs, benchmark, text_col, rate, least, [F.md5(F.col(text_col)).alias(name)]).select(name).distinct()
    return docs.withColumn(name, F.md5(F.col(text_col))).join(found, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
