"""Phrase collocation mining: the word sequences of each language that stand together more often than their parts would.

Words are cut out of the lower-cased text in runs between marks. A first pass counts words. Then, for each length, a task
turns each run of texts into one array of word hashes; the prefix sums of a polynomial over it give the fingerprint of
every n-gram as a difference of two sums, and fingerprints are summed within tasks and then by a shuffle. An n-gram with
a rare part is rare itself and is left out before that, by bit maps of the frequent fingerprints of all shorter lengths.

What goes with a fingerprint points to its text: a word's fingerprint has the word, a longer one the hash of its last
word, which also gives the fingerprint of what stands before it. So the texts of frequent phrases, and of no others, are
put together from those one word shorter. If two texts share a fingerprint that is frequent, this shows: their last
words differ, or what stands before them shares a fingerprint too, down to two words, whose texts are compared. Then all
is done again with another polynomial, so the counts that come out are those of texts.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import as_bytes, documents, materialize, release, shuffle_partitions

#: Fixed values of the contract.
LONGEST = 5
LEAST = 100
BEST = 2000
CONTAINED = 100  # per cent of a phrase's occurrences that a longer one must have to replace it
NO_LANG = "und"

#: Bytes of text that a task turns into arrays at a time.
RUN_BYTES = 3 << 20
#: Distinct fingerprints, and words, that a task sums before it passes them on.
HELD, HELD_WORDS = 1_000_000, 400_000
#: Words that a worker remembers.
MAX_WORDS = 250_000
#: Bits of a map: 64 for each frequent fingerprint, within these bounds. A map is 32 MB at most, wherever it is sent; with
#: more fingerprints than it is meant for, it leaves out less.
LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 28, 20

_MARK = b"\xff"  # in no UTF-8 text
_FOLD = bytes(255 if c in b".,;:!?\n\v\f\r" else 32 if c in b"\t " else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WRAP = (1 << 64) - 1


def polynomials() -> Iterator[tuple[int, int]]:
    """(seed of word hashes, base) to try, one after the other; a base is odd, so that it has an inverse modulo 2**64."""
    for seed in count():
        yield seed, xxhash.xxh64_intdigest(b"base", seed) | 1


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed)


class _Words(dict):
    """Numbers of words and hashes by number; one for each worker and seed."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed, self.hashes = seed, array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(word_hash(word, self.seed))
        return n


_words = _Words(0)
_powers: dict[int, np.ndarray] = {}


def _powers_to(n: int, base: int) -> np.ndarray:
    """Powers of the base and of its inverse, modulo 2**64."""
    if base not in _powers or _powers[base].shape[1] < n:
        both = np.full((2, n), 1, np.uint64)
        both[0, 1:], both[1, 1:] = base, pow(base, -1, 1 << 64)
        _powers.clear()
        _powers[base] = np.cumprod(both, axis=1, dtype=np.uint64)
    return _powers[base][:, :n]


def cut(data: bytes, longest: int, size: int = RUN_BYTES) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts of about `size` bytes, cut between words: (part, bytes of it that are its own). What follows
    are the next longest - 1 words, which its last phrases reach into."""
    at = 0
    while len(data) - at > size:
        end = data.find(b" ", at + size)
        if end < 0:
            break
        stop = end
        for _ in range(longest - 1):
            while stop < len(data) and data[stop] == 32:
                stop += 1
            stop = data.find(b" ", stop)
            if stop < 0:
                stop = len(data)
                break
        yield data[at:stop], end - at
        at = end
    yield data[at:], len(data) - at


def runs(texts, size: int = RUN_BYTES, longest: int = LONGEST) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, how many of them are the run's own) of texts, in runs of about `size` bytes; marks part words and texts."""
    held, n = [], 0
    for t in texts:
        data = as_bytes(t).translate(_FOLD).replace(_MARK, b" \xff ")
        if len(data) > size:
            for part, own in cut(data, longest, size):
                tokens = part.split()
                yield tokens, len(part[:own].split())
            continue
        held.append(data)
        n += len(data)
        if n >= size:
            tokens = b" \xff ".join(held).split()
            yield tokens, len(tokens)
            held, n = [], 0
    if held:
        tokens = b" \xff ".join(held).split()
        yield tokens, len(tokens)


class _Run:
    """One run of tokens as arrays: word hashes, marks before each place, prefix sums of the polynomial."""

    def __init__(self, tokens: list[bytes], own: int, lang: int, seed: int, base: int):
        global _words
        if len(_words) > MAX_WORDS or _words.seed != seed:
            _words = _Words(seed)
        mark = _words[_MARK]
        self.own, self.size, self.lang = own, len(tokens), np.uint64(lang)
        words = np.fromiter(map(_words.__getitem__, tokens), np.int64, len(tokens))
        self.hashes = np.frombuffer(_words.hashes, np.uint64)[words]
        self.marks = np.concatenate([[0], np.cumsum(words == mark)])
        self.powers = _powers_to(len(tokens) + 1, base)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(self.hashes * self.powers[0, : len(tokens)], out=self.sums[1:])

    def fingerprints(self, n: int, at: np.ndarray) -> np.ndarray:
        """Of the n-grams that begin at these places: the polynomial from there on, with the language added."""
        return (self.sums[at + n] - self.sums[at]) * self.powers[1, at] + self.lang

    def likely(self, n: int, maps: list[np.ndarray]) -> np.ndarray:
        """Where n-grams of the run's own begin that have no mark within and whose parts are all on the maps of frequent
        ones of their lengths."""
        if self.size < n:
            return np.zeros(0, np.int64)
        fits = self.marks[n:] == self.marks[: self.size + 1 - n]
        fits[self.own :] = False
        if n > 1:
            ok = self.marks[1:] == self.marks[:-1]  # m-grams all of whose parts are on the maps
            for m, bits in enumerate(maps[: n - 1], 1):
                at = np.flatnonzero(ok)
                ok[at] = on_map(bits, self.fingerprints(m, at))
                ok = ok[:-1] & ok[1:]
            fits &= ok
        return np.flatnonzero(fits)


def on_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bits of the keys are set; the map's size is a power of two, and keys have their place by their highest bits."""
    at = keys >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _by_lang(batches, longest: int = LONGEST) -> Iterator[tuple[str, list[bytes], int]]:
    """(language, tokens, own ones): runs of texts; those of one language in a batch are put together."""
    for b in batches:
        for i in range(0, b.num_rows, 2000):
            part = b.slice(i, 2000)
            langs = part.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                mine = (t.as_py() for x, t in zip(langs, part.column(1)) if x == lang)
                for tokens, own in runs(mine, longest=longest):
                    yield lang, tokens, own


def lang_hash(lang: str, seed: int) -> int:
    return word_hash(lang.encode("utf-8", "surrogatepass"), seed ^ 0x5DEECE66D)


def _counted(batches, seed: int, held: int = HELD_WORDS):
    """(key, lang, word, count) of words, summed within the task, and one row a language without a word: all of them."""
    found: dict[str, Counter] = {}
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("count", pa.int64())])

    def signed(x: list[int]) -> pa.Array:
        return pa.array(np.array(x, np.uint64).view(np.int64))

    def out():
        for lang, words in found.items():
            start, rows = lang_hash(lang, seed), iter(words.items())
            while part := list(islice(rows, 20_000)):
                columns = [signed([(word_hash(w, seed) + start) & _WRAP for w, _ in part]), pa.array([lang] * len(part)), pa.array([w for w, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part])]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
            yield pa.RecordBatch.from_arrays([signed([start]), pa.array([lang]), pa.array([None], pa.string()), pa.array([sum(words.values())])], schema=schema)
        found.clear()

    for lang, tokens, own in _by_lang(batches):
        c = found.setdefault(lang, Counter())
        c.update(tokens[:own] if own < len(tokens) else tokens)
        c.pop(_MARK, None)
        if sum(map(len, found.values())) > held:
            yield from out()
    yield from out()
    release()


def _summed(batches, n: int, maps: Broadcast, seed: int, base: int, held: int = HELD):
    """(key, last, count) of the fingerprints of likely n-grams and the hashes of their last words, summed within the task.
    Places with one fingerprint and another last word are rows of their own."""
    known, parts, size = maps.value, [], 0
    schema = pa.schema([("key", pa.int64()), ("last", pa.int64()), ("count", pa.int64())])

    def summed(k, last, c):
        order = np.argsort(k)
        k, last, c = k[order], last[order], c[order]
        if not len(k):
            return k, last, c
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (last[1:] != last[:-1])]))
        return k[first], last[first], np.add.reduceat(c, first)

    def out(k, last, c):
        for i in range(0, len(k), 100_000):
            j = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(k[j].view(np.int64)), pa.array(last[j].view(np.int64)), pa.array(c[j])], schema=schema)

    for lang, tokens, own in _by_lang(batches):
        run = _Run(tokens, own, lang_hash(lang, seed), seed, base)
        at = run.likely(n, known)
        one = summed(run.fingerprints(n, at), run.hashes[at + n - 1], np.ones(len(at), np.int64))
        parts.append(one)
        size += len(one[0])
        if size > 2 * held:
            one = summed(*map(np.concatenate, zip(*parts)))
            parts, size = [one], len(one[0])
            if size > held:
                yield from out(*one)
                parts, size = [], 0
    if parts:
        yield from out(*summed(*map(np.concatenate, zip(*parts))))
    release()


def _packer(bits: int):
    def pack(table: pa.Table) -> pa.Table:
        """The bits of one block, as bytes."""
        marks = np.zeros(min(1 << bits, 1 << BLOCK_BITS), np.uint8)
        marks[table.column("bit").to_numpy()] = 1
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    return pack


def frequent_map(keys: DataFrame) -> np.ndarray:
    """The map of the keys of a stored table: one row to the driver for each 2**20 bits, 32 MB at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * keys.count()).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    at = keys.select(F.shiftright(place, BLOCK_BITS).cast("int").alias("block"), place.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("bit")).distinct()
    blocks = at.groupBy("block").applyInArrow(_packer(bits), "block int, bits binary")  # no more than 2**20 rows a block
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in blocks.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["block"] << BLOCK_BITS >> 3 :][: len(part)] = part
    return out


def _before(n: int, base: int):
    power = np.uint64(pow(base, n - 1, 1 << 64))

    @F.arrow_udf(T.LongType())
    def before(key: pa.Array, last: pa.Array) -> pa.Array:
        """The fingerprint of an n-gram without its last word."""
        k, x = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in (key, last))
        return pa.array((k - x * power).view(np.int64))

    return before


def _hash_of(seed: int):
    @F.arrow_udf(T.LongType())
    def hash_of(word: pa.Array) -> pa.Array:
        return pa.array(np.array([word_hash(as_bytes(w), seed) for w in word.to_pylist()], np.uint64).view(np.int64))

    return hash_of


def _levels(rows: DataFrame, longest: int, least: int, seed: int, base: int) -> tuple[DataFrame, DataFrame] | None:
    """The frequent phrases and the numbers of words by one polynomial; None if it gave two texts one frequent fingerprint."""
    sc = rows.sparkSession.sparkContext
    counted = rows.mapInArrow(partial(_counted, seed=seed), "key long, lang string, word string, count long")
    # dealt by key once; rows of a key are one a task at most, so there is nothing to sum before
    grouped = materialize(counted.repartition("key").groupBy("key", "lang", "word").agg(F.sum("count").alias("count")), "words")
    words = materialize(grouped.filter("word is not null").filter(F.col("count") >= least).withColumn("hash", _hash_of(seed)("word")), "words")
    if not grouped.filter("word is not null").join(words.select("key"), "key", "left_semi").groupBy("key").count().filter("count > 1").isEmpty():
        return None
    all_words = grouped.filter("word is null").select("lang", F.col("count").alias("n"))
    words = words.select("key", "lang", "hash", F.col("word").alias("phrase"), "count")
    held, maps = [words.select("key", "lang", F.lit(1).alias("words"), "phrase", "count")], []
    for n in range(2, longest + 1):
        maps.append(frequent_map(held[-1].select("key")))
        counts = rows.mapInArrow(partial(_summed, n=n, maps=sc.broadcast(maps), seed=seed, base=base), "key long, last long, count long")
        often = counts.repartition("key").groupBy("key").agg(F.sum("count").alias("count"), F.min("last").alias("last"), F.max("last").alias("other")).filter(F.col("count") >= least)
        often = materialize(often, "frequent")
        if not often.filter("last <> other").isEmpty():
            return None
        shorter = held[-1].select(F.col("key").alias("before"), "lang", F.col("phrase").alias("head"))
        named = often.withColumn("before", _before(n, base)("key", "last")).join(shorter, "before").join(words.select("lang", F.col("hash").alias("last"), F.col("phrase").alias("word")), ["lang", "last"])
        held.append(materialize(named.select("key", "lang", F.lit(n).alias("words"), F.concat_ws(" ", "head", "word").alias("phrase"), "count"), "phrases"))
    found = held[0]
    for more in held[1:]:
        found = found.unionByName(more)
    return found.drop("key"), all_words


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, count) of all phrases of 1 to `longest` words with `least` occurrences in a language, and
    (lang, n) of all its words."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("text is not null")
    return next(found for seed, base in polynomials() if (found := _levels(rows, longest, least, seed, base)) is not None)


def _exact(a: str, n: str, l: str, r: str) -> str:
    """SQL for 1000 * a * n / (l * r), rounded down, in whole numbers of 38 digits."""
    wide = "CAST({} AS DECIMAL(38, 0))".format
    return f"(CAST(1000 AS DECIMAL(38, 0)) * {wide(a)} * {wide(n)}) div ({wide(l)} * {wide(r)})"


def collocations(docs: DataFrame, k: int = BEST, longest: int = LONGEST, least: int = LEAST, contained: int = CONTAINED, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's k best phrases of 2 to `longest` words.

    a is how often the phrase stands between two marks, overlaps included, l and r how often the parts of its weakest cut
    do, n the words of the language; the score is floor(1000 a n / (l r)). Equal scores go to the more frequent phrase,
    then to the first by bytes. A phrase inside a longer one that has `contained` per cent of its occurrences is left out.
    Null texts are empty and give nothing; a null language is `und`, as is one of that name; repeated rows count as often
    as they are there. An empty table, or one without a frequent phrase, gives no rows. Other columns are left alone.
    """
    known, all_words = frequent(docs, longest, least, text_col, lang_col)
    candidates = known.filter("words > 1").select("lang", "words", "phrase", F.col("count").alias("a"), F.split("phrase", " ").alias("w"))
    pieces = known.select("lang", F.col("phrase").alias("part"), F.col("count").alias("f"))
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    cuts = cuts.join(pieces.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(pieces.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    scored = cuts.join(all_words, "lang").withColumn("score", F.expr(_exact("a", "n", "l", "r")).cast("long"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    longer = candidates.filter("words > 2").select("lang", "words", "w", F.col("a").alias("f"), F.explode(F.expr("sequence(2, words - 1)")).alias("m"))
    longer = longer.select("lang", "w", "f", "m", F.explode(F.expr("sequence(1, words - m + 1)")).alias("s")).select("lang", F.array_join(F.slice("w", F.col("s"), F.col("m")), " ").alias("phrase"), "f")
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = weakest.join(most, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * F.col("f") < contained * F.col("a")))
    rows = left.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    # the best k of each part of a language first, so that no task gets all phrases of a common one
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession))))
    some = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


_GRAM = "array_to_string(w[i:i + {0} - 1], ' ')"

SQL = rf"""WITH d AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS m) WHERE len(w) >= m),
    f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang), o AS (SELECT * FROM f WHERE f >= {LEAST}),
    c AS (SELECT lang, phrase, f AS a, m, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM o WHERE m > 1),
    s AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
          FROM c JOIN n ON c.lang = n.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
    WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.m > len(string_split(b.phrase, ' ')) AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.f >= {CONTAINED} * b.a)
    QUALIFY rank <= {BEST}"""
