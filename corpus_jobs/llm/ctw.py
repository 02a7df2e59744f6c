"""Language-model scores by context-tree weighting over bytes, beside a smoothed unigram base.

A byte is decomposed into eight binary decisions, and each decision has its own context tree over the preceding bytes.
A node keeps how often the decision was 0 and 1 (Krichevsky-Trofimov estimate), and a tree mixes all depths: with P_e
the estimate's probability of all it saw and P_w that of the weighted children, the weight of stopping at a node is
P_e / (P_e + product of P_w(children)). Minus the logarithm of the mixed probabilities is the code length.

How it runs:
 1. Documents are dealt into blocks by hash. Each block gives its distinct (depth + 1)-grams and words with their
    training counts; everything the model knows is gathered from these rows.
 2. Gram counts are dealt by the last three context bytes, so that every tree below depth three lies in one partition.
    What the partitions say about depth two (at most 256^2 contexts of 255 decisions, whatever the corpus) makes the
    top of the trees, which all partitions get; each then gives its grams' log-probabilities.
 3. Answers are joined back to the blocks that asked, and each block scores its documents. A frequent word or gram is
    one row in each block, so no key is hot.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, documents, materialize, release, shuffle_partitions, sliced

DEPTH = 5
BLOCK_BYTES = 32 << 20
MIN_BLOCKS = 6
#: Keys that a block's sorted runs may hold besides the largest one before they are merged.
LOOSE_KEYS = 1 << 20
#: Grams that a partition of the trees holds, about.
PARTITION_GRAMS = 250_000
ALPHA = 0.1
#: The end of a text as a token; no word is a line feed.
END = b"\n"
WORD, GRAM = 0, 1
TOP = 2  # depth whose nodes make the top of the trees


# --- one block ----------------------------------------------------------------------------------------------------


def grams(texts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The gram at every byte of the texts in a row and at the zero byte that ends each: depth bytes of context (zeros
    before the text) and the byte, as one number."""
    pad = b"\0" * depth
    joined = np.frombuffer(pad.join([b"", *[t + b"\0" for t in texts]]), dtype=np.uint8)
    # texts are separated by depth zeros; windows that would begin inside a separator are not taken
    code = np.zeros(max(0, len(joined) - depth), dtype=np.uint64)
    for k in range(depth + 1):
        code <<= np.uint64(8)
        code |= joined[k : k + len(code)]
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begins = np.cumsum(lengths + depth) - (lengths + depth)
    inside = np.ones(len(code), dtype=bool)
    for k in range(depth):
        at = begins[1:] - depth + k
        inside[at[at >= 0]] = False
    return code[inside]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


class Gathered:
    """Distinct grams and words of a block with their counts in training documents, as sorted arrays."""

    def __init__(self, depth: int):
        self.depth = depth
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {GRAM: [], WORD: []}

    def put(self, kind: int, keys: np.ndarray, n: np.ndarray, train: bool) -> None:
        parts = self.parts[kind]
        parts.append((keys, n if train else np.zeros(len(n), np.int64)))
        if sum(len(k) for k, _ in parts) - max(len(k) for k, _ in parts) > LOOSE_KEYS:
            self.parts[kind] = [merged(parts)]

    def add(self, texts: list[bytes], train: bool) -> None:
        g = np.sort(grams(texts, self.depth))
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        self.put(GRAM, g[first], np.diff(np.append(first, len(g))), train)
        words = Counter()
        for t in texts:
            words.update(t.split())
        words[END] = len(texts)
        self.put(WORD, np.array([xxhash.xxh64_intdigest(w, 42) for w in words], dtype=np.uint64), np.fromiter(words.values(), np.int64, len(words)), train)

    def rows(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        return merged(self.parts[kind])


def lowered(text: str | None) -> bytes:
    return as_bytes(text).lower()


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """docs(block, held_out, text) -> (block, kind, key, n), a row per key of a block and partition."""

    def run(batches):
        blocks: dict[int, Gathered] = defaultdict(lambda: Gathered(depth))
        for b in sliced(batches, 200):
            split = defaultdict(list)
            for block, held, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                split[block, held].append(lowered(t))
            for (block, held), texts in split.items():
                blocks[block].add(texts, not held)
        for block in list(blocks):
            mine = blocks.pop(block)
            for kind in (GRAM, WORD):
                keys, n = mine.rows(kind)
                for i in range(0, len(keys), 200_000):
                    k = keys[i : i + 200_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block, np.int32)), pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[i : i + 200_000])], names=["block", "kind", "key", "n"])
        release()

    return docs.select("block", "held_out", "text").mapInArrow(run, "block int, kind tinyint, key long, n long")


# --- the trees ------------------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64).copy()
    s = np.zeros_like(x)
    for _ in range(8):
        s -= np.log(x)
        x += 1
    return s + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def node(keys: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """A gram's tree node: its last depth context bytes and the byte's first bits."""
    return (keys & np.uint64((1 << (8 * (depth + 1))) - 1)) >> np.uint64(8 - bit)


def decision(keys: np.ndarray, bit: int) -> np.ndarray:
    return ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


def level(keys: np.ndarray, n: np.ndarray, depth: int, bit: int):
    """(nodes, zeros, ones) of one depth, from grams and their counts."""
    nodes, inverse = np.unique(node(keys, depth, bit), return_inverse=True)
    ones = decision(keys, bit) == 1
    return nodes, np.bincount(inverse, weights=n * ~ones, minlength=len(nodes)), np.bincount(inverse, weights=n * ones, minlength=len(nodes))


def weigh(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None):
    """(weight of stopping here, log P_w), children being the sum of their log P_w; None at the greatest depth."""
    pe = log_kt(zeros, ones)
    if children is None:
        return np.ones(len(pe)), pe
    both = np.logaddexp(pe, children)
    return np.exp(pe - both), both - math.log(2)


def below(nodes: np.ndarray, depth: int, bit: int, child_nodes: np.ndarray, child_logs: np.ndarray) -> np.ndarray:
    """Sums of the children's log P_w for each node of a depth."""
    parent = child_nodes & np.uint64((1 << (8 * depth + bit)) - 1)
    return np.bincount(np.searchsorted(nodes, parent), weights=child_logs, minlength=len(nodes))


def deep(keys: np.ndarray, n: np.ndarray, depth: int, bit: int, least: int):
    """{depth: (nodes, zeros, ones, stop)} from the greatest depth up to least, and the log P_w of the last one."""
    out, logs, prev = {}, None, None
    for d in range(depth, least - 1, -1):
        nodes, zeros, ones = level(keys, n, d, bit)
        stop, logs = weigh(zeros, ones, None if prev is None else below(nodes, d, bit, prev, logs))
        out[d], prev = (nodes, zeros, ones, stop), nodes
    return out, logs


def to_top(keys: np.ndarray, n: np.ndarray, depth: int):
    """(tag, zeros, ones, children) per node of depth TOP: what one partition's trees add to it."""
    tags, zeros, ones, children = [], [], [], []
    for bit in range(8):
        tables, logs = deep(keys, n, depth, bit, TOP + 1)
        nodes, z, o = level(keys, n, TOP, bit)
        tags.append(nodes | np.uint64(bit << 24))
        zeros.append(z), ones.append(o)
        children.append(below(nodes, TOP, bit, tables[TOP + 1][0], logs))
    return [np.concatenate(x) for x in (tags, zeros, ones, children)]


def top_tables(tags: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray):
    """{(bit, depth): (nodes, zeros, ones, stop)} for depths TOP to 0, from sums over all partitions."""
    out = {}
    for bit in range(8):
        mine = np.flatnonzero(tags >> np.uint64(24) == bit)
        mine = mine[np.argsort(tags[mine])]
        nodes, z, o, ch = tags[mine] & np.uint64((1 << 24) - 1), zeros[mine], ones[mine], children[mine]
        for d in range(TOP, -1, -1):
            stop, logs = weigh(z, o, ch)
            out[bit, d] = nodes, z, o, stop
            if d:
                up, inverse = np.unique(nodes & np.uint64((1 << (8 * (d - 1) + bit)) - 1), return_inverse=True)
                z, o, ch = (np.bincount(inverse, weights=x, minlength=len(up)) for x in (z, o, logs))
                nodes = up
    return out


def gram_scores(keys: np.ndarray, n: np.ndarray, depth: int, top: dict) -> np.ndarray:
    """log10 of the mixed probability of each gram's byte after its context. A context that training never saw leaves
    the decision to the longest one that it did see."""
    train = n > 0
    total = np.zeros(len(keys))
    for bit in range(8):
        tables = {d: top[bit, d] for d in range(TOP + 1) if (bit, d) in top}
        if train.any():
            tables |= deep(keys[train], n[train], depth, bit, TOP + 1)[0]
        one = decision(keys, bit) == 1
        p = np.full(len(keys), np.nan)
        for d in range(depth, -1, -1):
            if d not in tables or not len(tables[d][0]):
                continue
            nodes, zeros, ones, stop = tables[d]
            mine = node(keys, d, bit)
            at = np.minimum(np.searchsorted(nodes, mine), len(nodes) - 1)
            seen = nodes[at] == mine
            here = (np.where(one, ones[at], zeros[at]) + 0.5) / (zeros[at] + ones[at] + 1.0)
            p = np.where(seen, np.where(np.isnan(p), here, stop[at] * here + (1 - stop[at]) * p), p)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


def _partition(batches) -> tuple[np.ndarray, np.ndarray]:
    keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        keys.append(b.column(0).to_numpy()), n.append(b.column(1).to_numpy())
    return np.concatenate(keys).view(np.uint64), np.concatenate(n)


def gram_table(counts: DataFrame, depth: int) -> DataFrame:
    """counts(key, n) -> (key, value): log10 probability of each gram. Zero counts are grams that are only asked for."""
    spark = counts.sparkSession
    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFFFF).cast("long"))
    counts = materialize(counts, "grams")
    dealt = counts.repartition(max(shuffle_partitions(spark), counts.count() // PARTITION_GRAMS + 1), context).select("key", "n")

    def tops(batches):
        keys, n = _partition(batches)
        keys, n = keys[n > 0], n[n > 0]
        if len(keys):
            tags, *sums = to_top(keys, n, depth)
            yield pa.RecordBatch.from_arrays([pa.array(tags.view(np.int64)), *map(pa.array, sums)], names=["tag", "zeros", "ones", "children"])

    sums = dealt.mapInArrow(tops, "tag long, zeros double, ones double, children double").groupBy("tag").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")]).toPandas()
    top = spark.sparkContext.broadcast(top_tables(sums["tag"].to_numpy(np.int64).view(np.uint64), *(sums[c].to_numpy(np.float64) for c in ("zeros", "ones", "children"))))

    def scores(batches):
        keys, n = _partition(batches)
        if len(keys):
            s = gram_scores(keys, n, depth, top.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(s)], names=["key", "value"])

    return dealt.mapInArrow(scores, "key long, value double")


# --- the operator -----------------------------------------------------------------------------------------------------


def look_up(codes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each code; codes are sorted with their places in chunks, so the search walks the keys in order."""
    out = np.empty(len(codes))
    for i in range(0, len(codes), 1 << 16):
        part = codes[i : i + (1 << 16)]
        packed = np.sort(part << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
        code, place = packed >> np.uint64(16), (packed & np.uint64(0xFFFF)).astype(np.int64)
        first = np.concatenate([[True], code[1:] != code[:-1]])
        found = values[np.searchsorted(keys, code[first])]
        out[i + place] = found[np.cumsum(first) - 1]
    return out


def score_block(docs: pa.Table, asked: pa.Table, depth: int, tokens: int, distinct: int) -> pa.Table:
    """The result rows of a block's documents, given the answers to its grams and words."""

    def answers(kind):
        mine = asked.filter(pc.equal(asked["kind"], kind))
        k, v = mine["key"].to_numpy().view(np.uint64), mine["value"].to_numpy()
        order = np.argsort(k)
        return k[order], v[order]

    (word_keys, word_counts), (gram_keys, gram_logs) = answers(WORD), answers(GRAM)
    columns: dict[str, list[np.ndarray]] = {"n_tokens": [], "n_known": [], "base_score": [], "score": [], "bits_per_byte": []}
    for b in sliced(docs.select(["text"]).to_batches(), 200):
        part = [lowered(t) for t in b.column(0).to_pylist()]
        begins = np.cumsum([0] + [len(t) + 1 for t in part[:-1]])
        columns["score"].append(np.add.reduceat(look_up(grams(part, depth), gram_keys, gram_logs), begins))
        columns["bits_per_byte"].append(columns["score"][-1] / -math.log10(2) / np.array([len(t) + 1 for t in part]))
        number: dict[bytes, int] = {}
        lists = [t.split() + [END] for t in part]
        at = np.array([number.setdefault(w, len(number)) for ws in lists for w in ws], dtype=np.int64)
        hashed = np.array([xxhash.xxh64_intdigest(w, 42) for w in number], dtype=np.uint64)
        c = word_counts[np.searchsorted(word_keys, hashed)]
        logs = np.log10((c + ALPHA) / (tokens + ALPHA * (distinct + 1)))
        n = np.array([len(ws) for ws in lists], dtype=np.int64)
        begins = np.cumsum(n) - n
        columns["n_tokens"].append(n)
        columns["n_known"].append(np.add.reduceat((c > 0).astype(np.int64)[at], begins))
        columns["base_score"].append(np.add.reduceat(logs[at], begins))
    out = {k: pa.array(np.concatenate(v)) for k, v in columns.items()}
    return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": out["n_tokens"], "n_known": out["n_known"], "train_tokens": pa.array([tokens] * docs.num_rows, pa.int64()), "base_score": out["base_score"], "score": out["score"], "bits_per_byte": out["bits_per_byte"]})


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: base_score and score are log10 probabilities of the whole lower-cased text.

    score covers every byte and the end of the text; bits_per_byte is the code length per byte: -score / log10(2) over the
    bytes and the end.
    Ids are whole numbers. Null texts are empty: one token, the end. Null ids count as the empty string for the split. Where no document is
    left for training, every byte decision has probability 1/2.
    """
    if not TOP < depth <= 5:
        raise ValueError("depth is 3 to 5: a gram and its place in a chunk share 64 bits")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_blocks = max(MIN_BLOCKS, size // block_bytes + 1)
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_blocks)).cast("int")
    keyed = docs.select(block.alias("block"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    asked = materialize(gather(keyed.select("block", "held_out", "text").repartition(n_blocks, "block"), depth), "asked")
    words = materialize(asked.filter(f"kind = {WORD}").groupBy("key").agg(F.sum("n").alias("n")), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    values = gram_table(asked.filter(f"kind = {GRAM}").groupBy("key").agg(F.sum("n").alias("n")), depth).withColumn("kind", F.lit(GRAM).cast("tinyint"))
    values = values.unionByName(words.select("key", F.col("n").cast("double").alias("value"), F.lit(WORD).cast("tinyint").alias("kind")))
    answers = asked.select("block", "kind", "key").join(values, ["kind", "key"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            return pa.table({name: pa.array([], kinds[kind]) for name, kind in (c.split() for c in RESULT.split(", "))})
        out = score_block(left, right, depth, tokens, distinct)
        release()
        return out

    return keyed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RESULT)


def op5_ctw_scores(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
