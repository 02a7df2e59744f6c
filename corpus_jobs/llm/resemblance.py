"""Near-duplicates by SimHash and multi-index hashing, verified by the exact Jaccard similarity of word shingles.

A text is the set of its five-word shingles. Sets of similarity 0.8 differ in about 15 of 100 SimHash bits, too many for
operator 1's 64 bits and radius, so fingerprints here are longer: they are cut into segments of at least 16 bits, and under
each a set enters a table with the ball of its doubtful bits, those with the closest votes, where near sets differ first.
Those that meet under a value are compared by 128 other bits of the fingerprint, and those within RADIUS by their sets: the similarity of
every link is exact. A pair at 0.8 meets nowhere about once in a million (a few millions for some sizes of small sets), by
calculation, and more alike pairs far more seldom.

Groups never expand into pairs, and no pair is given up for that. Equal sets are one node. Nodes under a value that near
fingerprints connect are a family. The task that reads a value gives the pairs of a family's members with its centre only;
of a node's centres the least is kept, and the others are paired with that one, so that there are about as many pairs as
nodes, however many values they meet under. Those that are similar give provisional groups; two members of one group need no further link. Groups that pairs connect are a
cluster, which holds all that meet: every node is in one. In it the members outside the largest group are compared with all
of other groups, in tasks that take some of them each. Only of clusters with very many outside are the families themselves
looked at, and where these have over CROWD members, they enter more and longer segments first, which similar pairs share as
surely and others far more seldom.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, materialize, release, sliced, with_last
from .simhash import connected

SHINGLE_WORDS = 5
#: Least similarity of a link, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Bits of a segment, at least, and segments of that length. A bit more makes similar sets share a segment 1.17 times more seldom.
BITS, SEGMENTS, MORE = 16, 34, 1.17
#: Bits of a segment with the closest votes: a set enters under all values that changes of these make.
DOUBTFUL = 2
#: Bits that are compared, and how many of them may differ; about 19 do at 0.8, and 64 of unlike sets.
COMPARED, RADIUS = 128, 42
#: A family with more members of several groups is split by longer segments, and a cluster with WHOLE times as many outside
#: its largest group by its families; this bounds work, not results.
CROWD, WHOLE = 1000, 10
#: Members outside the largest group that a task holds at once, the shingles that these have, and members it holds them against.
HELD, HELD_SHINGLES, BLOCK = 500, 1000000, 1000
FINE_BITS, FINE_SEGMENTS, FINE_DOUBTFUL = 28, 104, 3
#: Nodes of one value that a task compares by their distances; of more, all are one family.
WIDE = 20000

PRINTS = [f"f{i}" for i in range(COMPARED // 64)]
CENTRE = [f"c{i}" for i in range(COMPARED // 64)]
PRINT = T.StructType([T.StructField(f, T.LongType(), False) for f in PRINTS] + [T.StructField("segments", T.ArrayType(T.LongType(), False), False)])
NODE = T.StructType([T.StructField("node", T.BinaryType(), False), T.StructField("n", T.LongType(), False), *PRINT])


def shingles(text: str | None) -> np.ndarray:
    """The sorted set of shingle hashes; a shorter text is one shingle, a text without words has none."""
    words = as_bytes(text).lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    whole = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], dtype="<u8")
    starts, at = [0], 0
    for w in words:
        at += len(w) + 1
        starts.append(at)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a : b - 1], 42) for a, b in zip(starts, starts[SHINGLE_WORDS:])], dtype="<u8"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as other ones that look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(found: np.ndarray, bits: int = BITS, count: int = SEGMENTS, doubtful: int = DOUBTFUL) -> tuple[list[int], list[int]]:
    """(The compared bits as signed 64-bit numbers, the segments) of a set's SimHash.

    A segment is its value, with the places of its doubtful bits from bit 32 on, five bits each. Votes of small sets are
    close, so they have more segments; under four shingles only equal sets are similar, and there are none.
    """
    if len(found) < OVER:
        return [0] * (COMPARED // 64), []
    count *= 6 if len(found) < 8 else 3 if len(found) < 40 else 1
    steps = np.arange(1, -(-(COMPARED + bits * count) // 64) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    votes = np.zeros(64 * len(steps), dtype=np.int64)
    for i in range(0, len(found), 255):  # a byte counts as far
        h = _mixed(found[i : i + 255, None] + steps)
        votes += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    votes = 2 * votes - len(found)
    compared = np.packbits(votes[:COMPARED] > 0, bitorder="little").view("<i8").tolist()
    votes = votes[COMPARED : COMPARED + bits * count].reshape(count, bits)
    values = (votes > 0) @ (1 << np.arange(bits))
    places = np.argsort(np.abs(votes), axis=1, kind="stable")[:, :doubtful]
    return compared, (values | (places << (32 + 5 * np.arange(doubtful))).sum(1)).tolist()


def _columns(made: list[tuple[list[int], list[int]]]) -> list[pa.Array]:
    return [*(pa.array([m[0][i] for m in made], pa.int64()) for i in range(len(PRINTS))), pa.array([m[1] for m in made], pa.list_(pa.int64()))]


def prints_of(text: Column, bits: int) -> Column:
    """The node of a text, the size of its set and the set's fingerprint."""
    count = math.ceil(SEGMENTS * MORE ** (bits - BITS))

    @F.arrow_udf(NODE)
    def of(text: pa.Array) -> pa.Array:
        nodes, sizes, made = [], [], []
        for t in text:
            found = shingles(t.as_py())
            nodes.append(xxhash.xxh3_128_digest(found.tobytes()))
            sizes.append(len(found))
            made.append(fingerprint(found, bits, count, DOUBTFUL))
        release()
        return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), *_columns(made)], names=NODE.names)

    return of(text)


def finer(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """nodes(node, n) with the fingerprints of long segments."""

    @F.arrow_udf(PRINT)
    def of(s: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_columns([fingerprint(np.array(x.as_py(), dtype="<i8").view("<u8"), FINE_BITS, FINE_SEGMENTS, FINE_DOUBTFUL) for x in s]), names=PRINT.names)

    return nodes.join(sets, "node").select("node", "n", of("s").alias("p")).select("node", "n", "p.*")


def _changed(values: Column, bit: Column) -> Column:
    """The values as they are and with the bit changed."""
    return F.concat(values, F.transform(values, lambda v: v.bitwiseXOR(bit)))


def table_of(nodes: DataFrame, doubtful: int = DOUBTFUL) -> DataFrame:
    """nodes(f0, f1, segments) -> (key, f0, f1), a row per value that a set enters under."""
    rows = nodes.select(*PRINTS, F.posexplode("segments").alias("i", "x"))
    values = F.array(F.col("x").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    for d in range(doubtful):
        place = F.shiftright("x", 32 + 5 * d).bitwiseAND(F.lit(31).cast("long")).cast("int")
        values = _changed(values, F.call_function("shiftleft", F.lit(1).cast("long"), place))
    key = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("value"))
    return rows.withColumn("value", F.explode(values)).select(key.alias("key"), *PRINTS)


def labelled(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of so many members the least one that it reaches over the links (a, b)."""
    labels = np.arange(size)
    while True:
        least, new = np.minimum(labels[a], labels[b]), labels.copy()
        for x in (labels[a], labels[b]):
            np.minimum.at(new, x, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def near(prints: list[np.ndarray], i, j) -> np.ndarray:
    """Whether members i and j are within the radius."""
    return sum(np.bitwise_count(f[i] ^ f[j]) for f in prints) <= RADIUS


def family_of(key: np.ndarray, prints: list[np.ndarray], few: int = 256) -> np.ndarray:
    """For each row of sorted keys the first row of its key that it reaches over near ones."""
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    sizes = np.diff(cuts)
    ends = np.repeat(cuts[1:], sizes)
    at, step, a, b = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= few), sizes)), 1, [], []
    while len(at := at[at + step < ends[at]]):
        close = at[near(prints, at, at + step)]
        a.append(close), b.append(close + step)
        step += 1
    labels = labelled(len(key), *(np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b)))
    for k in np.flatnonzero(sizes > few).tolist():
        left = np.arange(cuts[k], cuts[k + 1])
        while len(left):
            first, todo, left = left[0], left[:1], left[1:]
            while len(todo) and len(left):  # some members at a time are held against all that are left
                some = max(1, (1 << 16) // len(left))
                now, todo = todo[:some], todo[some:]
                met = near(prints, now[:, None], left[None, :]).any(0)
                labels[left[met]] = first
                todo, left = np.concatenate([todo, left[met]]), left[~met]
    return labels


def distinct_pairs(found: list[np.ndarray]) -> np.ndarray:
    """The columns of the distinct rows (f0, f1, c0, c1) whose fingerprints differ."""
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[(pairs[:, : len(PRINTS)] != pairs[:, len(PRINTS) :]).any(1)].T


def read_centres(batches):
    """Pairs (f0, f1, c0, c1) sorted by member -> pairs that connect the same fingerprints: each member with the least of its
    centres, and its other centres, which many members share, with that one."""
    for b in batches:
        if b.num_rows:
            pairs = np.stack([b.column(i).to_numpy().view(np.uint64) for i in range(b.num_columns)], 1)
            member, centre = pairs[:, : len(PRINTS)], pairs[:, len(PRINTS) :]
            order = np.lexsort((_mixed(centre[:, 0] + _mixed(centre[:, 1])), member[:, 1], member[:, 0]))
            member, centre = member[order], centre[order]
            starts = np.flatnonzero(np.append(True, (member[1:] != member[:-1]).any(1)))
            least = np.repeat(centre[starts], np.diff(np.append(starts, len(order))), axis=0)
            found = distinct_pairs([np.concatenate([x, least], 1) for x in (member, centre)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found], names=[*PRINTS, *CENTRE])
    release()


def read_families(batches, centres: bool, most: int):
    """Batches (key, f0, f1) sorted by key -> (key, f0, f1) of the members of families of two or more, under keys that are made
    of the members, or with centres (f0, f1, c0, c1), the distinct pairs of a member and another one that is its family's centre.
    A value with more nodes than most is one family."""
    names = [*PRINTS, *CENTRE] if centres else ["key", *PRINTS]
    held, wide, middle = None, None, None
    for last, b in with_last(batches):
        rows = [b.column(i).to_numpy() for i in range(b.num_columns)]
        key, *prints = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        if not len(key):
            continue
        begin = 0 if wide is None else int(np.searchsorted(key, wide, side="right"))
        end = len(key) if last else max(begin, int(np.searchsorted(key, key[-1])))  # the last key goes on in the next batch
        rest = len(key)
        if len(key) - end > most:
            wide, rest = key[-1], end
        prints = [f.view(np.uint64) for f in prints]
        done = [f[begin:end] for f in prints]
        labels = family_of(key[begin:end], done)
        members = np.flatnonzero(np.bincount(labels, minlength=len(labels))[labels] > 1)
        marks = _mixed(prints[0] + _mixed(prints[1]))
        if centres:  # the member with the least mark
            order = members[np.lexsort((marks[begin:end][members], labels[members]))]
            starts = np.flatnonzero(np.diff(labels[order], prepend=-1))
            firsts = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
            found = [[f[order] for f in done] + [f[firsts] for f in done]]
            if begin:  # rows of values with too many nodes
                found.append([f[:begin] for f in prints] + [np.full(begin, c) for c in middle])
            if rest < len(key):
                middle = [f[rest + marks[rest:].argmin()] for f in prints]
                found.append([f[rest:] for f in prints] + [np.full(len(key) - rest, c) for c in middle])
            found = distinct_pairs([np.stack(x, 1) for x in found])
        else:
            sums = np.zeros(len(labels), dtype=np.uint64)
            np.add.at(sums, labels, marks[begin:end])
            whole = np.concatenate([np.arange(begin), np.arange(rest, len(key))])
            found = [np.concatenate([sums[labels[members]], _mixed(key[whole].view(np.uint64))])]
            found += [np.concatenate([d[members], f[whole]]) for d, f in zip(done, prints)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found], names=names)
        held = [key[end:rest], *(f[end:rest].view(np.int64) for f in prints)]
    release()


def families(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """table(key, f0, f1), nodes(node, n, f0, f1) -> (key, node, n): the members of each family of two or more, under a key
    that is made of the members, so that it comes once whatever number of values they meet under. The table holds no
    nodes, and those with a family's fingerprints are its members."""
    found = table.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: read_families(x, False, WIDE), "key long, f0 long, f1 long").distinct()
    return found.join(nodes.select("node", "n", *PRINTS), PRINTS).select("key", "node", "n")


def meeting(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """table(key, f0, f1), nodes(node, n, f0, f1) -> (a, an, b, bn): nodes a with the centres b of their families, and their
    sizes. The pairs connect all nodes of a family, and nodes of equal fingerprints."""
    nodes = nodes.filter(F.col("n") >= OVER).select("node", "n", *PRINTS)
    firsts = nodes.groupBy(*PRINTS).agg(F.min(F.struct("node", "n")).alias("c")).select(*PRINTS, F.col("c.node").alias("b"), F.col("c.n").alias("bn"))
    members = nodes.select(F.col("node").alias("a"), F.col("n").alias("an"), *PRINTS)
    pair = "f0 long, f1 long, c0 long, c1 long"
    found = table.repartition("key").sortWithinPartitions("key").mapInArrow(lambda x: read_families(x, True, WIDE), pair)
    found = found.repartition(*PRINTS).sortWithinPartitions(*PRINTS).mapInArrow(read_centres, pair).distinct()
    pairs = found.join(members, PRINTS).join(firsts.select("b", "bn", *(F.col(f).alias(c) for f, c in zip(PRINTS, CENTRE))), CENTRE)
    equal = members.join(firsts, PRINTS).filter("a <> b")
    return pairs.select("a", "an", "b", "bn").unionByName(equal.select("a", "an", "b", "bn"))


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s): the shingle hashes of each of nodes(node, least), read again from the document with the least id."""

    def read(batches):
        for b in sliced(batches):
            found = [shingles(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary()), pa.array([f.view("<i8") for f in found], pa.list_(pa.int64()))], names=["node", "s"])

    texts = docs.join(nodes.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    found = texts.mapInArrow(read, "node binary, s array<long>").join(nodes.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.first("s").alias("s"))


def _sized(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return UNDER * F.least(a, b) >= OVER * F.greatest(a, b)


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(a, b) whose sets are similar enough: |A and B| / |A or B| >= OVER / UNDER in whole numbers."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared * (OVER + UNDER) >= OVER * (F.size("sa") + F.size("sb"))).select("a", "b")


def unresolved(buckets: DataFrame, group: DataFrame, name: str, settled: int = 1) -> DataFrame:
    """buckets(key, node, n) -> the rows of keys that hold several groups of group(node, label), with label, outside (not
    of the key's largest group), and per key the number m of rows, the number others of those outside and their shingles.
    Keys with as many members as settled, or fewer, are left out."""
    held = buckets.join(group, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    parts = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    largest = F.max(F.struct("m", "label", "shingles"))
    mains = parts.groupBy("key").agg(largest.alias("x"), F.sum("m").alias("m"), F.sum("shingles").alias("shingles"), F.count(F.lit(1)).alias("groups")).filter(f"groups > 1 and m > {settled}")
    mains = mains.select("key", F.col("x.label").alias("main"), "m", (F.col("m") - F.col("x.m")).alias("others"), (F.col("shingles") - F.col("x.shingles")).alias("shingles"))
    return materialize(held.join(mains, "key").select("key", "node", "n", "label", (F.col("label") != F.col("main")).alias("outside"), "m", "others", "shingles"), name)


class Asking:
    """The members outside the largest group of a key, which all its members are held against."""

    def __init__(self, rows: list[tuple[bytes, bytes, np.ndarray]]):
        self.rows, self.linked = rows, set()
        self.labels = [label for _, label, _ in rows]
        self.sizes = np.array([len(s) for _, _, s in rows])
        values, owner = np.concatenate([s for _, _, s in rows]), np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def links(self, node: bytes, label: bytes, s: np.ndarray):
        """Yields (asking node, node) for those similar to the set s, once for each other group."""
        first, last = np.searchsorted(self.values, s), np.searchsorted(self.values, s, side="right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.rows))
        for i in np.flatnonzero(shared * (OVER + UNDER) >= OVER * (self.sizes + len(s))).tolist():
            if self.labels[i] != label and (i, label) not in self.linked:
                self.linked.add((i, label))
                yield self.rows[i][0], node


def compared(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect whatever similar pairs of different groups under one key connect.

    The members outside a key's largest group ask. A key with more than HELD that ask, or than BLOCK members, is dealt into
    parts of those that ask and blocks of members, and each part with each block is a stream: the part, to be held, then the
    block. Who asks is not in blocks for later parts, where the other one asks. No pair of members is ever a row.
    """
    parts = F.ceil(F.greatest(F.col("others") / HELD, F.col("shingles") / HELD_SHINGLES)).cast("int")
    rows = mixed.join(sets, "node").select("key", "node", "label", "outside", "s", parts.alias("parts"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    own = F.when(F.col("outside"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("own", own).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    to = lambda part, block, turn: F.struct(part.alias("part"), block.alias("block"), F.lit(turn).alias("turn"))
    among = F.transform(F.sequence(F.lit(0), F.coalesce("own", F.col("parts") - 1)), lambda p: to(p, F.col("block"), 1))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: to(F.col("own"), b, 0))
    dealt = F.explode(F.when(F.col("outside"), F.concat(asks, among)).otherwise(among))
    streams = rows.select("key", dealt.alias("x"), "node", "label", "s").select("key", "x.*", "node", "label", "s")

    def run(batches):
        now, held, asking = None, [], None
        for b in sliced(batches, 100):
            found = []
            for key, part, block, turn, node, label, s in zip(*(b.column(i).to_pylist() for i in range(6)), (x.values.to_numpy() for x in b.column(6))):
                if now != (key, part, block):
                    now, held, asking = (key, part, block), [], None
                if turn == 0:
                    held.append((node, label, s))
                elif held:
                    asking = asking or Asking(held)
                    found += asking.links(node, label, s)
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return streams.repartition("key", "part", "block").sortWithinPartitions("key", "part", "block", "turn").mapInArrow(run, "a binary, b binary")


def by_families(nodes: DataFrame, group: DataFrame, sets: DataFrame, crowd: int) -> DataFrame:
    """Links (a, b) that connect similar pairs of different groups in the families of nodes."""
    mixed = unresolved(families(table_of(nodes), nodes), group, "mixed", settled=2)  # of two members one is the centre
    crowded = materialize(mixed.filter(F.col("m") > crowd).select("node", "n").distinct(), "crowded")
    long = materialize(finer(crowded, sets), "long")
    fine = families(table_of(long, FINE_DOUBTFUL), long)
    return compared(mixed.filter(F.col("m") <= crowd), sets).unionByName(compared(unresolved(fine, group, "fine"), sets))


def links_of(docs: DataFrame, nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all pairs that meet and are similar enough."""
    met = materialize(meeting(table_of(nodes), nodes), "met")
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("an").alias("n")), F.struct(F.col("b").alias("node"), F.col("bn").alias("n"))))
    ends = materialize(met.select(ends.alias("x")).select("x.*").distinct(), "ends")
    sets = materialize(sets_of(docs, nodes.join(ends, "node", "left_semi").select("node", "least")), "sets")
    stars = materialize(alike(met.filter(_sized("an", "bn")).select("a", "b"), sets), "stars")
    group = materialize(connected(stars).select("node", "label"), "group")
    label = lambda x: group.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    between = met.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    clusters = connected(between).select(F.col("node").alias("label"), F.col("label").alias("key"))
    held = ends.join(group, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")).join(clusters, "label")
    mixed = unresolved(held.select("key", "node", "n"), group, "mixed", settled=2)
    whole, large = mixed.filter(F.col("others") <= WHOLE * crowd), mixed.filter(F.col("others") > WHOLE * crowd)
    links = stars.unionByName(compared(whole, sets))
    if large.isEmpty():
        return links
    return links.unionByName(by_families(materialize(nodes.join(large.select("node"), "node", "left_semi"), "large"), group, sets, crowd))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, component_id) per row of docs without a null id; component_id is the smallest doc_id reachable over links.

    Texts without words are equal. Repeated rows come out as often as they go in.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    # segments grow with the number of documents, so that a value has some tens of unlike sets whatever the size
    bits = min(32, max(BITS, docs.count().bit_length() - 4))
    prints = materialize(docs.select("doc_id", prints_of(F.col("text"), bits).alias("p")).select("doc_id", "p.*"), "prints")
    nodes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", *PRINTS, "segments")]), "nodes")
    labels = connected(links_of(docs, nodes, crowd))
    named = materialize(nodes.select("node", "least").join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "node").join(named.join(ids, "label").select("node", "component_id"), "node").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the rows with the smallest id stay, with all their columns.

    Rows with a null id cannot be told apart by id and stay. Rows that share an id are one document and stay together.
    """
    stay = components(docs, id_col, text_col).groupBy("doc_id").agg(F.min("component_id").alias("component_id")).filter("doc_id = component_id")
    kept = docs.join(stay.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
