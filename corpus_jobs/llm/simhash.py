"""Near-duplicates by SimHash and multi-index hashing.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most four bits differ in at most two
bits of one half or at most one bit of the other, so the radius-one Hamming balls of one of their halves share a value:
every fingerprint enters a table under the 33 values of the ball of each half, and only those that meet under one value
are compared in full.

Groups of copies never expand into pairs, and the work grows with the number of fingerprints, not with its square:
 * Equal fingerprints are one node.
 * Up to CROWD nodes under one value are compared in the task that reads them, and only the links that connect them
   come out, fewer than there are nodes.
 * A value with more nodes is refined by the other half. A node within one bit of the value puts in the points (value,
   other half with r bits changed), r being what is left of a radius of two. Two nodes under the value are within four
   bits just if they share a point, no point has more than 2081 nodes (the ball of radius two), and no node makes more
   than 529 points of one value. Points are then compared as values are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, documents, materialize, release, shuffle_partitions, with_last

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Nodes of one value that are compared in one task; a value with more of them is refined, so this bounds work, not results.
CROWD = 4096


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash; 0 for a null text or one without words."""
    words = as_bytes(text).lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= words_per_shingle:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        starts, at = [0], 0
        for w in words:
            at += len(w) + 1
            starts.append(at)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a : b - 1], 42) for a, b in zip(starts, starts[words_per_shingle:])]
    h = np.array(hashes, dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for a very long text
        bits += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row per row of docs; other columns are not read."""

    @F.arrow_udf(T.LongType())
    def of(text: pa.Array) -> pa.Array:
        found = pa.array([fingerprint(t, words_per_shingle) for t in (x.as_py() for x in text)], type=pa.int64())
        release()
        return found

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("fp"))


def _ball(value: Column, tag: int) -> Column:
    """The 33 values within one bit of a 32-bit half, marked with the half's number."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    return F.transform(masks, lambda m: value.bitwiseXOR(m).bitwiseOR(F.lit(tag << 32).cast("long")))


def _table(nodes: DataFrame) -> DataFrame:
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    high = F.shiftrightunsigned("fp", 32)
    return nodes.select("fp", F.explode(F.concat(_ball(low, 0), _ball(high, 1))).alias("key"))


def _points(crowded: DataFrame) -> DataFrame:
    """crowded(key, fp) -> (key, fp), key being a 64-bit point that agrees with the old key in its half and is within two
    bits of fp: the other half keeps one changed bit where the key has used one up, else two."""
    ones = [1 << i for i in range(32)]
    twos = [a | b for i, a in enumerate(ones) for b in ones[:i]]
    masks = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    full = F.lit(0xFFFFFFFF).cast("long")
    low, high = F.col("fp").bitwiseAND(full), F.shiftrightunsigned("fp", 32)
    upper, value = F.shiftrightunsigned("key", 32) == 1, F.col("key").bitwiseAND(full)
    own, other = F.when(upper, high).otherwise(low), F.when(upper, low).otherwise(high)
    change = F.when(own == value, masks([0, *ones, *twos])).otherwise(masks([0, *ones]))
    made = crowded.select("fp", upper.alias("upper"), value.alias("value"), other.alias("other"), F.explode(change).alias("change"))
    changed = F.col("other").bitwiseXOR(F.col("change"))
    point = F.when(F.col("upper"), F.shiftleft("value", 32).bitwiseOR(changed)).otherwise(F.shiftleft(changed, 32).bitwiseOR(F.col("value")))
    return made.select(point.alias("key"), "fp")


def spanning(fps: np.ndarray, max_distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links (a, b) within the distance that connect whatever pairs within it connect; fewer links than nodes."""
    left, a, b = fps, [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= max_distance
            if near.any():
                found = left[near]
                a.append(found), b.append(np.full(len(found), x))
                todo.extend(found)
                left = left[~near]
    return a, b


def _linked(table: DataFrame, max_distance: int) -> DataFrame:
    """table(key, fp) -> links (a, b) among the nodes of each key, which may have a few thousand."""

    def run(batches):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for last, b in with_last(batches):
            keys = np.concatenate([keys, b.column(0).to_numpy()])
            fps = np.concatenate([fps, b.column(1).to_numpy().view(np.uint64)])
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            ends = np.append(cuts, len(keys)) if last else cuts  # the last key goes on in the next batch
            begins = np.concatenate([[0], cuts])[: len(ends)]
            size = ends - begins
            two = begins[size == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_distance]
            left, right = [fps[two]], [fps[two + 1]]
            for i, j in zip(begins[size > 2].tolist(), ends[size > 2].tolist()):
                x, y = spanning(fps[i:j], max_distance)
                left += x
                right += y
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"])
            done = int(ends[-1]) if len(ends) else 0
            keys, fps = keys[done:], fps[done:]

    links = table.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges(a, b), label being the smallest node that it reaches.

    Alternating large-star and small-star steps, each a grouped minimum and a join; the links of a round are written to
    the shared folder, which cuts the lineage. Ends when a round changes nothing.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = materialize(links, "links")
    mark = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        links = materialize(small.select("x.u", "x.v").filter("u <> v").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))


def links_of(nodes: DataFrame, max_distance: int = MAX_DISTANCE, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all pairs within max_distance (at most 4)."""
    if not 0 <= max_distance <= 4:
        raise ValueError("two halves with radius-one balls find distances up to 4")
    # every node makes 66 rows: they are made by many tasks, however few would hold the nodes
    # (dealt by a hash of their own, since Spark leaves out a second dealing by the same column)
    table = _table(nodes.repartition(shuffle_partitions(nodes.sparkSession), F.xxhash64("fp")))
    full = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Spark takes the table for as small as the nodes it is made of, and would broadcast 66 rows of each
    met = materialize(table.hint("merge").join(full, "key"), "met")
    points = materialize(_points(met.filter(F.col("n") > crowd).select("key", "fp")), "points")
    return _linked(met.filter(F.col("n") <= crowd).select("key", "fp").unionByName(points), max_distance)


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_per_shingle: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id reachable over links.

    Null or wordless texts have fingerprint zero and are linked like any other. Null ids take part and are never a
    component's id unless all its ids are null. Repeated rows come out as often as they go in. An empty table gives none.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, words_per_shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected(links_of(nodes.select("fp"), max_distance)).select(F.col("node").alias("fp"), "label")
    named = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = materialize(named, "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the rows with the smallest id stay, with all their columns.

    Rows with a null id cannot be told apart by id and stay. Rows that share an id are one document and stay together.
    """
    found = components(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    stay = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id")).filter("doc_id = component_id")
    kept = docs.join(stay.select(F.col("doc_id").alias(id_col)), id_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
