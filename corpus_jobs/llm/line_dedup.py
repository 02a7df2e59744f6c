"""Line de-duplication over a sharded minimal perfect hash.

The distinct 128-bit line hashes, with the number of lines and the least and greatest document id of each (partial sums
before the shuffle), are dealt into shards, and each shard gets a minimal perfect hash: levels of bit arrays in which
every key sets the bit that no other key of its level sets, so that a key's rank among set bits is its slot. The slots
index three compact arrays: a 32-bit fingerprint, the number of documents that hold the line (one, or more), and the least
of their ids.

Documents do not join lines with lines: a line's hash goes to its shard and probes the arrays there, in numpy batches,
and the count decides. There are so many shards that a shard has a bounded share of the lines; one that more probes will
reach all the same (it holds a very common line) is copied, and its probes are dealt over the copies, so that no task
gets more than a few times the mean.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, as_bytes, documents, materialize, release, shuffle_partitions, sliced

MIN_CHARS = 10
#: Distinct lines of a shard, and lines that probe one copy of it, about.
SHARD_KEYS, SHARD_PROBES = 200_000, 500_000
GAMMA = 2
MANY = 2


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()


def long_enough(key: bytes, least: int = MIN_CHARS) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def hashes(text: str | None, least: int = MIN_CHARS) -> list[tuple[int, bytes]]:
    """(line number, 16-byte hash of the key) of the lines whose key is long enough."""
    return [(i, xxhash.xxh3_128_digest(k)) for i, k in enumerate(map(line_key, as_bytes(text).split(b"\n"))) if long_enough(k, least)]


# --- minimal perfect hash ---------------------------------------------------------------------------------------


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit finaliser, another one on every level."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray, gamma: int = GAMMA) -> tuple[list[int], np.ndarray]:
    """(bits of each level, bit array) of a minimal perfect hash over distinct 64-bit keys."""
    sizes, parts, rest = [], [], keys
    while len(rest):
        if len(sizes) > 200:
            raise ValueError("the keys are not distinct")
        m = max(64, gamma * len(rest))
        at = (mix(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        parts.append(alone)
        rest = rest[~alone[at]]
    return sizes, np.concatenate(parts) if parts else np.zeros(0, dtype=bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for one that meets no bit; keys outside the set may get a slot too."""
    rank = np.cumsum(bits) - bits
    out, todo, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
    for level, m in enumerate(sizes):
        at = base + (mix(keys[todo], level) % np.uint64(m)).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = rank[at[hit]]
        todo, base = todo[~hit], base + m
        if not len(todo):
            break
    return out


INDEX = "shard int, sizes array<long>, bits binary, prints binary, counts binary, owners binary"


def _keys(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Equal first halves of different lines are told apart by mixing in the second."""
    return h1.view(np.uint64) ^ mix(h2.view(np.uint64), 77)


def _prints(h2: np.ndarray) -> np.ndarray:
    return (h2.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _index_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = pdf["h1"].to_numpy(np.int64), pdf["h2"].to_numpy(np.int64)
    keys = _keys(h1, h2)
    sizes, bits = build(keys)
    at = slots(keys, sizes, bits)
    prints, counts, owners = np.empty(len(pdf), np.uint32), np.empty(len(pdf), np.uint8), np.empty(len(pdf), np.int64)
    prints[at], counts[at], owners[at] = _prints(h2), np.where(pdf["several"], MANY, 1), pdf["owner"].to_numpy(np.int64)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "sizes": [sizes], "bits": [np.packbits(bits).tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "owners": [owners.tobytes()]})


def _probe(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"doc_id": pd.Series(dtype="int64"), "version": pd.Series(dtype="int64"), "line": pd.Series(dtype="int32")})
    if not len(index) or not len(probes):
        return out
    x = index.iloc[0]
    sizes = list(map(int, x["sizes"]))
    prints, counts, owners = np.frombuffer(x["prints"], np.uint32), np.frombuffer(x["counts"], np.uint8), np.frombuffer(x["owners"], np.int64)
    bits = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=sum(sizes)).astype(bool)
    h1, h2, ids = (probes[c].to_numpy(np.int64) for c in ("h1", "h2", "doc_id"))
    at = slots(_keys(h1, h2), sizes, bits)
    if (at < 0).any() or (prints[at] != _prints(h2)).any():
        raise RuntimeError("a line is not in the index of its shard")
    return probes.loc[(counts[at] >= MANY) & (owners[at] != ids), ["doc_id", "version", "line"]]


# --- the operator -----------------------------------------------------------------------------------------------


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, version, line, h1, h2) of every line whose key is long enough; version tells texts of one id apart."""

    def emit(batches):
        for b in sliced(batches):
            ids, versions, lines, digests = [], [], [], []
            for i, v, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                for n, d in hashes(t, least):
                    ids.append(i), versions.append(v), lines.append(n), digests.append(d)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(lines, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "version", "line", "h1", "h2"])
        release()

    return docs.select("doc_id", "version", "text").mapInArrow(emit, "doc_id long, version long, line int, h1 long, h2 long")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, owner, several, n): distinct line hashes, the smallest doc_id that holds each, whether another one does, and
    the number of lines."""
    found = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    return found.select("h1", "h2", "owner", (F.col("owner") != F.col("last")).alias("several"), "n")


def dropped_lines(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """docs(doc_id, version, text) -> (doc_id, version, dropped array<int>): the lines to drop, where there are any."""
    spark = docs.sparkSession
    lines = materialize(_lines(docs.filter("doc_id is not null"), least), "lines")
    distinct = materialize(distinct_lines(lines), "distinct")
    n_distinct, n_lines = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_shards = max(4 * shuffle_partitions(spark), n_distinct // SHARD_KEYS + 1, n_lines // SHARD_PROBES + 1)
    shard = F.pmod(F.col("h1"), F.lit(n_shards)).cast("int")
    keyed = distinct.withColumn("shard", shard)
    index = materialize(keyed.groupBy("shard").applyInPandas(_index_shard, INDEX), "index")
    # how many copies a shard needs: one row per shard, read from files, so Spark knows that it is small
    copies = F.greatest(F.ceil(F.sum("n") / (2 * max(1.0, n_lines / n_shards))), F.lit(1)).cast("int")
    loads = materialize(keyed.groupBy("shard").agg(copies.alias("copies")), "loads")
    placed = index.join(loads, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    probes = lines.withColumn("shard", shard).join(loads, "shard")
    probes = probes.withColumn("copy", F.pmod(F.xxhash64("doc_id", "line"), F.col("copies")).cast("int")).drop("copies")
    found = placed.drop("copies").groupBy("shard", "copy").cogroup(probes.groupBy("shard", "copy")).applyInPandas(_probe, "doc_id long, version long, line int")
    return found.groupBy("doc_id", "version").agg(F.collect_set("line").alias("dropped"))  # no more than the document's own lines


def _with_dropped(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(whole, text, dropped) per row of docs; whole is the struct of all its columns."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("version"))
    return named.join(dropped_lines(named.select("doc_id", "version", "text"), least), ["doc_id", "version"], "left").select("whole", "text", "dropped")


KEPT = "struct<n_lines:bigint,n_dropped:bigint,kept:string,sha256:string>"


def _kept(with_text: bool):
    @F.arrow_udf(KEPT)
    def of(text: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for t, d in ((x.as_py(), y.as_py()) for x, y in zip(text, dropped)):
            lines = (t or "").split("\n")
            drop = set(d or ())
            kept = "\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else (t or "")
            out.append((len(lines), len(drop), kept if with_text else None, None if with_text else hashlib.sha256(as_bytes(kept)).hexdigest()))
        n, k, s, h = zip(*out) if out else ((), (), (), ())
        release()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(s, pa.string()), pa.array(h, pa.string())], names=["n_lines", "n_dropped", "kept", "sha256"])

    return of


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per row of docs. Ids are whole numbers.

    Null and empty texts are one empty line. A row with a null id owns no line and loses none. Rows that share an id
    count as one document: a line that only they hold stays in all of them.
    """
    out = _with_dropped(docs.select(id_col, text_col), id_col, text_col, least)
    return out.select(F.col("whole").getField(id_col).alias("doc_id"), _kept(False)("text", "dropped").alias("k")).select("doc_id", "k.n_lines", "k.n_dropped", F.col("k.sha256").alias("kept_sha256"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """docs with repeated lines taken out of its texts and all other columns as they are. Null texts stay null."""
    out = _with_dropped(docs, id_col, text_col, least)
    text = F.when(F.size("dropped") > 0, _kept(True)("text", "dropped").getField("kept")).otherwise(F.col("text"))
    return out.select("whole", text.alias("text")).select(*[F.col("text").alias(c) if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns])


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
