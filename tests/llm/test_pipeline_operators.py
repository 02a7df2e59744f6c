import random
import re

import pytest
from corpus_jobs.llm import decontamination, line_dedup, packing, quality, simhash, token_counts, token_files
from corpus_jobs.llm.common import materialize, new_path
from pyspark.sql import functions as F

from . import brute
from .conftest import SMALL, as_rows

NO_ID = [(None, "a text without an id\nsame line of text here")] * 2


def test_simhash_is_brute_force(spark, odd_docs, rows):
    got = simhash.components(odd_docs)
    got = sorted([(r["doc_id"], f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in got.collect()], key=str)
    assert got == brute.simhash(rows + NO_ID)


@pytest.mark.parametrize("crowd", [3, simhash.CROWD])
def test_simhash_links_within_a_dense_group(spark, crowd):
    """Chains and dense groups of fingerprints, against all pairs; with a small crowd, values are refined by points."""
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randrange(8)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["label"] for r in simhash.connected(simhash.links_of(nodes, crowd=crowd)).collect()}
    want = list(signed)
    for i, a in enumerate(signed):  # labels spread over all pairs until nothing changes
        pass
    at = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= 4 and at[b] < at[a]:
                    at[a], changed = at[b], True
    assert {x: got.get(x, x) for x in want} == at


def test_simhash_work_is_linear_in_a_group_of_near_copies(spark):
    """Rows that are compared and links that come out, for one group of near copies of two sizes."""

    def made(n):
        rng, docs = random.Random(n), []
        base = [f"w{i}" for i in range(120)]
        for i in range(n):
            words = list(base)
            for j in rng.sample(range(120), rng.randrange(1, 4)):
                words[j] = f"x{rng.randrange(10**6)}"
            docs.append((i, " ".join(words)))
        nodes = simhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).select("fp").distinct()
        n = nodes.count()
        points = simhash._points(simhash._table(nodes)).count()
        return simhash._table(nodes).count() / n, points / n, simhash.links_of(nodes).count() / n, simhash.links_of(nodes, crowd=8).count() / n

    small, large = made(150), made(600)
    assert small[0] == large[0] == 66 and small[1] == large[1] == 2 * 529 + 64 * 33
    for few, many in zip(small[2:], large[2:]):  # links a node grow until all its values are crowded, and no further than these
        assert few <= many <= 66


def test_simhash_table_is_never_broadcast(spark, monkeypatch):
    """It has 66 rows a node, which Spark does not count when it sizes a table for a broadcast."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return materialize(df, name)

    monkeypatch.setattr(simhash, "materialize", noted)
    simhash.links_of(materialize(spark.range(200).select(F.xxhash64("id").alias("fp")), "nodes"))
    assert "SortMergeJoin" in plans["met"] and "Broadcast" not in plans["met"]


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.connected(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_deduplicate_keeps_one_of_each_group(spark, odd_docs, rows):
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids == {c for d, _, c in brute.simhash(rows) if c is not None} | {None}


def test_columns_with_dots_and_empty_tables(spark, odd_docs):
    """Operators that give rows back keep columns of any name, and give none of none."""
    from corpus_jobs.llm import pii, resemblance

    docs = odd_docs.withColumnRenamed("label", "a.b").withColumnRenamed("kept", "a`c").filter("doc_id < 40")
    docs = docs.drop("a`c")
    bench = spark.createDataFrame([(1, "a text that is in none of these documents at all")], "item_id long, text string")
    for f in (simhash.deduplicate, resemblance.deduplicate, quality.keep_good, line_dedup.drop_repeated, lambda d: decontamination.drop_contaminated(d, bench)):
        out = f(docs)
        assert out.columns == docs.columns and out.count() > 0
        assert f(docs.limit(0)).count() == 0
    assert pii.find(docs.limit(0), pii.train([])).count() == 0


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa
    from corpus_jobs.llm.common import sliced

    b = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(["x" * (10_000 if i % 9 == 0 else 10) for i in range(40)])], names=["i", "t"])
    parts = list(sliced([b], rows=15, size=12_000))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(40))
    assert all(p.num_rows == 1 or p.nbytes <= 12_000 for p in parts) and len(parts) < 20


def test_quality_measures(spark, odd_docs, rows):
    got = as_rows(quality.score(odd_docs), "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed")
    assert got == sorted([(d, *brute.quality(t)) for d, t in rows + NO_ID], key=str)


def test_host_verdicts_by_hand(spark):
    """Documents a little beyond a limit go on a host that always is, and stay on hosts that hardly are; far beyond it they
    go anywhere, and documents that fail nothing stay anywhere."""
    text = lambda i, n, symbols: " ".join([f"word{i}x{j}" for j in range(n - symbols)] + ["$"] * symbols)
    data = [(i, text(i, 30, 0), f"good{i % 20}") for i in range(400)] + [(1000 + i, text(i, 40, 5), "bad") for i in range(60)]
    data += [(2000, text(2000, 40, 5), "good1"), (2001, text(2001, 40, 0), "bad"), (2002, text(2002, 40, 15), "good2")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.score(docs).collect()}
    assert not any(kept[1000 + i] for i in range(60)) and not kept[2002]
    assert kept[2000] and kept[2001] and all(kept[i] for i in range(400))
    assert [kept[d] for d, _, _ in data] == brute.good([(t, h) for _, t, h in data])


def test_quality_is_brute_force_and_changes_rows(spark):
    """Verdicts on the small tables: they reject what the base rules keep, and good documents stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left")
    got = {r["doc_id"]: r for r in quality.score(docs).collect()}
    rows = docs.select("doc_id", "text", "source", "quality").collect()
    assert [got[r["doc_id"]]["kept"] for r in rows] == brute.good([(r["text"], r["source"]) for r in rows])
    assert sum(not x["kept"] and not x["base_failed"] for x in got.values()) > 50
    clean = [r["doc_id"] for r in rows if r["quality"] == 1]
    assert sum(got[d]["kept"] for d in clean) >= 0.95 * len(clean)


def test_one_failure_does_not_condemn_a_small_host(spark):
    bad = lambda i: " ".join([f"v{i}w{j}" for j in range(35)] + ["$"] * 5)
    data = [(i, bad(i), f"single{i}") for i in range(30)] + [(100 + i, " ".join(f"w{i}x{j}" for j in range(20)), f"host{i}") for i in range(200)] + [(1000 + i, bad(i), "bad") for i in range(80)]
    kept = {r["doc_id"]: r["kept"] for r in quality.score(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[1000 + i] for i in range(80))


def test_keep_good_is_score(spark, odd_docs):
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert as_rows(kept, "doc_id") == as_rows(quality.score(odd_docs).filter("kept"), "doc_id")


def test_line_dedup_is_brute_force(spark, odd_docs, rows):
    assert as_rows(line_dedup.digest(odd_docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(rows + NO_ID)


def test_line_dedup_keeps_columns(spark, odd_docs):
    out = line_dedup.drop_repeated(odd_docs)
    assert out.dtypes == odd_docs.dtypes and out.count() == odd_docs.count()


def test_minimal_perfect_hash():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    sizes, bits = line_dedup.build(keys)
    assert sorted(line_dedup.slots(keys, sizes, bits).tolist()) == list(range(len(keys)))
    assert line_dedup.slots(np.array([3], dtype=np.uint64), *line_dedup.build(keys[:0])).tolist() == [-1]


def test_index_holds_every_line_and_its_count_decides(spark):
    np = line_dedup.np
    import pandas as pd

    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"shard": 5, "h1": rng.integers(-(2**62), 2**62, n), "h2": rng.integers(-(2**62), 2**62, n), "owner": rng.integers(0, 99, n), "several": rng.random(n) < 0.3})
    index = line_dedup._index_shard(pdf)
    probes = pdf[["h1", "h2"]].assign(doc_id=100, version=1, line=range(n))
    assert line_dedup._probe(index, probes)["line"].tolist() == np.flatnonzero(pdf["several"]).tolist()
    assert not len(line_dedup._probe(index, probes.assign(doc_id=pdf["owner"])))
    with pytest.raises(RuntimeError):
        line_dedup._probe(index, probes.assign(h2=probes["h2"] + 2**40))


def test_hot_line_is_dealt_over_copies(spark):
    data = [(i, f"a very common line\nline of its own {i}\npair line number {i // 2}") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert as_rows(line_dedup.digest(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(data)


def edited(rng, item, n):
    s = list(item)
    for _ in range(n):
        i = rng.randrange(len(s))
        kind = rng.randrange(3)
        if kind == 0:
            s[i] = "q"
        elif kind == 1:
            del s[i]
        else:
            s.insert(i, "z")
    return "".join(s)


def test_decontamination_is_brute_force(spark):
    rng = random.Random(3)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(8).collect()] + [(100, None), (101, ""), (102, "short"), (103, "Exactly  this sentence\nstands here, once.")]
    texts = []
    for k, item in bench[:8]:
        m = len(item)
        for n in (0, 2, m // 20, m // 10 - 1, m // 7):
            texts.append("some words before " + edited(rng, item, n) + " and words after")
    texts += [None, "", "EXACTLY this  sentence stands here, once.", bench[0][1][5:], "nothing of it here " * 20, "a Short, text", "shorter and short-", "(short)", "unshort"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = as_rows(decontamination.matches(docs, spark.createDataFrame(bench, "item_id long, text string")), "doc_id", "item_id", "distance")
    want = []
    for d, t in enumerate(texts):
        for k, item in bench:
            n, s = decontamination.normal(item), decontamination.normal(t)
            if len(n) >= 25 and (e := brute.edit_distance_within(n, s)) <= int(len(n) * 0.1):
                want.append((d, k, e))
            elif 0 < len(n) < 25 and re.search(rf"(?<!\w){re.escape(n)}(?!\w)", s):
                want.append((d, k, 0))
    assert {x[:2] for x in got} == {x[:2] for x in want}
    assert dict((x[:2], x[2]) for x in got) == dict((x[:2], x[2]) for x in want)
    left = decontamination.drop_contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_decontamination_in_blocks_and_odd_rows(spark, monkeypatch):
    """Many blocks give what one gives; null ids on either side, repeated rows and clashing columns."""
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(8).collect()] + [(None, "An item that has no id at all, but a text"), (7000, None), (7001, " ")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(1, "before " + bench[0][1] + " after", "x", 1), (None, bench[1][1], "y", 2), (2, "clean words only", None, 3), (2, "clean words only", None, 3), (3, "so: an item that has no id at all, but a text!", "z", 4), (1, "before " + bench[0][1] + " after", "x", 1), (4, None, "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, text_hash int")
    one = as_rows(decontamination.matches(docs, items), "doc_id", "item_id", "distance", "end")
    left = as_rows(decontamination.drop_contaminated(docs, items), *docs.columns)
    assert [r[:3] for r in one] == sorted([(1, bench[0][0], 0), (1, bench[0][0], 0), (None, bench[1][0], 0), (3, None, 0)], key=str)
    assert left == sorted([tuple(r) for r in rows if r[0] in (2, 4)], key=str)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (*decontamination.blocks.__defaults__[:2], 300))
    assert len(list(decontamination.blocks(items))) > 3
    assert as_rows(decontamination.matches(docs, items), "doc_id", "item_id", "distance", "end") == one
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and as_rows(kept, *docs.columns) == left


def test_myers_is_sellers():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontamination.best_end(p, t)[0] == brute.edit_distance_within(p, t)


@pytest.mark.parametrize("block", [3000, 4_000_000])
def test_packing(spark, odd_docs, rows, block):
    rows = rows + NO_ID
    found = packing.pack(odd_docs, block_tokens=block).collect()
    ids = brute.token_ids([t for _, t in rows], 1)
    by_doc = {}
    for (d, _), x in zip(rows, ids):
        by_doc.setdefault(d, []).append(x)
    pieces, sequences = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, texts in by_doc.items():
        assert sum(p["length"] for p in pieces[d]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces[d], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(texts[0])
                assert p["ids_crc32"] == brute.crc(texts[0][at : at + p["length"]])
                at += p["length"]
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_combinations_are_all():
    hist = packing.np.zeros(25, dtype=packing.np.int64)
    hist[[1, 3, 4, 8, 10, 12, 20, 21]] = 1
    want = {(a, b, 24 - a - b) for a in range(25) for b in range(a, 25) if 24 - a - b >= b and a and hist[a] and hist[b] and hist[24 - a - b]}
    want |= {(a, 24 - a, 0) for a in range(1, 13) if hist[a] and hist[24 - a]}
    assert {tuple(r) for r in packing.combinations(hist, 24).tolist()} == want


def test_counts_are_least_squares():
    """The solver's residual is that of an exact non-negative solution, by projected gradient over many steps."""
    np = packing.np
    rng = np.random.default_rng(3)
    hist = np.bincount(rng.integers(1, 64, 400), minlength=65)
    combos = packing.combinations(hist, 64)
    a = np.zeros((65, len(combos)))
    for j, c in enumerate(combos):
        for v in c[c > 0]:
            a[v, j] += 1
    h = hist.astype(float)
    h[0] = 0
    x, step = np.zeros(len(combos)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20000):
        x = np.maximum(0, x - step * (a.T @ (a @ x - h)))
    best, got = (np.linalg.norm(a @ v - h) for v in (x, packing.solve(hist, combos)))
    assert got <= best + 0.02 * np.linalg.norm(h), (got, best)
    times = sum(n for _, n in packing.repeats(hist, combos))
    used = np.zeros(65, dtype=int)
    for lengths, n in packing.repeats(hist, combos):
        assert sum(lengths) == 64
        np.add.at(used, list(lengths), n)
    assert (used <= hist).all() and times >= 0.8 * x.sum()


def test_most_windows_are_planned(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1))
    planned, all_ = got.selectExpr("sum(if(planned, length, 0))", "sum(length)").first()
    assert planned > 0.3 * all_, (planned, all_)


def rows_read(df):
    """(rows, rows that the file scan gave) of a query without a shuffle."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return rows, leaf.metrics().get("numOutputRows").get().value()


def test_token_files_are_pruned(spark):
    """A point read takes the row groups that can hold the document, by their least and greatest id and Bloom filters."""
    docs = spark.range(0, 40000, 2).selectExpr("id AS doc_id", "concat('document number ', id) AS text")
    path = new_path(spark, "test-pruned")
    token_files.write(docs, path, partitions=1)
    rows, read = rows_read(token_files.read(spark, path).filter("doc_id = 20000").select("doc_id", "n_tokens"))
    assert len(rows) == 1 and read <= 1000
    rows, read = rows_read(token_files.read(spark, path).filter("doc_id = 20001").select("doc_id", "n_tokens"))
    assert len(rows) == 0 and read == 0  # within a row group's range: only its Bloom filter tells


def test_files_are_in_the_order_of_their_numbers(spark, monkeypatch):
    names = [("part-99999-x.orc", 5), ("part-100000-x.orc", 7), ("part-00002-x.orc", 1)]
    monkeypatch.setattr(token_files, "read", lambda s, p: s.createDataFrame(names, "file string, n_tokens long"))
    got = {r["file"]: r["base"] for r in token_files.file_bases(spark, "").collect()}
    assert got == {"part-00002-x.orc": 0, "part-99999-x.orc": 1, "part-100000-x.orc": 6}


def test_token_files(spark, odd_docs, rows):
    path = new_path(spark, "test-ids")
    token_files.write(odd_docs, path, partitions=4)
    got = token_files.digest(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([d for d, _ in rows + NO_ID], key=lambda d: -1 if d is None else d)
    want, at = {}, 0
    for (d, _), ids in zip(rows + NO_ID, brute.token_ids([t for _, t in rows + NO_ID], 2)):
        want.setdefault(d, []).append((len(ids), brute.crc(ids)))
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]
    in_file = token_files.read(spark, path)
    assert in_file.filter("doc_id = 9003").select("ids").first()["ids"][-1] == 2


def test_token_counts(spark, odd_docs, rows):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = as_rows(token_counts.token_counts(odd_docs), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in rows + NO_ID]
    assert got == sorted(want, key=str)


def test_overlap_resynchronisation(rows):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(2)
    texts = [t for _, t in rows if t and len(t) > 900]
    texts += ["".join(rng.choice("ab c漢é\U0001f600\n") for _ in range(3000)), "ab" * 2000, "1" * 3000, " " * 2000, "x" + " " * 700 + "y" * 900, "▁a " * 500]
    for chunk, overlap in ((500, 40), (64, 8), (2000, 100)):
        c = token_counts.Counter(path, chunk, overlap)
        assert c.plain
        for t in texts:
            assert c.huge(t[:20000]) == len(c.sp.encode(t[:20000]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert simhash.components(docs).count() == 0
    assert simhash.deduplicate(docs).count() == 0
    assert quality.score(docs).count() == 0
    assert line_dedup.digest(docs).count() == 0
    assert decontamination.matches(docs, bench).count() == 0
    assert packing.pack(docs).count() == 0
    assert token_counts.token_counts(docs).count() == 0
    path = new_path(spark, "none")
    token_files.write(docs, path)
    assert token_files.digest(spark, path).count() == 0
