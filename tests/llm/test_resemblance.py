"""Near-duplicates by five-word shingles against all pairs."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from corpus_jobs.llm import resemblance, simhash

from . import brute


def shingles(text):
    words = brute.WORD.findall(brute.ascii_lower(text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def all_pairs(rows):
    """The least id of each document's component over pairs with similarity 0.8 or more."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def texts():
    """Texts and copies with up to four changed words: two changed words of 100 are 86 of 106 shingles, three 81 of 111."""
    rng, rows = random.Random(3), []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        for n in range(5):
            changed = list(words)
            for j in range(n):
                changed[10 + 20 * j] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    return rows + [(900, ""), (901, " \n"), (902, None), (903, "one"), (904, "One"), (905, rows[0][1]), (905, rows[7][1])]


@pytest.mark.parametrize("crowd,held", [(resemblance.CROWD, resemblance.HELD), (resemblance.CROWD, 2), (3, 4)])
def test_components_are_all_pairs(spark, texts, monkeypatch, crowd, held):
    """Also with few members held at once, and with longer bands for all that hold several groups."""
    monkeypatch.setattr(resemblance, "HELD", held)
    rng = random.Random(7)
    loose = [f"v{i}" for i in range(60)]  # a group whose members are alike, but most of them not alike enough
    family = [(2000 + i, " ".join(f"y{rng.randrange(10**6)}" if j in rng.sample(range(60), 2) else w for j, w in enumerate(loose))) for i in range(40)]
    rows = texts + family
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in resemblance.components(docs, crowd=crowd).collect()) == all_pairs(rows)


def test_work_is_linear_in_a_group(spark, monkeypatch):
    """Rows written for one group of near copies of two sizes."""
    written = []

    def counting(df, name):
        out = materialize(df, name)
        written.append(out.count())
        return out

    materialize = resemblance.materialize
    monkeypatch.setattr(resemblance, "materialize", counting)

    def made(n):
        rng, rows = random.Random(n), []
        for i in range(n):
            words = [f"w{k}" for k in range(80)]
            for j in rng.sample(range(80), rng.randrange(1, 4)):
                words[j] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(words)))
        written.clear()
        resemblance.components(spark.createDataFrame(rows, "doc_id long, text string")).count()
        return sum(written) / n

    assert made(800) <= 1.5 * made(200)


def loose(n, start=0):
    """A group whose members are alike, but only some of them alike enough."""
    rng, rows = random.Random(n), []
    for i in range(n):
        words = [f"w{k}" for k in range(120)]
        for j in rng.sample(range(120), rng.choice([1, 4, 6])):
            words[j] = f"x{rng.randrange(10**6)}"
        rows.append((start + i, " ".join(words)))
    return rows


def test_nodes_that_meet_have_few_rows(spark, monkeypatch):
    """However many values the members of a group meet under, about as many pairs as members are written."""
    written, materialize = {}, resemblance.materialize

    def counting(df, name):
        out = materialize(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(resemblance, "materialize", counting)
    for n in (200, 600):
        written.clear()
        rows = loose(n)
        found = resemblance.components(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(tuple(r) for r in found.collect()) == all_pairs(rows)
        assert 0.9 * n <= written["met"] <= 4 * n and written["mixed"] <= n


@pytest.mark.parametrize("held,shingles,block,whole", [(7, 10**6, 5, 10), (500, 900, 1000, 10), (500, 10**6, 1000, 0)])
def test_clusters_in_parts_are_all_pairs(spark, texts, monkeypatch, held, shingles, block, whole):
    """Clusters dealt into parts and blocks, parts by shingles, and no cluster as a whole."""
    for name, value in zip(("HELD", "HELD_SHINGLES", "BLOCK", "WHOLE"), (held, shingles, block, whole)):
        monkeypatch.setattr(resemblance, name, value)
    rows = texts + loose(90, 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in resemblance.components(docs).collect()) == all_pairs(rows)


def test_nodes_of_one_fingerprint_are_compared(spark, texts, monkeypatch):
    """Different sets may have equal fingerprints."""
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    exact = resemblance.fingerprint
    monkeypatch.setattr(resemblance, "fingerprint", lambda found, *how: ([7, 7] if len(found) > 3 else [0, 0], exact(found, *how)[1]))
    assert sorted(tuple(r) for r in resemblance.components(docs).collect()) == all_pairs(texts)


def test_shortened_pairs_connect_the_same():
    rng = np.random.default_rng(6)
    pairs = np.unique(rng.integers(40, size=(60, 4)) // [1, 40, 1, 40], axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], names=[*resemblance.PRINTS, *resemblance.CENTRE])
    found = np.concatenate([np.stack([c.to_numpy() for c in b.columns], 1) for b in resemblance.read_centres([batch])])
    assert not (found[:, :2] == found[:, 2:]).all(1).any()
    assert (resemblance.labelled(40, pairs[:, 0], pairs[:, 2]) == resemblance.labelled(40, found[:, 0], found[:, 2])).all()


def test_stage_finds_pairs_that_fingerprints_miss(spark, texts):
    docs = spark.createDataFrame(texts[:200], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    left = {r["doc_id"] for r in stage(spark, docs, "").collect()}
    assert left == {d for d, c in all_pairs(texts[:200]) if d == c}
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} - left


def test_pairs_at_the_limit_meet(spark, monkeypatch):
    """Pairs at exactly 0.8 meet in the multi-index table and are linked, few and many shingles."""
    rng, rows = random.Random(5), []
    for i, n in enumerate([5] * 20 + [15] * 20 + [40] * 20 + [250] * 60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(n + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: len(words) - n // 5]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(len(a & b) * 5 == len(a | b) * 4 for a, b in ((shingles(x), shingles(y)) for (_, x), (_, y) in zip(rows[::2], rows[1::2])))
    nodes = docs.select("doc_id", resemblance.prints_of(docs["text"], resemblance.BITS).alias("p")).select("doc_id", "p.*")
    for wide in (resemblance.WIDE, 0):
        monkeypatch.setattr(resemblance, "WIDE", wide)
        met = {}
        for r in resemblance.families(resemblance.table_of(nodes), nodes).join(nodes.select("node", "doc_id"), "node").collect():
            met.setdefault(r["key"], set()).add(r["doc_id"])
        assert all(any({2 * i, 2 * i + 1} <= m for m in met.values()) for i in range(len(rows) // 2))
    assert sorted(tuple(r) for r in resemblance.components(docs).collect()) == sorted((d, d // 2 * 2) for d, _ in rows)


def test_table_holds_the_ball_of_doubtful_bits(spark):
    found = resemblance.shingles(" ".join(f"w{i}" for i in range(100)))
    compared, segments = resemblance.fingerprint(found)
    nodes = spark.createDataFrame([(*compared, segments)], "f0 long, f1 long, segments array<long>")
    expected = set()
    for i, x in enumerate(segments):
        value, a, b = x & 0xFFFFFFFF, 1 << (x >> 32 & 31), 1 << (x >> 37 & 31)
        expected |= {(i << 32 | v, *compared) for v in (value, value ^ a, value ^ b, value ^ a ^ b)}
    rows = [tuple(r) for r in resemblance.table_of(nodes).collect()]
    assert len(rows) == len(expected) == 4 * resemblance.SEGMENTS and set(rows) == expected


def test_families_are_what_near_fingerprints_connect():
    rng = np.random.default_rng(4)
    key = np.sort(rng.integers(12, size=300))
    prints = [rng.integers(1 << 63, size=300, dtype=np.uint64) & np.uint64(0x3FFFFFFFFFFFF) for _ in range(2)]
    near = [[sum(int(f[i] ^ f[j]).bit_count() for f in prints) <= resemblance.RADIUS and key[i] == key[j] for j in range(300)] for i in range(300)]
    labels = list(range(300))
    for _ in range(300):
        new = [min(labels[j] for j in range(300) if near[i][j]) for i in range(300)]
        if new == labels:
            break
        labels = new
    assert len(set(key)) < len(set(labels)) < 300
    for few in (2, 20, 256):
        assert resemblance.family_of(key, prints, few).tolist() == labels
