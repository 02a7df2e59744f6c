"""Ranked search, mixing and phrases against plain versions, on the small documents and odd ones."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus_jobs.llm import mixing, phrases, ranked_search
from pyspark.sql import functions as F

from . import brute
from .conftest import as_rows

ITEMS = [(1, "the river and the water of a town"), (2, "WORD word Naïve 漢字"), (3, "same line of text here"), (4, ""), (5, None), (6, "x y z"), (6, "one"), (7, "zzzz-not-there!"), (8, "endoftext s don")]


def found_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", brute.ascii_lower(text or ""))


def ranked(rows, items, k):
    """(item, rank, doc_id, score) with every document scored."""
    docs = [(d, Counter(found_terms(t))) for d, t in rows if found_terms(t)]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        asked, scores = set(found_terms(text)), []
        for d, c in docs:
            m, score = 100 - 50 + (50 * sum(c.values()) * n) // length, 0
            for t in asked & set(c):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,run", [(50, ranked_search.RUN), (3, 20)])
def test_ranked_search_is_brute_force(spark, odd_docs, rows, monkeypatch, k, run):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "RUN", run)
    docs = odd_docs.withColumnRenamed("label", "a.b")
    found = ranked_search.search(docs.repartition(3), items, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    no_id = [(None, "a text without an id\nsame line of text here")] * 2
    assert as_rows(found, "*") == ranked(rows + no_id, ITEMS, k)


def test_accumulators_are_limited_and_exact():
    rng = np.random.default_rng(3)
    n, k = 4000, 10
    for trial in range(30):
        sizes = sorted(int(x) for x in rng.integers(1, 1 + 3 ** (trial % 8), 12))
        lists = [(rng.choice(n, min(s, n), replace=False), rng.integers(0, 50 if trial % 2 else 2 ** (30 - i), min(s, n))) for i, s in enumerate(sizes)]
        total = np.zeros(n, np.int64)
        for r, add in lists:
            total[r] += add
        got, scores, _ = ranked_search.accumulate(lists, n, k)
        assert np.array_equal(scores, total[got])  # survivors are exact
        ids = np.arange(n)
        assert [x.tolist() for x in ranked_search._best(got[scores > 0], scores[scores > 0], k)] == [x.tolist() for x in ranked_search._best(ids[total > 0], total[total > 0], k)]
    rare, common = (np.arange(20), np.full(20, 10**9)), (np.arange(n), np.full(n, 5))
    assert ranked_search.accumulate([rare, common], n, k)[2] == 20  # the common term makes no accumulators
    assert ranked_search.accumulate([rare, common], n, 30)[2] == n  # but for more than the rare one has, it does
    assert ranked_search.accumulate([rare, common], n, 30, least=6)[2] == 20  # unless earlier rows were better


def test_ranked_search_of_nothing(spark):
    empty, item = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    assert ranked_search.search(empty, item).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), item.limit(0)).collect() == []
    assert ranked_search.search(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), item).collect() == []


def water(sizes, weights, percent, most):
    """Shares by weight, cut and shared again until none is above."""
    left, out, rest = dict(zip(range(len(sizes)), weights)), {}, percent * sum(sizes) / 100
    while True:
        share = {i: w * rest / sum(left.values()) for i, w in left.items()}
        over = [i for i in left if share[i] > most * sizes[i]]
        if not over:
            return [out.get(i, share.get(i)) for i in range(len(sizes))]
        for i in over:
            out[i] = most * sizes[i]
            rest -= out[i]
            del left[i]
        if not left:
            return [out[i] for i in range(len(sizes))]


def test_targets_fill_up_by_weight(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 60):
        sizes = [rng.choice([0, 1, 5, 100, 1000, 50000]) for _ in range(n)]
        names = sorted({f"{rng.choice('aZé漢')}{i}" for i in range(n - 1)}) + [None]
        table = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(3)
        for percent in (150, 250):
            got = {r["source"]: r["target"] for r in mixing.targets(table, percent=percent).collect()}
            want = water(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)], percent, 2)
            assert all(abs(got[x] - y) <= 1e-6 * max(1, y) for x, y in zip(names, want))


def test_mix_is_brute_force(spark, odd_docs, rows):
    docs = odd_docs.withColumnRenamed("label", "a.b").withColumnRenamed("kept", "size")
    plan = mixing.planned(docs, "mix").cache()
    assert plan.columns == [*docs.columns, "mix"] and plan.count() == docs.count()
    by_source = Counter()
    for r in plan.collect():
        assert r["mix"]["size"] == len(brute.WORD.findall(r["text"] or ""))
        by_source[r["source"]] += r["mix"]["size"]
    names = sorted((s for s in by_source if s is not None)) + [None]
    goal = dict(zip(names, water([by_source[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))], 150, 2)))
    for r in plan.collect():
        m = r["mix"]
        assert m["source_size"] == by_source[r["source"]] and abs(m["target"] - goal[r["source"]]) < 1e-6
        import hashlib

        u = int(hashlib.md5(f"mix:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        rate = m["target"] / m["source_size"]
        assert m["copies"] == math.floor(rate) + (u < rate - math.floor(rate)) and m["copies"] <= 2
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    want = Counter((r["doc_id"], r["n_chars"]) for r in plan.collect() for _ in range(r["mix"]["copies"]))
    assert Counter((r["doc_id"], r["n_chars"]) for r in mix.select("doc_id", "n_chars").collect()) == want


def test_mix_comes_near_its_targets_and_agrees(spark):
    rng = random.Random(2)
    data = [(i, "w " * rng.randrange(1, 60), f"s{min(i % 9, 3)}") for i in range(6000)]  # one source holds two thirds
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    again = [mixing.planned(d, "m").select("doc_id", "m.*", "source").collect() for d in (docs, docs.repartition(7))]
    assert sorted(again[0]) == sorted(again[1])
    taken, goal = Counter(), {}
    for r in again[0]:
        taken[r["source"]] += r["size"] * r["copies"]
        goal[r["source"]] = r["target"]
    assert all(abs(taken[s] - goal[s]) < 0.05 * goal[s] for s in goal)


def test_mix_of_nothing(spark):
    kind = "doc_id long, text string, source string"
    empty = spark.createDataFrame([], kind)
    assert mixing.mixed(empty).collect() == [] and mixing.planned(empty, "m").collect() == []
    silent = spark.createDataFrame([(1, None, "a"), (2, " \n", None)], kind)
    assert [(r["m"]["size"], r["m"]["source_size"], r["m"]["target"], r["m"]["copies"]) for r in mixing.planned(silent, "m").collect()] == [(0, 0, 0.0, 0)] * 2


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", brute.ascii_lower(text or ""))]


def mined(rows, least, k, contained=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    often = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    best = {}
    for (lang, w), a in often.items():
        score, cut = min((1000 * a * n[lang] // (f[lang, w[:c]] * f[lang, w[c:]]), c) for c in range(1, len(w)))
        best.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), w, f[lang, w[:cut]], f[lang, w[cut:]]))
    inside = {}
    for (lang, w), a in often.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inside[lang, w[i : i + m]] = max(a, inside.get((lang, w[i : i + m]), 0))
    out = []
    for lang, found in best.items():
        kept = sorted(x for x in found if 100 * inside.get((lang, x[3]), 0) < contained * -x[1])
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, _, left, right) in enumerate(kept[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("least,k,contained", [(3, 2000, 100), (20, 5, 60)])
def test_phrases_are_brute_force(spark, odd_docs, rows, least, k, contained):
    docs = odd_docs.withColumnRenamed("label", "a.b").withColumnRenamed("n_chars", "phrase").withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang")))
    want = mined([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], least, k, contained)
    got = phrases.collocations(docs, k=k, least=least, contained=contained)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert want and as_rows(got, "*") == want


SEED, BASE = next(phrases.polynomials())


def run_of(tokens, own=None, lang=7):
    return phrases._Run(tokens, len(tokens) if own is None else own, lang, SEED, BASE)


def everything():
    return [np.full(1 << 13, 255, np.uint8)] * 4


def test_phrase_runs_hold_every_ngram_once():
    """Long texts cut into short runs give the n-grams of the whole text."""
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "c", "déf", " ", "  ", "\t", ".", "\n"]) for _ in range(rng.randrange(120)))
        whole = Counter(tuple(w[i : i + 3]) for w in pieces(text) for i in range(len(w) - 2))
        got = Counter()
        for tokens, own in phrases.runs([text], size=rng.randrange(5, 60), longest=3):
            got.update(tuple(x.decode() for x in tokens[i : i + 3]) for i in run_of(tokens, own).likely(3, everything()).tolist())
        assert got == whole


def test_fingerprints_follow_the_words_alone():
    a, b, c = run_of(b"x y z w".split()), run_of(b"q q q x y z".split()), run_of(b"x y z".split(), lang=8)
    at = np.array([0])
    assert a.fingerprints(3, at) == b.fingerprints(3, np.array([3])) != c.fingerprints(3, at)
    assert a.fingerprints(2, at) != a.fingerprints(2, np.array([1]))


def test_an_ngram_needs_all_its_parts():
    """On the map of the longest parts by chance, with a word that is on none, an n-gram is left out."""
    run = run_of(b"a b c".split())
    words, pairs = np.zeros(1 << 13, np.uint8), np.full(1 << 13, 255, np.uint8)
    for i in (1, 2):
        k = int(run.fingerprints(1, np.array([i]))[0]) >> 48
        words[k >> 3] |= 1 << (k & 7)
    assert run.likely(2, [words, pairs]).tolist() == [1] and run.likely(3, [words, pairs]).tolist() == []


@pytest.mark.parametrize("weak", [True, False])
def test_shared_fingerprints_are_seen_and_mended(spark, monkeypatch, weak):
    """A base of 1 gives a b and b a one fingerprint; that polynomial is not used then."""
    docs = spark.createDataFrame([("en", "a b a b a b a b"), ("en", "b a. b a"), ("fr", "a b a b a b a b")] * 3, "lang string, text string")
    tried, plain = [], phrases.polynomials

    def polynomials():
        for seed, base in plain():
            tried.append(seed)
            yield seed, 1 if seed == 0 and weak else base

    monkeypatch.setattr(phrases, "polynomials", polynomials)
    assert as_rows(phrases.collocations(docs, least=3), "*") == mined([(r["lang"], r["text"]) for r in docs.collect()], 3, 2000)
    assert tried == ([0, 1] if weak else [0])


def test_frequent_map_misses_none(spark):
    rng = random.Random(8)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(4000)]
    bits = phrases.frequent_map(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert phrases.on_map(bits, np.array(keys).view(np.uint64)).all()
    others = np.array([rng.getrandbits(64) for _ in range(4000)], np.uint64)
    assert phrases.on_map(bits, others).sum() < 200


def test_tasks_pass_on_what_they_hold(spark, odd_docs, monkeypatch):
    """Sums that a task passes on early add up to the same."""
    import pyarrow as pa

    texts = [r["text"] for r in odd_docs.select("text").collect() if r["text"]]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    maps = type("Sent", (), {"value": everything()})
    monkeypatch.setattr(phrases.runs, "__defaults__", (3000, 5))

    def summed(batches, columns):
        out, rows = Counter(), 0
        for b in batches:
            rows += b.num_rows
            for r in zip(*(b.column(c).to_pylist() for c in columns)):
                out[r[:-1]] += r[-1]
        return out, rows

    few, many = (summed(phrases._summed([batch], 2, maps, SEED, BASE, held), ("key", "last", "count")) for held in (50, 10**7))
    assert few[0] == many[0] and few[1] > many[1]
    few, many = (summed(phrases._counted([batch], SEED, held), ("key", "word", "count")) for held in (50, 10**7))
    assert few[0] == many[0] and few[1] > many[1]


def test_scores_pass_64_bits(spark):
    a, n, le, r = 3 * 10**12, 9 * 10**13, 4 * 10**12, 5 * 10**12 + 1
    got = spark.sql(f"SELECT {phrases._exact('a', 'n', 'l', 'r')} AS x FROM VALUES ({a}L, {n}L, {le}L, {r}L) AS t(a, n, l, r)").first()["x"]
    assert got == 1000 * a * n // (le * r)


def test_phrases_of_nothing(spark):
    kind = "doc_id long, text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], kind)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "a b c", "en")], kind)).collect() == []
