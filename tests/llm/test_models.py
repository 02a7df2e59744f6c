import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_jobs.llm import ctw, langid, pii
from corpus_jobs.llm.common import documents

from . import brute
from .conftest import SMALL, as_rows

NO_ID = [(None, "a text without an id\nsame line of text here")] * 2

# --- personal data ----------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

PERSONAL = [
    "mail a.b%c@x-y.co.uk, or a@b@c.de and @x.y q@z .. a@b..c u@v.w@x.y",
    "10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 378282246310005 1234 5678",
    "call +1 (602) 555-0417 or +49 30 123 45 67 8, +1 2, + 12345678901 +123456789012345678",
    "Phones (602) 555-0418 and 602-555-0419.\n+1 (602) 555-0417\n",
    "x" * 3000 + "@" * 300 + "1" * 3000 + "." * 50,
]


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(pii.digits(m[0])) <= 15]
    return sorted(out)


def test_patterns_are_the_plain_ones(rows):
    rng = random.Random(4)
    texts = [t for _, t in rows if t and len(t) < 4000] + PERSONAL
    texts += ["".join(rng.choice("1234a@.+- ()\n") for _ in range(300)) for _ in range(300)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_learns_held_out_shapes(spark):
    """Trained on pattern labels of some of the documents, the field finds most of the words of the others' spans."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, test = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")
    field = pii.train(pii.labelled_table(train, most=200))
    hit = all_ = wrong = 0
    for r in test.select("text").collect():
        for words, labels in pii.labelled(r["text"]):
            got = field.decode([field.emissions(words)])[0]
            for g, w in zip(got, labels):
                hit, all_, wrong = hit + (w > 0 and g == w), all_ + (w > 0), wrong + (w == 0 and g > 0)
    assert all_ > 5 and hit >= 0.9 * all_ and wrong <= 0.1 * all_


def test_field_adds_what_patterns_miss(spark):
    """On documents that it was not trained on, spans written otherwise are found, and little else is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    field = pii.train(pii.with_spellings(pii.labelled_table(docs.filter("doc_id % 3 <> 0"))))
    hit, all_, wrong, words_seen = Counter(), Counter(), 0, 0
    for i, r in enumerate(docs.filter("doc_id % 3 = 0").select("text").orderBy("doc_id").collect()):
        for words, labels in pii.labelled(r["text"]):
            for way in range(7 if any(labels) else 1):
                said, kinds = pii.respelled(words, labels, 100 + i + way)
                text = " ".join(said)
                base = pii.base_spans(text)
                for stretch in pii.stretches(text):
                    path = field.decode([field.emissions([w for _, _, w in stretch])])[0]
                    found = list(pii.added_spans(stretch, path, text, base)) + base
                    at, end = 0, 0
                    for w, k in zip(said, kinds):
                        at, end = text.index(w, end), text.index(w, end) + len(w)
                        if k and pii.HINT.search(w) and stretch[0][0] <= at < stretch[-1][1]:
                            all_[k] += 1
                            hit[k] += any(s < end and at < e and j == k - 1 for s, j, e in found)
                    if not any(labels):
                        wrong += len(found) - len(base)
            words_seen += len(words)
    assert len(all_) == 4 and all(hit[k] >= 0.9 * n for k, n in all_.items()), (hit, all_)
    assert wrong <= 0.002 * words_seen, (wrong, words_seen)


def test_spellings_are_outside_the_patterns():
    spans = {"email": "joe.b@mail.example.org", "ip": "10.0.0.1", "card": "4111 1111 1111 1111", "phone": "+1 (602) 555-0417"}
    for kind, s in spans.items():
        for way in range(7):
            other = pii.spelled(kind, s, way)
            assert pii.acceptable(kind, other), other
            assert not any(pii.KINDS[k] == kind and (a, b) == (0, len(other)) for a, k, b in pii.base_spans(other))


#: Written by hand, not by pii.spelled.
BY_HAND = [
    ("email", "write to anna.meier(@)posteo.example or ring", "anna.meier(@)posteo.example"), ("email", "mail j_doe@intranet for access", "j_doe@intranet"),
    ("ip", "the host 192[.]168[.]2[.]77 answers", "192[.]168[.]2[.]77"), ("card", "card 5500.0000.0000.0004 was charged", "5500.0000.0000.0004"),
    ("card", "number 4012/8888/8888/1881 on file", "4012/8888/8888/1881"), ("phone", "call (415) 555-0132 after noon", "(415) 555-0132"), ("phone", "reach us at 212-555-0187 today", "212-555-0187"),
]


def test_field_finds_spellings_written_by_hand(spark):
    """Most of them, and nothing in lines of plain numbers, dates and prices."""
    field = pii.train(pii.with_spellings(pii.labelled_table(documents(spark, "/root/testdata/sf0.01"))))

    def found(text):
        base = pii.base_spans(text)
        return [(pii.KINDS[k], text[a:b]) for words in pii.stretches(text) for a, k, b in pii.added_spans(words, field.decode([field.emissions([w for _, _, w in words])])[0], text, base)]

    hit = sum((kind, span) in found(text) for kind, text, span in BY_HAND)
    assert hit >= 5, [found(text) for _, text, _ in BY_HAND]
    for text in ("in 1984 there were 12 of 340 left", "it cost 12.50 or 1,300.00 on 2024-03-05", "see page 17, section 3.2.1 of 44"):
        assert found(text) == []


def test_shapes_leave_nothing_out():
    assert pii.shape("x" * 70 + "1@host") == "a91@a" and pii.shape("9" * 100) == "9c"
    field = pii.Field({}, np.zeros((0, 5)), np.zeros((5, 5)))
    field.emissions(["a.1" * 1000])
    assert not field.known


def test_labels_are_the_plain_ones():
    rng = random.Random(6)
    for _ in range(200):
        text = " ".join(rng.choice(["a@b.de", "10.0.0.1", "+1 602 555 0417", "4111 1111 1111 1111", "word", "7", "x@y", "\n"]) for _ in range(rng.randrange(30)))
        spans = pii.base_spans(text)
        for words, (said, labels) in zip(pii.stretches(text), pii.labelled(text), strict=True):
            assert said == [w for _, _, w in words]
            assert labels == [next((k + 1 for s, k, e in spans if s < b and a < e), 0) for a, b, _ in words]


def test_a_very_long_line_stays_small():
    """Decoding pads no short stretch to the length of a long one."""
    import time
    import tracemalloc

    rng = np.random.default_rng(1)
    field = pii.train(pii.with_spellings([(["call", "+1", "602", "555", "0417", "now"], [0, 4, 4, 4, 4, 0]), (["in", "1984", "there"], [0, 0, 0])]))
    texts = [" ".join(map(str, rng.integers(0, 99999, 300_000)))] + ["call 602-555-0417 now"] * 511
    began = time.time()
    tracemalloc.start()
    todo = [w for t in texts for w in pii.stretches(t)]
    paths = field.decode([field.emissions([w for _, _, w in words]) for words in todo])
    assert tracemalloc.get_traced_memory()[1] < 500e6 and time.time() - began < 120
    tracemalloc.stop()
    assert [len(p) for p in paths] == [len(w) for w in todo] and len(paths[0]) == 300_000
    assert len({tuple(p) for p in paths[1:]}) == 1


def test_viterbi_is_exhaustive():
    import itertools

    rng = np.random.default_rng(3)
    field = pii.Field({}, np.zeros((0, 5)), rng.normal(size=(5, 5)))
    batch = [rng.normal(size=(n, 5)) for n in (1, 4, 2, 3)]
    for e, path in zip(batch, field.decode(batch)):
        def value(p):
            return sum(e[i, y] for i, y in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))

        assert math.isclose(value(path), max(value(p) for p in itertools.product(range(5), repeat=len(e))))


def test_pii_spans(spark, odd_docs, rows):
    extra = spark.createDataFrame([(20000 + i, t) for i, t in enumerate(PERSONAL)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra)
    field = pii.train(pii.with_spellings(pii.labelled_table(documents(spark, SMALL))))
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.find(docs, field).collect()}
    import hashlib

    for d, t in rows + [(20000 + i, t) for i, t in enumerate(PERSONAL)]:
        base = plain_spans(t or "")
        r = got[d, hashlib.sha256(pii.joined(base).encode()).hexdigest()]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)
        assert len(spans) >= len(base)
    assert pii.find(docs.limit(0), pii.train([])).count() == 0
    assert pii.train(pii.with_spellings(pii.labelled_table(docs.limit(0)))).weights.shape == (1, 5)


# --- context-tree weighting --------------------------------------------------------------------------------------------


def brute_ctw(rows, depth):
    """Scores by walking the trees one decision at a time."""
    nodes = {}

    def bits(byte):
        return [(bit, byte >> (8 - bit), byte >> (7 - bit) & 1) for bit in range(8)]

    def symbols(text):
        data = b"\0" * depth + brute.ascii_lower(text or "").encode() + b"\0"
        return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]

    train = [t for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 10]
    for t in train:
        for context, byte in symbols(t):
            for bit, prefix, one in bits(byte):
                for d in range(depth + 1):
                    nodes.setdefault((bit, prefix, context[depth - d :]), [0, 0])[one] += 1
    children = {}
    for bit, prefix, c in nodes:
        if c:
            children.setdefault((bit, prefix, c[1:]), []).append((bit, prefix, c))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    weighted, stop = {}, {}
    for key in sorted(nodes, key=lambda k: -len(k[2])):
        pe = kt(*nodes[key])
        if len(key[2]) == depth:
            weighted[key], stop[key] = pe, 1.0
        else:
            both = np.logaddexp(pe, sum(weighted[c] for c in children[key]))
            weighted[key], stop[key] = both - math.log(2), math.exp(pe - both)

    def mixed(key, one):
        a, b = nodes[key]
        here = ((b if one else a) + 0.5) / (a + b + 1)
        return here

    out = []
    for d, t in rows:
        total = 0.0
        for context, byte in symbols(t):
            for bit, prefix, one in bits(byte):
                p = None
                for k in range(depth, -1, -1):
                    key = (bit, prefix, context[depth - k :])
                    if key in nodes:
                        p = mixed(key, one) if p is None else stop[key] * mixed(key, one) + (1 - stop[key]) * p
                total += math.log10(0.5 if p is None else p)
        out.append(total)
    return out


def test_ctw_is_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["abra", "Cadabra", "é漢", "x"]) for _ in range(rng.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a\0b\n \n"), (103, "zzz unseen qqq"), (None, "no id"), (105, "abra " * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth in (3, 5):
        got = sorted(ctw.score(docs, depth=depth, block_bytes=500).collect(), key=lambda r: str(r["doc_id"]))
        want = brute_ctw(rows, depth)
        tokens = Counter()
        for d, t in rows:
            if zlib.crc32(str("" if d is None else d).encode()) % 10:
                tokens.update(brute.WORD.findall(brute.ascii_lower(t or "")) + ["\n"])
        n, v = sum(tokens.values()), len(tokens)
        for r, ((d, t), w) in zip(got, sorted(zip(rows, want), key=lambda x: str(x[0][0]))):
            mine = brute.WORD.findall(brute.ascii_lower(t or "")) + ["\n"]
            assert r["doc_id"] == d and r["n_tokens"] == len(mine) and r["train_tokens"] == n
            assert r["held_out"] == (zlib.crc32(str("" if d is None else d).encode()) % 10 == 0)
            assert r["n_known"] == sum(tokens[x] > 0 for x in mine)
            assert math.isclose(r["base_score"], sum(math.log10((tokens[x] + 0.1) / (n + 0.1 * (v + 1))) for x in mine), rel_tol=1e-9)
            assert math.isclose(r["score"], w, rel_tol=1e-9, abs_tol=1e-9)
            assert math.isclose(r["bits_per_byte"], -w / math.log10(2) / (len((t or "").encode()) + 1), rel_tol=1e-9, abs_tol=1e-9)


def test_ctw_beats_its_base_on_held_out_text(spark):
    r = ctw.score(documents(spark, "/root/testdata/sf0.01")).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > r["b"]


def test_ctw_odd(spark, odd_docs, rows):
    got = ctw.score(odd_docs)
    assert got.count() == len(rows) + 2
    assert got.filter("isnan(score) or score >= 0").count() == 0
    assert ctw.score(odd_docs.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "abc") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    r = ctw.score(only).first()
    assert r["train_tokens"] == 0 and math.isclose(r["score"], 32 * math.log10(0.5))


# --- language ---------------------------------------------------------------------------------------------------------


def all_cuts(word, probs):
    """The sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = probs.get(word[:k], langid.UNKNOWN if k == 1 else 0.0)
        if p:
            total += p * all_cuts(word[k:], probs)
    return total


def all_pieces(word, probs, held=(), p=1.0):
    """Yields (pieces, probability) of every segmentation."""
    if not word:
        yield held, p
    for k in range(1, len(word) + 1):
        q = probs.get(word[:k], langid.UNKNOWN if k == 1 else 0.0)
        if q:
            yield from all_pieces(word[k:], probs, (*held, word[:k]), p * q)


def test_forward_sums_all_segmentations():
    pieces = langid.pieces_of(langid.default_path(langid.VOCABULARY))
    rng = np.random.default_rng(1)
    p = rng.random((pieces.size + 1, 2)) / pieces.size
    p[-1] = 0
    longest = max((w for w in pieces.words if w[0] == langid.SPACE and w[1:].isalpha()), key=len)
    words = ["▁the", "▁nation", "▁über", "▁漢字x", "▁q", "▁entscheid", longest]
    assert len(longest) > 12
    got = langid.log_scores(pieces, p, words)
    for c in range(2):
        probs = dict(zip(pieces.words, p[:-1, c]))
        for w, g in zip(words, got[:, c]):
            assert math.isclose(g, math.log(all_cuts(w, probs)), rel_tol=1e-9)


def test_learning_is_brute_force(spark):
    """The learned probabilities of a few documents, and what they make of texts, against all segmentations."""
    docs = [(1, "The cat, the HAT", "en"), (2, "der Hund 漢", "de"), (3, "the dog", "de"), (4, None, "en"), (5, "cat", None)]
    pieces = langid.pieces_of(langid.default_path(langid.VOCABULARY))
    uniform = dict.fromkeys(pieces.words, 1 / pieces.size)
    counts = {"de": Counter(), "en": Counter()}
    for _, text, lang in docs:
        for token in (text or "").lower().split() if lang else ():
            for unit in langid.units(token):
                ways = list(all_pieces(unit, uniform))
                whole = sum(p for _, p in ways)
                for held, p in ways:
                    for piece in held:
                        if piece in uniform:
                            counts[lang][piece] += p / whole
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    langs, probs = langid.learn(frame)
    assert langs == ["de", "en"]
    total = {lang: sum(counts[lang].values()) + langid.SMOOTHING * pieces.size for lang in langs}
    for c, lang in enumerate(langs):
        want = np.array([(counts[lang][w] + langid.SMOOTHING) / total[lang] for w in pieces.words])
        assert np.allclose(probs[:-1, c], want, rtol=1e-9)
    got = {r["doc_id"]: r for r in langid.identify(frame, (langs, probs)).collect()}
    for d, text, _ in docs[:3]:
        scores = [sum(math.log(all_cuts(u, dict(zip(pieces.words, probs[:-1, c])))) for t in text.lower().split() for u in langid.units(t)) for c in range(2)]
        best = int(np.argmax(scores))
        assert got[d]["lang_pred"] == langs[best] and math.isclose(got[d]["score"], 1 / sum(math.exp(x - scores[best]) for x in scores), rel_tol=1e-6)


def test_long_words_are_scored_whole(monkeypatch):
    """Long words give what short ones give, in parts of any size, and without an end to the numbers."""
    pieces = langid.pieces_of(langid.default_path(langid.VOCABULARY))
    rng = np.random.default_rng(2)
    p = rng.random((pieces.size + 1, 2)) / pieces.size
    p[-1] = 0
    words = ["▁thestationentscheidung", "▁漢字漢字", "▁q", "▁" + "internationalization" * 2]
    n = rng.random((len(words), 3))
    monkeypatch.setattr(langid, "WORD_CHARS", 60)
    want, counts = langid.log_scores(pieces, p, words), langid.expected(pieces, words, n)
    for most, part in ((2, 20_000), (2, 5), (10, 7)):
        monkeypatch.setattr(langid, "WORD_CHARS", most)
        monkeypatch.setattr(langid, "PLACES", part)
        assert np.allclose(langid.log_scores(pieces, p, words), want, rtol=1e-9)
        assert np.allclose(langid.expected(pieces, words, n), counts, rtol=1e-9)
    monkeypatch.undo()
    once, twice = langid.log_scores(pieces, p, ["▁" + "ab漢" * 400, "▁" + "ab漢" * 800])
    assert np.isfinite(twice).all() and (twice < 1.9 * once).all()


def test_no_product_is_too_small(spark):
    """Words of characters that no language showed, with probabilities as after 10**14 pieces."""
    pieces = langid.pieces_of(langid.default_path(langid.VOCABULARY))
    p = np.full((pieces.size + 1, 2), 1e-14)
    known = set(pieces.words)
    singles = [w for w in pieces.words if len(w) == 1 and w.isalpha()]
    a, b = next((a, b) for a in singles for b in singles if a < b and not {a + b, b + a, "▁" + a} & known)
    p[pieces.words.index(a), 1] = 3e-14
    word = (a + b) * 14
    got = langid.log_scores(pieces, p, ["▁" + word])[0]
    assert np.isfinite(got).all() and got[0] < got[1] < -600
    docs = spark.createDataFrame([(1, word), (2, f"{word} {word}"), (3, b * 31)], "doc_id long, text string")
    for r in langid.identify(docs, (["aa", "bb"], p)).collect():
        assert r["lang_pred"] == ("aa" if r["doc_id"] == 3 else "bb") and 0 <= r["score"] <= 1


def test_expected_counts_cover_each_character():
    """Expected pieces, weighted by their length, cover every known character as often as the words occur."""
    pieces = langid.pieces_of(langid.default_path(langid.VOCABULARY))
    words = ["▁the", "▁station", "▁la"]
    n = np.array([[3.0, 0.0], [1.0, 2.0], [0.0, 5.0]])
    got = langid.expected(pieces, words, n)
    lengths = np.array([len(w) for w in pieces.words])
    assert np.allclose((got * lengths[:, None]).sum(0), [sum(len(w) * k for w, k in zip(words, n[:, c])) for c in range(2)])


def test_language_on_held_out(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    model = langid.learn(docs.filter(~langid.held_out("doc_id")))
    got = langid.identify(docs, model).filter("held_out").join(docs, "doc_id").filter("lang_pred <> 'und'")
    right, n = got.selectExpr("count_if(lang_pred = lang)", "count(*)").first()
    assert n > 100 and right >= 0.97 * n


def test_language_odd(spark, odd_docs, rows):
    model = langid.learn(odd_docs)
    assert model[0] == ["en", "fr"]
    got = langid.identify(odd_docs, model).collect()
    assert len(got) == len(rows) + 2
    by = {r["doc_id"]: r for r in got}
    for d in (9000, 9001, 9002, 9012):
        assert (by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.learn(odd_docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, none).collect()} == {"und"}
    assert langid.identify(odd_docs.limit(0), model).count() == 0
    assert as_rows(langid.identify(odd_docs, model), "held_out")
    assert {r["doc_id"]: r["held_out"] for r in got}[9001] == (zlib.crc32(b"9001") % 4 == 2)


def test_words_are_whole():
    assert langid.units("(" + "x" * 70 + ")") == ["▁" + "x" * 70]
    assert langid.units("12345") == []


@pytest.mark.parametrize("token,unit", [("Word,".lower(), "▁word"), ("don't", "▁don't"), ("3rd", "▁rd")])
def test_units(token, unit):
    assert langid.units(token) == [unit]
