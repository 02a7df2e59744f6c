"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

Patterns mark e-mail addresses, IP addresses, payment cards and telephone numbers. The random field labels words from
their shapes (runs of letters and digits, lengths, marks, neighbours' shapes). It is trained on a small labelled table:
at most MAX_LABELLED stretches of words around digits and @ signs, taken from the corpus by hash and labelled by the
patterns. The patterns' own spelling would teach it nothing new, so every labelled span also stands in the table as
people write it otherwise (other separators, no plus sign, an area code in brackets, a host without a dot), with the label
that it has. Viterbi decodes stretches of all documents in numpy batches. A span that the field adds is checked (enough
digits, a valid check digit, an @ inside) and never overlaps a pattern's span.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, materialize

KINDS = ("email", "ip", "card", "phone")
LABELS = ("", *KINDS)
#: Rows of the labelled table; the only sample in this operator. Half of them, at most, are stretches without a span.
MAX_LABELLED = 600
#: Other spellings of each labelled stretch that has a span.
SPELLINGS = 4
#: Words of a stretch on either side of a word with a digit or an @.
AROUND = 3
#: Words, padding included, that are decoded together.
CELLS = 100_000
#: Words of a labelled stretch; longer ones are not used for training. Decoding has no such bound.
TRAIN_WORDS = 60
ROUNDS, RATE, DECAY = 120, 0.2, 1e-3

# Fixed by the operator's contract. Look-behinds and possessive repeats only keep the patterns linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
WORD = re.compile(r"[^ \t-\r]+")


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ signs."""
    low, at = 0, text.find("@")
    while at >= 0:
        begin = low + len(text[low:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def valid(kind: str, s: str) -> bool:
    d = digits(s)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind != "phone" or 10 <= len(d) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, in order."""
    if not text or not HINT.search(text):
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return sorted(found)


# --- features -------------------------------------------------------------------------------------------------------

_EDGES = ".,;:!?\"'<>[]{}"
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")


def shape(word: str) -> str:
    """A word without edge marks, its runs of letters and digits folded; no part of a long word is left out."""
    word = word.strip(_EDGES)
    return _DIGITS.sub(lambda m: f"9{min(len(m[0]), 12):x}", _LETTERS.sub("a", word))


def features(prev: str, here: str, following: str) -> list[str]:
    """Names of the features of a word, from the shapes of it and its neighbours."""
    n = here.count("9")
    return ["bias", f"s={here}", f"p={prev}", f"n={following}", f"@={'@' in here}", f"+={here[:1] == '+'}", f"r={min(n, 5)}", f"marks={''.join(sorted(set(here) - set('a9') - set('0123456789bc')))}", f"digits-only={bool(here) and 'a' not in here}"]


def stretches(text: str | None):
    """Yields lists of (start, end, word) around words with a digit or an @. Words further away hold neither and can
    never be part of an accepted span."""
    if not text or not HINT.search(text):
        return
    end = -1
    for line in text.split("\n"):
        begin, end = end + 1, end + 1 + len(line)
        if not HINT.search(line):
            continue
        words = [(begin + m.start(), begin + m.end(), m[0]) for m in WORD.finditer(line)]
        now, last = [], -1
        for i in (i for i, w in enumerate(words) if HINT.search(w[2])):
            first = max(0, i - AROUND)
            if now and first > last + 1:
                yield now
                now = []
            now += words[max(first, last + 1) if now else first : i + AROUND + 1]
            last = min(len(words) - 1, i + AROUND)
        if now:
            yield now


# --- the random field -----------------------------------------------------------------------------------------------


class Field:
    """Weights of a linear chain: features(label), moves(from, to)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.known: dict[tuple[str, str, str], np.ndarray] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        shapes = ["", *map(shape, words), ""]
        rows = []
        for key in zip(shapes, shapes[1:], shapes[2:]):
            row = self.known.get(key)
            if row is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                at = [self.names[f] for f in features(*key) if f in self.names]
                row = self.weights[at].sum(0)
                if sum(map(len, key)) < 200:  # odd long ones are not remembered
                    self.known[key] = row
            rows.append(row)
        return np.array(rows).reshape(len(words), len(LABELS))

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of each sequence of emissions; sequences of like length go through numpy together, as many as
        make CELLS words with what the shorter ones are padded by."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(batch)
        order = sorted((i for i in range(len(batch)) if len(batch[i])), key=lambda i: -len(batch[i]))
        i = 0
        while i < len(order):
            part = order[i : i + max(1, CELLS // len(batch[order[i]]))]
            i += len(part)
            n = np.array([len(batch[j]) for j in part])
            e = np.zeros((len(part), int(n.max()), len(LABELS)))
            for r, j in enumerate(part):
                e[r, : n[r]] = batch[j]
            score, back = e[:, 0], np.zeros(e.shape, dtype=np.int8)
            for t in range(1, e.shape[1]):
                step = score[:, :, None] + self.moves
                back[:, t] = step.argmax(1)
                score = np.where((t < n)[:, None], step.max(1) + e[:, t], score)
            at, rows = score.argmax(1), np.arange(len(part))
            path = np.zeros(e.shape[:2], dtype=np.int8)
            for t in range(e.shape[1] - 1, -1, -1):
                inside = t < n
                path[inside, t] = at[inside]
                if t:
                    at = np.where(inside, back[rows, t, at], at)
            for r, j in enumerate(part):
                out[j] = path[r, : n[r]]
        return out


def train(rows: list[tuple[list[str], list[int]]], rounds: int = ROUNDS) -> Field:
    """Fits a field to (words, labels) by gradient ascent on the conditional log-likelihood."""
    names: dict[str, int] = {}
    k = len(LABELS)
    rows = [r for r in rows if 0 < len(r[0]) <= TRAIN_WORDS]
    if not rows:
        return Field({"bias": 0}, np.array([[1.0] + [0.0] * (k - 1)]), np.zeros((k, k)))
    coded = []
    for words, _ in rows:
        shapes = ["", *map(shape, words), ""]
        coded.append([[names.setdefault(f, len(names)) for f in features(*key)] for key in zip(shapes, shapes[1:], shapes[2:])])
    n = np.array([len(c) for c in coded])
    steps, width = int(n.max()), len(coded[0][0])
    at = np.full((len(rows), steps, width), len(names))
    gold = np.zeros((len(rows), steps), dtype=np.int64)
    for r, (c, (_, labels)) in enumerate(zip(coded, rows)):
        at[r, : n[r]], gold[r, : n[r]] = c, labels
    inside = np.arange(steps) < n[:, None]
    true = np.eye(k)[gold] * inside[..., None]
    true_moves = np.einsum("rti,rtj->ij", true[:, :-1], true[:, 1:])
    w, m = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    gw, gm = np.full_like(w, 1e-8), np.full_like(m, 1e-8)

    def logsum(x, axis):
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for _ in range(rounds):
        e = w[at].sum(2) * inside[..., None]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            alpha[:, t] = np.where(inside[:, t, None], logsum(alpha[:, t - 1][:, :, None] + m, 1) + e[:, t], alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            beta[:, t] = np.where(inside[:, t + 1, None], logsum(m + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0.0)
        z = logsum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + m + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
        dw = np.zeros_like(w)
        np.add.at(dw, at.reshape(-1), np.repeat((true - p).reshape(-1, k), width, axis=0))
        dw, dm = dw / len(rows) - DECAY * w, (true_moves - pair.sum((0, 1))) / len(rows) - DECAY * m
        dw[-1] = 0.0
        gw, gm = gw + dw * dw, gm + dm * dm
        w, m = w + RATE * dw / np.sqrt(gw), m + RATE * dm / np.sqrt(gm)
    return Field(names, w[:-1], m)


def labelled(text: str | None) -> list[tuple[list[str], list[int]]]:
    """The stretches of a text with the patterns' labels: a word has a kind if a span of it covers part of the word."""
    spans = base_spans(text)
    out, at, open_ = [], 0, []
    for words in stretches(text):
        labels = []
        for a, b, _ in words:
            while at < len(spans) and spans[at][0] < b:
                open_.append(spans[at])
                at += 1
            open_ = [x for x in open_ if a < x[2]]  # words come in order, so what has ended stays ended
            labels.append(open_[0][1] + 1 if open_ else 0)
        out.append(([w for _, _, w in words], labels))
    return out


def spelled(kind: str, s: str, way: int) -> str:
    """A span in one of the ways in which it is written outside its pattern."""
    if kind == "email":
        local, _, domain = s.partition("@")
        return (f"{local}@{domain.split('.')[0]}", f"{local}@{domain.replace('.', ',')}", f"{local}(@){domain}", f"{local}@{domain.replace('.', '_')}")[way % 4]
    if kind == "ip":
        return s.replace(".", ("[.]", "(.)")[way % 2])
    d = digits(s)
    if kind == "card":
        mark = ("." , "/", "_", " - ")[way % 4]
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))
    area, first, rest = d[-10:-7], d[-7:-4], d[-4:]
    country = d[:-10]
    ways = (f"{area}-{first}-{rest}", f"({area}) {first}-{rest}", f"{area}.{first}.{rest}", f"{area} {first} {rest}", f"00{country} {area} {first}{rest}", f"{country or 1}-{area}-{first}-{rest}", f"({area}){first}-{rest}")
    return ways[way % len(ways)]


def respelled(words: list[str], labels: list[int], way: int) -> tuple[list[str], list[int]]:
    """A labelled stretch with its spans written otherwise; edge marks of a span's words stay."""
    out: list[str] = []
    kinds: list[int] = []
    i = 0
    while i < len(words):
        j = i + 1
        while labels[i] and j < len(words) and labels[j] == labels[i]:
            j += 1
        whole = " ".join(words[i:j])
        if labels[i]:
            core = whole.strip(_EDGES)
            at = whole.find(core)
            whole = whole[:at] + spelled(KINDS[labels[i] - 1], core, way) + whole[at + len(core) :]
        for w in whole.split(" "):
            out.append(w), kinds.append(labels[i])
        i = j
    return out, kinds


def with_spellings(rows: list[tuple[list[str], list[int]]], ways: int = SPELLINGS, seed: int = 0) -> list[tuple[list[str], list[int]]]:
    """The rows, and those that have a span again in other spellings."""
    more = [respelled(words, labels, seed + i + way) for i, (words, labels) in enumerate(rows) if any(labels) for way in range(ways)]
    return rows + more


LABELLED = T.ArrayType(T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.IntegerType()))]))


def labelled_table(docs: DataFrame, text_col: str = "text", most: int = MAX_LABELLED) -> list[tuple[list[str], list[int]]]:
    """At most so many labelled stretches, chosen by hash over the whole corpus, each distinct one once; half of the places
    are for stretches with a span and half for those without."""

    @F.arrow_udf(LABELLED)
    def of(text: pa.Array) -> pa.Array:
        rows = [[{"words": w, "labels": lab} for w, lab in labelled(t) if len(w) <= TRAIN_WORDS] for t in (x.as_py() for x in text)]
        return pa.array(rows, type=pa.list_(pa.struct([("words", pa.list_(pa.string())), ("labels", pa.list_(pa.int32()))])))

    hinted = docs.filter(F.col(text_col).rlike("[0-9@]"))
    found = hinted.select(F.explode(of(F.col(text_col))).alias("x")).select("x.words", "x.labels")
    distinct = found.withColumn("h", F.xxhash64("words")).groupBy("h").agg(F.min(F.struct("words", "labels")).alias("x")).withColumn("some", F.array_max("x.labels") > 0)
    distinct = materialize(distinct, "stretches")
    chosen = distinct.filter("some").orderBy("h").limit(most // 2).unionByName(distinct.filter("not some").orderBy("h").limit(most - most // 2))
    return [(list(r["x"]["words"]), list(r["x"]["labels"])) for r in chosen.collect()]


_ADDED = {
    "ip": re.compile(r"[0-9]{1,3}(?:[\[(]?\.[\])]?[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ ./_-]*[0-9])+"),
    "phone": re.compile(r"[+( ]*[0-9](?:[ ().-]*[0-9])+"),
}


def acceptable(kind: str, s: str) -> bool:
    if kind == "email":
        return 0 < s.find("@") < len(s) - 1
    return bool(_ADDED[kind].fullmatch(s)) and valid(kind, re.sub(r"[\[\]()]", "", s) if kind == "ip" else s)


def added_spans(words: list[tuple[int, int, str]], labels: np.ndarray, text: str, taken: list[tuple[int, int, int]]):
    """(start, kind number, end) of the runs of one label that pass their check and overlap no taken span."""
    starts = [s for s, _, _ in taken]
    ends = list(accumulate((e for _, _, e in taken), max))  # of all spans up to each
    i = 0
    while i < len(words):
        k, j = int(labels[i]) - 1, i + 1
        if k < 0:
            i = j
            continue
        while k >= 2 and j < len(words) and labels[j] == k + 1:
            j += 1
        a, b = words[i][0], words[j - 1][1]
        a += len(text[a:b]) - len(text[a:b].lstrip(_EDGES))
        b -= len(text[a:b]) - len(text[a:b].rstrip(_EDGES))
        if acceptable(KINDS[k], text[a:b]) and not ((n := bisect_left(starts, b)) and ends[n - 1] > a):
            yield a, k, b
        i = j


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


RESULT = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of docs.

    Counts and base_sha256 are of the patterns' spans, spans holds the field's too. Null texts are empty: no spans, and
    the hash of an empty string. Offsets are code points.
    """
    names, weights, moves = field.names, field.weights, field.moves
    fields: dict[str, Field] = {}
    token = uuid.uuid4().hex

    @F.arrow_udf(RESULT)
    def of(text: pa.Array) -> pa.Array:
        own = fields.setdefault(token, Field(names, weights, moves))
        texts = text.to_pylist()
        base = [base_spans(t) for t in texts]
        todo = [(i, words) for i, t in enumerate(texts) for words in stretches(t)]
        more: dict[int, list] = {}
        paths = own.decode([own.emissions([w for _, _, w in words]) for _, words in todo])
        for (i, words), labels in zip(todo, paths):
            if labels.any():
                new = list(added_spans(words, labels, texts[i], base[i]))
                if new:
                    more.setdefault(i, []).extend(new)
        rows = []
        for i, spans in enumerate(base):
            rows.append((*[sum(1 for s in spans if s[1] == k) for k in range(4)], hashlib.sha256(joined(spans).encode()).hexdigest(), joined(spans + more.get(i, []))))
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.StructArray.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], names=RESULT.names)

    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col)).alias("f")).select("doc_id", *[f"f.{c}" for c in RESULT.names])


def op3_pii_crf(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, train(with_spellings(labelled_table(docs))))
