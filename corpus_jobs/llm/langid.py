"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. A word's probability in a language is the sum, over all ways to cut it into
pieces, of the product of the pieces' probabilities, which the forward algorithm gives in one pass over its characters;
a text's probability is the product over its words. Piece probabilities are learned by one step of expectation
maximisation from uniform ones: every training document adds the expected number of times that each piece occurs in its
words (forward-backward), so counts cover all training text. Both passes handle each distinct word of a batch once.

Words and pieces are compared in lower case; pieces that differ in case only are one. Scores are summed in logarithms, so
that no product is too small to be told. Words of up to WORD_CHARS characters go through numpy together, longer ones one
at a time; both give the same sums.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import default_path
from .common import documents, release, sliced

VOCABULARY = "piece_bpe_32k.model"
#: Characters of words that are handled together; longer ones give the same sums by another way.
WORD_CHARS = 32
#: Places of a long word whose pieces are looked up at once.
PLACES = 20_000
SMOOTHING = 0.1
#: Probability of a character that the vocabulary does not have.
UNKNOWN = 1e-7
#: Distinct words that a worker holds before it starts anew.
MAX_WORDS = 300_000
SPACE = "▁"
UNDETERMINED = "und"

_BASE = np.uint64(0x100000001B3)


def _hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of n characters of equally long rows."""
    width = chars.shape[1] - n + 1
    h = np.full((chars.shape[0], width), np.uint64(n), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ chars[:, i : i + width]) * _BASE
            h ^= h >> np.uint64(29)
    return h


class Pieces:
    """The vocabulary's pieces, found by hash among those of the same length."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words = sorted({sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))} - {""})
        self.size = len(self.words)
        lengths = np.array([len(w) for w in self.words])
        #: lengths of pieces, and for each the hashes in order and the pieces that they are of
        self.lengths, self.tables = np.unique(lengths).tolist(), {}
        for n in self.lengths:
            at = np.flatnonzero(lengths == n)
            h = _hashes(as_chars([self.words[i] for i in at], n), n)[:, 0]
            order = np.argsort(h)
            self.tables[n] = h[order], at[order]

    def ids(self, chars: np.ndarray, n: int) -> np.ndarray:
        """Piece of each substring of n characters; size (one past the last) where there is none."""
        h = _hashes(chars, n)
        hashes, pieces = self.tables[n]
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        return np.where(hashes[at] == h, pieces[at], self.size)


def as_chars(words: list[str], n: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{n}").view("<u4").reshape(len(words), n).astype(np.uint64)


def units(token: str) -> list[str]:
    """The scored word of a token without blanks, if any: its letters and what stands between them."""
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return [SPACE + token[a:b]] if b > a else []


def grouped(words: list[str], most: int = 40_000):
    """Yields (row numbers, characters, n) for words of the same length n, up to WORD_CHARS."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    order = order[: int((lengths <= WORD_CHARS).sum())]
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for at in np.split(order, cuts):
        for i in range(0, len(at), most):
            part = at[i : i + most]
            if len(part) and (n := int(lengths[part[0]])):
                yield part, as_chars([words[j] for j in part], n), n


def long_ones(words: list[str]):
    """Yields (row number, word) for the others."""
    return ((i, w) for i, w in enumerate(words) if len(w) > WORD_CHARS)


def forward(pieces: Pieces, probs: np.ndarray, chars: np.ndarray, n: int):
    """(alpha, ids): alpha[j] sums all segmentations of the first j characters, a row per word and a column per language;
    ids holds the pieces of each length. For uniform probabilities, whose products over WORD_CHARS characters doubles hold."""
    ids = {k: pieces.ids(chars, k) for k in pieces.lengths if k <= n}
    alpha = np.zeros((n + 1, len(chars), probs.shape[1]))
    alpha[0] = 1.0
    for j in range(1, n + 1):
        for k, found in ids.items():
            if k > j:
                break
            at = found[:, j - k]
            if k == 1:
                alpha[j] += alpha[j - 1] * np.where((at == pieces.size)[:, None], UNKNOWN, probs[at])
            else:
                some = np.flatnonzero(at < pieces.size)
                if len(some):
                    alpha[j, some] += alpha[j - k, some] * probs[at[some]]
    return alpha, ids


def log_forward(pieces: Pieces, logs: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """The logarithm of forward's sum for whole words; logs(piece, language) has the logarithm of UNKNOWN in its last row."""
    ids = {k: pieces.ids(chars, k) for k in pieces.lengths if k <= n}
    alpha = np.full((n + 1, len(chars), logs.shape[1]), -np.inf)
    alpha[0] = 0.0
    for j in range(1, n + 1):
        for k, found in ids.items():
            if k > j:
                break
            at = found[:, j - k]
            if k == 1:
                alpha[j] = alpha[j - 1] + logs[at]
            else:
                some = np.flatnonzero(at < pieces.size)
                if len(some):
                    alpha[j, some] = np.logaddexp(alpha[j, some], alpha[j - k, some] + logs[at[some]])
    return alpha[n]


def places(pieces: Pieces, word: str):
    """Yields (place, lengths, pieces) for each character of a word: the pieces that begin there. A character that is no
    piece is the one past the last."""
    longest = pieces.lengths[-1]
    for low in range(0, len(word), PLACES):
        part = word[low : low + PLACES + longest - 1]
        chars, n = as_chars([part], len(part)), min(PLACES, len(word) - low)
        found = np.full((n, len(pieces.lengths)), -1, dtype=np.int64)
        for c, k in enumerate(pieces.lengths):
            if k <= len(part):
                got = pieces.ids(chars, k)[0][:n]
                found[: len(got), c] = np.where((got < pieces.size) | (k == 1), got, -1)
        lengths = np.array(pieces.lengths)
        for i in range(n):
            some = found[i] >= 0
            yield low + i, lengths[some], found[i][some]


def long_forward(pieces: Pieces, logs: np.ndarray, word: str) -> np.ndarray:
    """Natural logarithms of the sums of all segmentations of the first j characters of one word, a row for each j;
    logs(piece, language) has the logarithm of UNKNOWN in its last row."""
    alpha = np.full((len(word) + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0.0
    for i, lengths, found in places(pieces, word):
        alpha[i + lengths] = np.logaddexp(alpha[i + lengths], alpha[i] + logs[found])
    return alpha


def logarithms(pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        logs = np.log(probs)
    logs[pieces.size] = np.log(UNKNOWN)
    return logs


def expected(pieces: Pieces, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected counts (piece, language) under uniform pieces; weights(word, language) are the words' counts."""
    probs = np.full((pieces.size + 1, 1), 1.0 / pieces.size)
    probs[-1] = 0.0
    p = 1.0 / pieces.size
    total = np.zeros((pieces.size + 1, weights.shape[1]))
    for at, chars, n in grouped(words):
        alpha, ids = forward(pieces, probs, chars, n)
        beta = np.zeros((n + 1, len(chars)))
        beta[n] = 1.0
        for j in range(n - 1, -1, -1):
            for k, found in ids.items():
                if k > n - j:
                    break
                beta[j] += beta[j + k] * np.where(found[:, j] < pieces.size, p, UNKNOWN if k == 1 else 0.0)
        whole = alpha[n, :, 0]
        w = weights[at]
        for k, found in ids.items():
            for j in range(n - k + 1):
                piece = found[:, j]
                some = np.flatnonzero(piece < pieces.size)
                if len(some):
                    share = alpha[j, some, 0] * p * beta[j + k, some] / whole[some]
                    for c in range(w.shape[1]):
                        total[:, c] += np.bincount(piece[some], weights=share * w[some, c], minlength=pieces.size + 1)
    logs = logarithms(pieces, probs)
    for i, word in long_ones(words):
        alpha = long_forward(pieces, logs, word)[:, 0]
        beta = np.full(len(word) + 1, -np.inf)
        beta[len(word)] = 0.0
        for low in range((len(word) - 1) // PLACES * PLACES, -1, -PLACES):  # the last places first
            part = word[low : low + PLACES + pieces.lengths[-1] - 1]
            for j, lengths, found in reversed([x for x in places(pieces, part) if x[0] < PLACES]):
                ways = logs[found, 0] + beta[low + j + lengths]
                beta[low + j] = np.logaddexp.reduce(ways)
                share = np.exp(alpha[low + j] + ways - alpha[-1])
                np.add.at(total, found, share[:, None] * weights[i])
    return total[:-1]


def log_scores(pieces: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log-probability of each word in each language."""
    out, logs = np.zeros((len(words), probs.shape[1])), logarithms(pieces, probs)
    for at, chars, n in grouped(words):
        out[at] = log_forward(pieces, logs, chars, n)
    for i, word in long_ones(words):
        out[i] = long_forward(pieces, logs, word)[-1]
    return out


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


class Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def expected_counts(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, n): expected piece counts by language over all rows of docs with a text and a language."""

    def run(batches):
        pieces = pieces_of(path)
        langs, sums, words, counts = Numbered(), {}, Numbered(), {}

        def flush():
            if not words:
                return
            w = np.zeros((len(words), len(langs)))
            for lang, parts in counts.items():
                w[:, langs[lang]] = np.bincount(np.concatenate(parts), minlength=len(words))
            flat, owner = [], []
            for i, token in enumerate(words):
                for u in units(token):
                    flat.append(u), owner.append(i)
            if flat:
                got = expected(pieces, flat, w[owner])
                for lang, c in langs.items():
                    sums[lang] = sums.get(lang, 0) + got[:, c]
            words.clear(), counts.clear()

        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                langs[lang]
                counts.setdefault(lang, []).append(np.array([words[t] for t in text.lower().split()], dtype=np.int64))
                if len(words) > MAX_WORDS:
                    flush()
        flush()
        release()
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at])], names=["lang", "piece", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str | None = None, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, probabilities(piece, language)). The table has at most one row per language and piece of the fixed
    vocabulary, however large the corpus is; that is what reaches the driver and the workers."""
    path = path or default_path(VOCABULARY)
    rows = expected_counts(docs, path, text_col, lang_col).toPandas()
    langs = sorted(rows["lang"].unique())
    n = np.full((pieces_of(path).size, len(langs)), SMOOTHING)
    for c, lang in enumerate(langs):
        mine = rows[rows["lang"] == lang]
        n[mine["piece"].to_numpy(), c] += mine["n"].to_numpy()
    return langs, np.vstack([n / n.sum(0, keepdims=True), np.zeros((1, len(langs)))])


_scored: dict[str, tuple[Numbered, np.ndarray]] = {}


def _predictor(langs: list[str], probs: np.ndarray, path: str):
    token = uuid.uuid4().hex
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def predict(text: pa.Array) -> pa.Array:
        if token not in _scored or len(_scored[token][0]) > MAX_WORDS:
            _scored.clear()
            _scored[token] = Numbered(), np.zeros((0, len(langs) + 1))
        words, table = _scored[token]
        at = [np.array([words[t] for t in x.lower().split()], dtype=np.int64) if x else None for x in (x.as_py() for x in text)]
        if len(words) > len(table):
            new = list(words)[len(table) :]
            flat, owner = [], []
            for i, t in enumerate(new):
                for u in units(t):
                    flat.append(u), owner.append(i)
            more = np.zeros((len(new), len(langs) + 1))
            if flat:
                np.add.at(more, owner, np.hstack([log_scores(pieces_of(path), probs, flat), np.ones((len(flat), 1))]))
            _scored[token] = words, table = words, np.vstack([table, more])
        names, scores = [], []
        for a in at:
            s = table[a].sum(0) if a is not None and len(a) else None
            if s is None or s[-1] == 0 or not langs:
                names.append(UNDETERMINED), scores.append(0.0)
                continue
            best = int(np.argmax(s[:-1]))
            names.append(langs[best])
            scores.append(float(1.0 / np.exp(s[:-1] - s[best]).sum()))
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs; score is the language's share among the learned ones with
    equal priors. Null texts and texts without a letter are `und` with score 0; ties go to the first name."""
    predict = _predictor(*model, path or default_path(VOCABULARY))
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, learn(docs.filter(~held_out("doc_id"))))
