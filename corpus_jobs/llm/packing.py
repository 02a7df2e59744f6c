"""Packing of documents into token windows by non-negative least squares.

Every task packs blocks of the documents it reads. A document's full windows stand alone; what remains is shorter than
a window, and a block's remainders form a histogram over lengths. All shallow combinations (pairs and triples) of lengths
that occur and fill a window exactly are enumerated, repeat counts x >= 0 are solved for so that the combinations use up
the histogram (least squares with multiplicative updates, which keep x non-negative), rounded to whole numbers of the
same total (largest remainders first), and realised as far as documents of those lengths are left. Residual documents are
packed greedily in a row and cut where a window is full; the open window goes on into the task's next block, and the last
one is dealt into powers of two, which need no padding.

No row moves between tasks, so nothing is shuffled, a hot length cannot pile up anywhere, and a task holds one block.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import default_path, encoded
from .common import documents, release, sliced

WINDOW = 2048
END_ID = 1
#: Tokens in one block of a task.
BLOCK_TOKENS = 2_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, planned boolean"


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill the window, of lengths with documents in hist."""
    have = np.flatnonzero(hist)
    have = have[(have > 0) & (have < window)]
    some, rows = hist > 0, [np.zeros((0, 3), dtype=np.int64)]
    two = have[2 * have <= window]
    two = two[some[window - two]]
    rows.append(np.stack([two, window - two, np.zeros_like(two)], axis=1))
    for a in have[3 * have <= window].tolist():
        b = have[(have >= a) & (2 * have <= window - a)]
        b = b[some[window - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(rows)


def solve(hist: np.ndarray, combos: np.ndarray, rounds: int = 60) -> np.ndarray:
    """x >= 0 that minimises |A x - hist|, A counting the lengths in each combination."""
    h = hist.astype(np.float64)
    h[0] = 0.0  # stands for no length
    flat = combos.ravel()
    total = lambda of: of[flat].reshape(-1, 3).sum(1)
    gain = total(h)
    x = np.where(gain > 0, 1.0, 0.0)
    for _ in range(rounds):
        made = np.bincount(flat, weights=np.repeat(x, 3), minlength=len(h))
        made[0] = 0.0
        x *= gain / np.maximum(total(made), 1e-12)
    return x


def repeats(hist: np.ndarray, combos: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): the solution in whole numbers, whole parts first and then remainders by size until the total is
    reached, no more of a length than hist has documents for."""
    if not len(combos):
        return []
    x = solve(hist, combos)
    left, out, total = hist.tolist(), [], round(float(x.sum()))
    whole = np.floor(x).astype(np.int64)
    first, then = np.argsort(-whole, kind="stable")[: int((whole > 0).sum())], np.argsort(whole - x, kind="stable")
    left[0] = len(x)  # never used up
    for order, most in ((first, whole), (then, None)):
        for j, (a, b, c) in zip(order.tolist(), combos[order].tolist()):
            if total <= 0:
                return out
            if not (left[a] and left[b] and left[c]):
                continue
            lengths = (a, b, c) if c else (a, b)
            times = min(total, int(most[j]) if most is not None else 1, *(left[v] // lengths.count(v) for v in lengths))
            if times > 0:
                out.append((lengths, times))
                total -= times
                for v in lengths:
                    left[v] -= times
    return out


class Packer:
    """Packs one task's documents; rows are (doc, start, length, ids_crc32, doc_tokens, sequence, offset, planned)."""

    def __init__(self, first_sequence: int, window: int = WINDOW):
        self.next, self.window = first_sequence, window
        self.open: list[tuple] = []  # (doc, ids, start, length) of the window that residuals are filling
        self.filled = 0

    def sequence(self, parts: list[tuple], rows: list[tuple], planned: bool = False) -> None:
        at = 0
        for doc, ids, start, length in parts:
            rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, self.next, at, planned))
            at += length
        self.next += 1

    def block(self, docs: list[tuple[object, bytes]]) -> list[tuple]:
        rows: list[tuple] = []
        w = self.window
        hist = np.zeros(w + 1, dtype=np.int64)
        by_length = defaultdict(list)
        for doc, ids in docs:
            n = len(ids) // 4
            full = n // w
            for i in range(full):
                self.sequence([(doc, ids, i * w, w)], rows)
            if n % w:
                hist[n % w] += 1
                by_length[n % w].append((doc, ids, full * w, n % w))
        for lengths, times in repeats(hist, combinations(hist, w)):
            for _ in range(times):
                self.sequence([by_length[v].pop() for v in lengths], rows, True)
        for v in sorted(by_length, reverse=True):
            for piece in by_length[v]:
                self.residual(piece, rows)
        return rows

    def residual(self, piece: tuple, rows: list[tuple]) -> None:
        doc, ids, start, length = piece
        while length:
            take = min(length, self.window - self.filled)
            self.open.append((doc, ids, start, take))
            self.filled += take
            start, length = start + take, length - take
            if self.filled == self.window:
                self.sequence(self.open, rows)
                self.open, self.filled = [], 0

    def close(self) -> list[tuple]:
        """The last open window as sequences whose lengths are powers of two."""
        rows: list[tuple] = []
        parts, left = self.open[::-1], self.filled
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while size:
                doc, ids, start, length = parts.pop()
                take = min(length, size)
                now.append((doc, ids, start, take))
                if take < length:
                    parts.append((doc, ids, start + take, length - take))
                size -= take
            self.sequence(now, rows)
        self.open, self.filled = [], 0
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    kinds = [pa.int64()] * (len(names) - 1) + [pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of a document: where it starts and how long it is, its sequence and its place there, and whether
    the solved counts planned its window (else it is a full window of a long document, or packed greedily).

    Ids are whole numbers. Null and empty texts are documents of the end id alone. Null ids stay null, repeated rows are packed each on its
    own. Sequence ids are unique over all tasks (the partition's number in the upper bits) but not without gaps.
    """
    path = tokenizer_path or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 36, window)
        held, tokens = [], 0
        for b in sliced(batches):
            for doc, ids in zip(b.column(0).to_pylist(), encoded(b.column(1).to_pylist(), path)):
                ids += end
                held.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield _batch(packer.block(held))
                    held, tokens = [], 0
        rows = packer.block(held)
        yield _batch(rows + packer.close())
        release()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


def op7_nnls_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
