"""Token counts, with overlap resynchronisation for huge documents.

Most texts are encoded whole. A huge one is encoded in overlapping chunks with offsets. Two neighbouring encodings are
spliced at a boundary that both have and that is proven stable: no piece of the vocabulary holds the two characters
around it next to each other, so no merge can ever cross it, whatever stands further left or right. If an overlap holds
no such boundary, it is widened; at worst the chunk grows to the rest of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import default_path
from .common import documents

MODEL = "piece_bpe_32k.model"
CHUNK_BYTES = 32_000
OVERLAP_BYTES = 400
LIMIT = 4096
SPACE = "▁"


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised protocol buffer; values of fixed width are left out."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (message[at] & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if message[at - 1] < 0x80:
                return value, at

    at = 0
    while at < len(message):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = message[at : at + size], at + size
        else:
            value, at = None, at + {1: 8, 5: 4}[kind]
        if value is not None:
            yield tag >> 3, value


def keeps_characters(model: bytes) -> bool:
    """Whether the model's normaliser, as its file states it, maps no characters and keeps every blank."""
    spec = dict(fields(dict(fields(model)).get(3, b"")))  # normalizer_spec
    return not spec.get(2) and not spec.get(4, 1)  # precompiled_charsmap; remove_extra_whitespaces, true by default


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        words = [sp.id_to_piece(n) for n in range(sp.get_piece_size()) if not (sp.is_byte(n) or sp.is_control(n))]
        self.pairs = {w[i : i + 2] for w in words for i in range(len(w) - 1)}
        # the proof needs a normaliser that leaves each character alone; else huge texts are encoded whole
        self.plain = keeps_characters(sp.serialized_model_proto())

    def stable(self, text: bytes, at: int) -> bool:
        """Whether the place at a byte offset is a boundary in every encoding of a text with the characters around it."""
        a = text[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:]
        b = text[at : at + 4].decode("utf-8", "ignore")[:1]
        return (a + b).replace(" ", SPACE) not in self.pairs

    def begins(self, text: bytes, first: int, last: int) -> list[int]:
        """Byte offsets at which the pieces of text[first:last] begin, one for each piece."""
        proto = self.sp.encode(text[first:last].decode(), return_type="proto")
        return [first + p.begin for p in proto.pieces]

    @staticmethod
    def aligned(text: bytes, at: int) -> int:
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def huge(self, text: str) -> int:
        b = text.encode()
        total, low, stop = 0, 0, self.aligned(b, self.chunk)
        left = self.begins(b, 0, stop)  # pieces of the current chunk from the last splice, at low, onwards
        while stop < len(b):
            over, at = self.overlap, None
            while at is None:
                first = self.aligned(b, max(low, stop - over))
                last = self.aligned(b, min(len(b), stop + self.chunk))
                right = self.begins(b, first, last)
                both = set(right)
                at = next((x for x in left[bisect_left(left, first + 1) :] if x in both and x < stop and self.stable(b, x)), None)
                if at is None and first <= low:
                    return len(self.sp.encode(text))  # nowhere to splice: the text is one unit
                over *= 2
            total += bisect_left(left, at)
            left, low, stop = right[bisect_left(right, at) :], at, last
        return total + len(left)

    def count(self, texts: list[str]) -> list[int]:
        whole = [not self.plain or 4 * len(t) > self.chunk >= len(t.encode()) or 4 * len(t) <= self.chunk for t in texts]
        small = [t for t, w in zip(texts, whole) if w]
        lengths = iter([len(x) for i in range(0, len(small), 1000) for x in self.sp.encode(small[i : i + 1000], num_threads=1)])
        return [next(lengths) if w else self.huge(t) for t, w in zip(texts, whole)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for a model file; loaded once in each Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs; a narrow pass. Null texts are empty: no bytes, no tokens."""
    path = model_path or default_path(MODEL)

    @F.arrow_udf("long")
    def tokens(text: pa.Array) -> pa.Array:
        return pa.array(counter(path).count([t or "" for t in text.to_pylist()]), type=pa.int64())

    counted = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), tokens(F.col(text_col)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
