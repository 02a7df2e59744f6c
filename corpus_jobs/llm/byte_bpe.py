"""Whole-text encoding with a byte-level BPE of the tokenizers library, a unit of text at a time.

Merges never cross the pieces that the pre-tokenizer makes, so a text is cut at places that are piece boundaries
whatever stands around them: before a run of Latin letters with its space, after it, and between a line feed and a
letter. The library encodes each distinct unit once, and a text's ids are its units' ids in a row. A text with a unit
that could join its neighbours (letters of other scripts, a lone quote before a letter) is encoded whole. So is one that
holds the string of an added token (<|endoftext|>), which gets that token's id, as by the library's default.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

DEFAULT = "byte_bpe_50k.json"
#: Units of a generation. A full generation becomes the older one, from which units still in use come back. Both take
#: about 150 MB; with 150,000, two fifths more units were encoded anew.
MAX_UNITS = 400_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Words (with inner quotes), a line feed or tab before a letter, and everything between.
_UNIT = re.compile(rf" ?[{_LATIN}]+(?:'[{_LATIN}]+)*|[^\S ](?=[{_LATIN}])|(?:[^{_LATIN}\s]| (?![{_LATIN}])|[^\S ](?![{_LATIN}]))+")
_WORD = re.compile(rf" ?[{_LATIN}]+\Z")
_LETTER = re.compile(rf"[{_LATIN}]\Z")
#: Control characters that count as blanks in some pattern languages only.
_UNSURE = set("\x1c\x1d\x1e\x1f")


def default_path(name: str = DEFAULT) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ID = attrgetter("id")


class NotAUnit(Exception):
    pass


class Units(dict):
    """Ids of units by their text, computed when first asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            if _WORD.match(unit):
                ids = self.encoder.word(unit)
            elif _LETTER.search(unit) or self.alone(unit):
                ids = self.encoder.raw(unit)
            else:
                raise NotAUnit
        if len(self) >= MAX_UNITS:
            self.older = dict(self)
            self.clear()
        self[unit] = ids
        return ids

    @staticmethod
    def alone(marks: str) -> bool:
        """Whether marks, digits and blanks between words are pieces of their own: no letters, and no quote at the end
        that would begin a piece and so a contraction."""
        if any(c.isalpha() or c in _UNSURE for c in marks):
            return False
        return marks[-1] != "'" or (len(marks) > 1 and (marks[-2] == " " or not (marks[-2].isspace() or marks[-2].isnumeric())))


class Encoder:
    """Encodes texts to the bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units = Units(self)
        # byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in order, from code 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def raw(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """Ids of a run of letters with or without a space before it, which the pre-tokenizer leaves whole."""
        if text.isascii():
            text = "\u0120" + text[1:] if text[0] == " " else text
        else:
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", map(_ID, self.tokenizer.model.tokenize(text))).tobytes()

    def encode(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return self.raw(text)
        try:
            return b"".join(map(self.units.__getitem__, _UNIT.findall(text)))
        except NotAUnit:
            return self.raw(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; loaded once in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts, path: str):
    """Yields the ids of each text (null: empty) as bytes."""
    encode = encoder(path).encode
    for t in texts:
        yield encode(t.encode("utf-8", "replace").decode()) if t else b""
