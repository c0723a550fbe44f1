"""Byte-level BPE ids through the tokenizers library, with a bounded cache of text units.

A byte-level BPE tokenizer first cuts a text into pieces and then merges
inside each piece. No piece spans the place between a non-blank character and
a single space that a non-blank follows, so a text may be cut there and each
unit encoded alone: the ids joined are those of the whole text. Units repeat a
lot, so a worker keeps their ids. The special strings of a vocabulary hold no
blank, so a cut never splits one.

A new unit that is a plain word, perhaps with a punctuation mark, or two such
around a line break, falls into known pieces, which go straight to the
library's BPE model. All other units and texts take its whole encoder.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

UNIT = re.compile(r"(?<=\S)(?= \S)")
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"
PLAIN = re.compile(rf"([{LETTERS}]+)([.,;:!?]?)(?:(\n)([{LETTERS}]+)([.,;:!?]?))?")
CACHED_UNITS = 1_000_000  # at most about 200 MB per Python worker
CACHED_CHARS = 64
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a vocabulary file of the installed ``public_tokenizers`` package."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _BlankUnit(Exception):
    """A unit that starts or ends with a blank, or none between two spaces: the text must be cut elsewhere."""


class _Units(dict):
    """Ids of the units between single spaces, each encoded with the space before it; a new one is encoded when it is met."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.encoder.cached_units:
            self.clear()
        ids = self.encoder.unit(unit)
        if len(unit) <= CACHED_CHARS:
            self[unit] = ids
        return ids


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, cached_units: int = CACHED_UNITS):
        self.cached_units = cached_units
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._tokenize = self.model.tokenize
        self._units = _Units(self)
        self._marks = {x: self._piece(x) for x in ".,;:!?\n"} | {"": b"", None: b""}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, text: str) -> bytes:
        """Ids of a text that is one piece."""
        if text.isascii() and text[0] == " ":
            coded = self.model.tokenize("\u0120" + text[1:])
        else:
            coded = self.model.tokenize(text.encode().decode("latin-1").translate(BYTES))
        return array("I", [t.id for t in coded]).tobytes()

    def unit(self, unit: str) -> bytes:
        """Ids of a space and the unit after it."""
        if unit.isascii():  # most units: a word, perhaps with a mark that it may be known without
            if unit.isalpha():
                return array("I", [t.id for t in self._tokenize("\u0120" + unit)]).tobytes()
            if unit[:-1].isalpha() and unit[-1] in ".,;:!?":
                return self._units[unit[:-1]] + self._marks[unit[-1]]
        m = PLAIN.fullmatch(unit)
        if m is None:
            if not unit or unit[0].isspace() or unit[-1].isspace():
                raise _BlankUnit
            return self._encoded([" " + unit])[0]
        word, mark, line, word2, mark2 = m.groups()
        if not mark and not line:
            return self._piece(" " + word)
        ids = self._units[word] + self._marks[mark]
        return ids + self._marks[line] + self._piece(word2) + self._marks[mark2] if line else ids

    def _first(self, unit: str) -> bytes:
        m = PLAIN.fullmatch(unit)
        if m is None or m[3]:
            return self._encoded([unit])[0]
        return self._piece(m[1]) + self._marks[m[2]]

    def ids(self, text: str) -> bytes:
        units, known = text.split(" "), self._units
        first = units.pop(0)
        if not units or not first or first[-1].isspace():
            return self._by_boundary(text)
        try:
            return self._first(first) + b"".join(map(known.__getitem__, units))
        except _BlankUnit:
            return self._by_boundary(text)

    def _by_boundary(self, text: str) -> bytes:
        units = UNIT.split(text)
        distinct = list(set(units))
        here = dict(zip(distinct, self._encoded(distinct)))
        return b"".join([here[u] for u in units])


@lru_cache(maxsize=2)
def encoder(path: str, cached_units: int = CACHED_UNITS) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path, cached_units)
