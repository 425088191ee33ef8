"""Ids of a tokenizer whose pieces never reach over white space, remembered piece by piece.

The tokenizer does all the work; this module only spares it the pieces that it has seen.  White
space is dropped before its merges, so the ids of a text are those of its space-separated pieces, one after
the other.  Pieces of printable ASCII and Latin-1 letters are split as the file's own pattern
splits them and given to its model directly; all others go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
from tokenizers import Tokenizer  # noqa: E402

_MOST, _LONG = 800_000, 48
_PLAIN = re.compile("[\n!-~À-ÖØ-öø-ÿ]+").fullmatch
# the file's pattern, over the characters of plain pieces after lower-casing
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-zß-öø-ÿ0-9]+").findall


def _letters() -> list[str]:
    """The character for each byte in the model's alphabet: printable ones stand for themselves, others follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + others.index(b)) for b in range(256)]


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their names in a text are ordinary text
        self.model = self.whole.model
        self.letters = _letters()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            word = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = _bytes([t.id for t in self.model.tokenize(word)])
            if len(part) <= _LONG:
                if len(self.parts) >= _MOST:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if _PLAIN(piece):
            return b"".join(map(self._part, _SPLIT(piece.lower())))
        return _bytes(self.whole.encode(piece, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers, without special tokens."""
        pieces = text.split(" ")
        words = self.words
        if len(words) > _MOST:
            words.clear()
        out = list(map(words.get, pieces))
        if None in out:
            for i, piece in enumerate(pieces):
                if out[i] is None:
                    out[i] = ids = self._piece(piece)
                    if len(piece) <= _LONG:
                        words[piece] = ids
        return b"".join(out)


_CODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The coder of a worker process, made once."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]
