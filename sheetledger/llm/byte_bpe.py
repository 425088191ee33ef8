"""Byte-level BPE: exact encoding in linear time by an automaton of tokens, and decoding.

Bytes are mapped to Latin-1 so that the automaton of all tokens reads them as characters.  A piece
is covered from left to right with the longest token that fits beside the one before it; where
none fits, the last one is taken back for its next shorter prefix.  Two tokens fit side by side
when merging their bytes gives just these two again, which is remembered per pair.  A sequence in which
all neighbours fit is the one that the merges make, so the result is exact, and each
place of a piece is given up once at most, so time is linear.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pieces longer than this are not remembered; at most so many pieces, pairs are.
_LONG, _MOST = 48, 600_000


class Coder:
    """The tokens of one rank file with what encoding remembers about them."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}
        self.token = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.tree = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            # a token that its own bytes do not merge to can only be a whole piece
            if len(token) == 1 or self.merged(token) == [rank]:
                self.tree.add_word(token.decode("latin-1"), (len(token), rank))
        self.tree.make_automaton()
        self.shorter: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, part: bytes) -> list[int]:
        """Merges of a short run of bytes by rank, lowest first."""
        units = [part[i:i + 1] for i in range(len(part))]
        while len(units) > 1:
            best, at = None, 0
            for i in range(len(units) - 1):
                rank = self.ranks.get(units[i] + units[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            units[at:at + 2] = [units[at] + units[at + 1]]
        return [self.ranks[u] for u in units]

    def side_by_side(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= _MOST:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def next_shorter(self, rank: int) -> tuple[int, int]:
        """(length, rank) of the longest token that is a proper prefix; length 0 if there is none."""
        found = self.shorter.get(rank)
        if found is None:
            token = self.token[rank].decode("latin-1")
            found = (0, -1)
            for n in range(len(token) - 1, 0, -1):
                if (hit := self.tree.get(token[:n], None)) is not None:
                    found = hit
                    break
            self.shorter[rank] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest: list[tuple[int, int]] = [(0, -1)] * len(piece)
        for end, hit in self.tree.iter(piece.decode("latin-1")):
            longest[end - hit[0] + 1] = hit  # matches come by growing ends: the last one of a start is the longest
        size, at, out = len(piece), 0, []
        dead = bytearray(size + 1)
        length, rank = longest[0]
        while True:
            if length == 0:  # nothing fits here: give the place up and shorten the token before
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                rank = out.pop()
                at -= len(self.token[rank])
                length, rank = self.next_shorter(rank)
                continue
            if not dead[at + length] and (not out or self.side_by_side(out[-1], rank)):
                out.append(rank)
                at += length
                if at == size:
                    return out
                length, rank = longest[at]
            else:
                length, rank = self.next_shorter(rank)

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
            if len(piece) <= _LONG:
                if len(self.known) >= _MOST:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers.

        A single space between two other characters that are no white space always starts a piece,
        so what stands between such spaces can be encoded, and remembered, by itself.
        """
        first, *parts = text.split(" ")
        words = self.words
        if len(words) > _MOST:
            words.clear()
        out = list(map(words.get, parts))
        if None in out:
            for i, part in enumerate(parts):
                if out[i] is None:
                    if not part or part[0].isspace() or part[-1].isspace():
                        return self._pieces(text)
                    out[i] = ids = self._pieces(" " + part)
                    if len(part) <= _LONG:
                        words[part] = ids
        if first and first[-1].isspace():
            return self._pieces(text)
        return self._pieces(first) + b"".join(out)

    @cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes one after another, and where each id's begin."""
        tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum([0, *map(len, tokens)])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for, taken from one buffer: a run of places for each id."""
        numbers = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        data, starts = self._bytes
        sizes = starts[numbers + 1] - starts[numbers]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[numbers] - ends + sizes, sizes)
        return data[places].tobytes()


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """The coder of a worker process, made once."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of each whole text, as binary of little-endian unsigned 32-bit numbers.

    Each match of ``pattern`` is encoded by itself, without special tokens.  Null and empty texts have no ids.
    Rows keep their places: nothing is shuffled.  Rows of repeated or null ids give a row each.  Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, decoded: the bytes that the ids of ``encode`` stand for; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            texts = [own.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode``, then ``decode`` of its ids, as digests; ids and bytes stay in the task.

    Null and empty texts have no ids; rows of repeated or null ids give a row each.  Rows keep their places; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            sizes, of_ids, of_bytes = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                sizes.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
