"""Bounded-space online packing of documents into sequences of a fixed size.

Each partition keeps a fixed number of open windows.  A document's full windows leave at once; its
rest goes to the open window where it fits best.  Where it fits in none, the fullest window is
topped up with the head of the rest and leaves.  At the end of a partition its open windows are
merged, and what is left of all partitions (less than one window each) is merged in groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .word_ids import word_ids

_WIDTH = 4  # bytes of an id
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, bytes, int]  # document, ids before, ids, ids of the document


def _cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n * _WIDTH], total), (doc, start + n, ids[n * _WIDTH:], total)


class Packer:
    """Open windows of one partition; ``emit`` gets the pieces of each full window."""

    def __init__(self, size: int, windows: int, emit: Callable[[list[Piece]], None]):
        self.size, self.windows, self.emit = size, windows, emit
        self.open: list[list[Piece]] = []
        self.free: list[int] = []

    def add(self, piece: Piece) -> None:
        rest = len(piece[2]) // _WIDTH
        while rest >= self.size:
            head, piece = _cut(piece, self.size)
            self.emit([head])
            rest -= self.size
        while rest:
            fitting = [f for f in self.free if f >= rest]
            if fitting:
                at = self.free.index(min(fitting))
            elif len(self.open) < self.windows:
                at = len(self.open)
                self.open.append([])
                self.free.append(self.size)
            else:
                at = self.free.index(min(self.free))
                head, piece = _cut(piece, self.free[at])
                self.open[at].append(head)
                self._leave(at)
                rest = len(piece[2]) // _WIDTH
                continue
            self.open[at].append(piece)
            self.free[at] -= rest
            if not self.free[at]:
                self._leave(at)
            return

    def _leave(self, at: int) -> None:
        self.emit(self.open.pop(at))
        self.free.pop(at)

    def merge(self) -> list[Piece]:
        """Join the open windows, fullest first; what does not fill a window comes back."""
        order = sorted(range(len(self.open)), key=lambda i: self.free[i])
        last = joined([p for i in order for p in self.open[i]], self.size, self.emit)
        self.open, self.free = [], []
        return last


def joined(pieces: list[Piece], size: int, emit: Callable[[list[Piece]], None]) -> list[Piece]:
    """Fill windows with pieces in their order, cutting at the windows' ends; returns the unfilled rest."""
    held, used = [], 0
    for piece in pieces:
        while used + len(piece[2]) // _WIDTH >= size:
            head, piece = _cut(piece, size - used)
            emit([*held, head])
            held, used = [], 0
        if piece[2]:
            held.append(piece)
            used += len(piece[2]) // _WIDTH
    return held


def tails(pieces: list[Piece], emit: Callable[[list[Piece]], None]) -> None:
    """Cut a rest into sequences whose lengths are powers of two, largest first: these need no padding."""
    left = sum(len(p[2]) for p in pieces) // _WIDTH
    while left:
        size = 1 << (left.bit_length() - 1)
        gone: list[list[Piece]] = []
        rest: list[Piece] = []
        used = 0
        for piece in pieces:
            n = len(piece[2]) // _WIDTH
            take = min(n, size - used)
            head, tail = _cut(piece, take)
            if take:
                gone.append(head)
            if n > take:
                rest.append(tail)
            used += take
        emit(gone)
        pieces, left = rest, left - size


class _Rows:
    """Rows of emitted windows, numbered from a base of their own."""

    def __init__(self, base: int):
        self.next, self.rows = base << 32, []

    def __call__(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // _WIDTH
            self.rows.append((doc, start, n, ids, total, self.next, offset))
            offset += n
        self.next += 1

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, end_id: int | None = 2, size: int = 4096, windows: int = 32, group: int = 64,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32 bits), doc_tokens, sequence_id, offset.

    A document is its tokenizer's ids, without special tokens, then ``end_id``.  Null and empty
    texts are that end alone (nothing, without an end).  Every id lies in exactly one piece; the
    pieces of a sequence lie one after another from offset 0.  All sequences are full except tails
    of a power of two, fewer than log2(size) + 1 for each ``group`` partitions, so nothing is padded.
    A task holds ``windows`` windows, a merging task less than ``group`` windows.  Other columns are ignored; an empty table gives an
    empty result.
    """
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_ids(path), TaskContext.get().partitionId()
        rows = _Rows(part)
        packer = Packer(size, windows, rows)

        def batch_of(taken: list[tuple], open_: bool) -> pa.RecordBatch:
            cols = list(zip(*taken)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types)), pa.array([open_] * len(taken), pa.bool_()), pa.array([part] * len(taken), pa.int32())],
                                              [*_NAMES, "open", "part"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = coder.encode(text or "") + tail
                packer.add((doc, 0, ids, len(ids) // _WIDTH))
                if len(rows.rows) > 4096:
                    yield batch_of(rows.take(), False)
        left = packer.merge()
        yield batch_of(rows.take(), False)
        rows(left)
        yield batch_of(rows.take(), True)

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["part", "offset"])
        rows = _Rows((1 << 30) + int(pieces["part"].iloc[0]) // group)
        rest = joined(list(zip(pieces["doc_id"], pieces["start"], map(bytes, pieces["ids"]), pieces["doc_tokens"])), size, rows)
        tails(rest, rows)
        return pd.DataFrame(rows.take(), columns=_NAMES)

    packed = keep(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{_SCHEMA}, open boolean, part int"), "pieces")
    rests = packed.where("open").groupBy(F.floor(F.col("part") / group).alias("_g")).applyInPandas(merge, _SCHEMA)
    return packed.where("not open").select(*_NAMES).unionByName(rests)
