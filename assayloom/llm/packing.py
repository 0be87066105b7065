"""Packing by vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs its own rows, so nothing is shuffled: ids stay where they were made. A task keeps at most
``OPEN`` unfinished sequences. A piece goes to the unfinished sequence with the largest dot product of the
piece's demand and the sequence's room (both as shares of the limits) among those that can hold it. If none can
hold it and no more may be opened, the piece is cut: its head fills the roomiest sequence. What is unfinished
at the end of a task is poured together; a last short sequence is cut into sequences whose lengths are powers
of two, which need no padding, and so is (``unpadded``, for documents) one that the limits on segments or loss close early. A
task leaves at most twelve short sequences unless those limits bind.

Defined cases: null or empty text is a document of the end id alone; repeated rows are packed each; ids of
a document of any length lie in exactly one piece each; an empty table gives an empty result; extra columns
are ignored. sequence_id is the task's number times 2^32 plus a count.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import byte_texts, lean, pieces, raw
from assayloom.llm.tokens import BATCH_BYTES, default_path, ids_for

TOKENS, SEGMENTS, OPEN = 4096, 1024, 32


@dataclass
class Piece:
    """ids[start : start + len(ids)] of an example; loss marks loss-bearing ids (None: all)."""

    key: object
    start: int
    ids: np.ndarray
    total: int
    loss: np.ndarray | None = None

    def demand(self) -> np.ndarray:
        return np.array([len(self.ids), 1, self.losses()])

    def losses(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.key, self.start, self.ids[:n], self.total, a), Piece(self.key, self.start + n, self.ids[n:], self.total, b)


@dataclass
class Sequence:
    pieces: list[Piece] = field(default_factory=list)

    @property
    def length(self) -> int:
        return sum(len(p.ids) for p in self.pieces)


class Packer:
    """Give examples to add(); finished sequences come out of add() and finish()."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, most_open: int = OPEN, unpadded: bool = False) -> None:
        self.limits, self.unpadded = np.array([tokens, segments, loss or tokens]), unpadded
        self.most_open, self.open = most_open, []
        self.room = np.empty((0, 3), np.int64)

    def _put(self, k: int, piece: Piece) -> list[Sequence]:
        self.open[k].pieces.append(piece)
        self.room[k] -= piece.demand()
        if (self.room[k] > 0).all():
            return []
        self.room = np.delete(self.room, k, axis=0)
        full = self.open.pop(k)
        return powers_of_two(full, int(self.limits[0])) if self.unpadded else [full]

    def _fit(self, piece: Piece, k: int) -> int:
        """How many leading ids of a piece sequence k can hold."""
        tokens, segments, loss = self.room[k]
        n = min(len(piece.ids), int(tokens)) if segments > 0 else 0
        if piece.loss is None:
            return min(n, int(loss))
        return int(np.searchsorted(np.cumsum(piece.loss[:n]), loss, side="right"))

    def add(self, piece: Piece) -> list[Sequence]:
        done: list[Sequence] = []
        while True:
            need = piece.demand()
            if len(self.open):
                fits = (self.room >= need).all(axis=1)
                if fits.any():
                    gain = (self.room / self.limits) @ (need / self.limits)
                    return done + self._put(int(np.argmax(np.where(fits, gain, -1))), piece)
            if len(self.open) < self.most_open:
                self.open.append(Sequence())
                self.room = np.vstack([self.room, self.limits])
                if (need <= self.limits).all():
                    return done + self._put(len(self.open) - 1, piece)
            k = int(np.argmax((self.room / self.limits).min(axis=1)))
            head, piece = piece.cut(max(1, self._fit(piece, k)))
            done += self._put(k, head)

    def finish(self) -> list[Sequence]:
        """Pour the unfinished together, then cut what is short into powers of two."""
        left = sorted(self.open, key=lambda s: s.length)
        self.open, self.room, self.most_open = [], np.empty((0, 3), np.int64), 1
        out = [s for sequence in left for p in sequence.pieces for s in self.add(p)] + self.open
        self.open, self.room = [], np.empty((0, 3), np.int64)
        return [part for s in out for part in powers_of_two(s, int(self.limits[0]))]


def powers_of_two(sequence: Sequence, limit: int) -> list[Sequence]:
    if sequence.length == limit:
        return [sequence]
    out, rest, left = [], list(sequence.pieces), sequence.length
    while left:
        want, part = 1 << (left.bit_length() - 1), Sequence()
        left -= want
        while want:
            p = rest.pop(0)
            if len(p.ids) > want:
                p, tail = p.cut(want)
                rest.insert(0, tail)
            part.pieces.append(p)
            want -= len(p.ids)
        out.append(part)
    return out


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, loss_tokens long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]


def _rows(sequences: list[Sequence], first: int):
    out = []
    for n, s in enumerate(sequences):
        at = 0
        for p in s.pieces:
            out.append((p.key, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, first + n, at, p.losses()))
            at += len(p.ids)
    columns = list(zip(*out)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _packed(rows: DataFrame, path: str | None, tokens: int, segments: int, loss: int | None, unpadded: bool = False) -> DataFrame:
    """Pack rows of (doc_id, text, bears): one example each, all of whose ids bear loss, or none."""
    path = path or default_path()

    def packed(batches):
        ids_of, packer = ids_for(path), Packer(tokens, segments, loss, unpadded=unpadded)
        at = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        for batch in batches:
            data, offsets = raw(byte_texts(batch.column("text")))
            keys, bears = batch.column("doc_id").to_pylist(), batch.column("bears").to_pylist()
            for i, j in pieces(offsets, BATCH_BYTES):
                flat, ends = ids_of.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                done: list[Sequence] = []
                for k, a, b, bear in zip(keys[i:j], ends[:-1], ends[1:], bears[i:j]):
                    # a copy, so that an unfinished piece doesn't keep the whole batch
                    done += packer.add(Piece(k, 0, flat[a:b].copy(), int(b - a), None if bear else np.zeros(b - a, bool)))
                yield _rows(done, at)
                at += len(done)
        yield _rows(packer.finish(), at)

    return rows.mapInArrow(lean(packed), _SCHEMA)


def pack_documents(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text); every id bears loss."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(True).alias("bears"))
    return _packed(rows, path, tokens, segments, None, unpadded=True)


def pack_turns(turns: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = 64, loss: int = TOKENS // 2) -> DataFrame:
    """Instruction data: one row for each piece of each row of ``turns`` (conv_id, role, text); ids of the role assistant bear loss.

    Turns are examples of their own, so a conversation of any size is packed by as many tasks as its rows lie in.
    ``doc_id`` is the conversation; all three limits hold in every sequence, and one that a limit on segments or
    loss closes early is shorter than ``tokens``.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("bears"))
    return _packed(rows, path, tokens, segments, loss)
