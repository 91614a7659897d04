"""Packing of documents into token windows by best-fit decreasing.

Overlong documents are first cut into full windows. The rests, longest first, each go to the open window with the least
room that still holds it; a segment tree indexed by remaining room finds it. What best fit leaves loose is cut: windows
whose gap is at least LOOSE ids are filled from the emptiest ones. At most one window of a task stays open in the end;
it is split into sequences of powers of two, which need no padding.

A task packs GROUP rests at a time and carries the last open window on, so memory is bounded and nothing is shuffled.
Defined results: a null or empty text is its end id alone; repeated rows are packed each by itself; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

WINDOW, GROUP, LOOSE = 1024, 16_384, 16
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
Piece = tuple  # doc_id, start, ids as bytes, ids of the document


class RoomTree:
    """Open windows by remaining room; finds the least room that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def _mark(self, room: int) -> None:
        i, now = self.size + room, bool(self.windows[room])
        while i and self.any[i] != now:
            self.any[i] = now
            i >>= 1
            now = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._mark(room)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window for `length`; it leaves the tree."""
        i = self.size + length
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1  # the subtree next to the right
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.size
        window = self.windows[room].pop()
        self._mark(room)
        return room, window


def best_fit(pieces: list[Piece], capacity: int = WINDOW) -> list[list[Piece]]:
    """Pieces in windows, by best-fit decreasing."""
    tree, out = RoomTree(capacity), []
    for piece in sorted(pieces, key=lambda p: (-len(p[2]), p[0] is not None, p[0] or 0, p[1])):
        n = len(piece[2]) // 4
        room, at = tree.take(n) or (capacity, len(out))
        if at == len(out):
            out.append([])
        out[at].append(piece)
        if room > n:
            tree.add(room - n, at)
    return out


def fill(window: list[Piece]) -> int:
    return sum(len(p[2]) for p in window) // 4


def cut(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * n], total), (doc, start + n, ids[4 * n :], total)


def tighten(windows: list[list[Piece]], capacity: int = WINDOW, loose: int = LOOSE) -> tuple[list[list[Piece]], list[Piece]]:
    """Fills loose windows from the emptiest; returns windows, and the pieces of one that stays open."""
    done = [w for w in windows if capacity - fill(w) < loose]
    open_ = sorted((w for w in windows if capacity - fill(w) >= loose), key=fill, reverse=True)
    while len(open_) > 1:
        window, gap = open_[0], capacity - fill(open_[0])
        while gap and len(open_) > 1:
            giver = open_[-1]
            piece = giver.pop()
            if len(piece[2]) // 4 > gap:
                piece, rest = cut(piece, gap)
                giver.append(rest)
            window.append(piece)
            gap -= len(piece[2]) // 4
            if not giver:
                open_.pop()
        if gap == 0:
            done.append(open_.pop(0))
    return done, open_[0] if open_ else []


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces as sequences of falling powers of two."""
    left, rest = fill(pieces), list(pieces)
    while left:
        n, part = 1 << (left.bit_length() - 1), []
        left -= n
        while n:
            piece = rest.pop(0)
            if len(piece[2]) // 4 > n:
                piece, more = cut(piece, n)
                rest.insert(0, more)
            part.append(piece)
            n -= len(piece[2]) // 4
        yield part


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """The pieces of all docs(doc_id, text), each with its sequence and place there."""
    end = struct.pack("<I", end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rests, out = Encoder.of(tokenizer), [], []
        state = {"next": TaskContext.get().partitionId() << 32}

        def put(pieces: list[Piece]) -> None:
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                out.append((doc, start, n, zlib.crc32(ids), total, state["next"], at))
                at += n
            state["next"] += 1

        def settle(last: bool) -> None:
            done, open_ = tighten(best_fit(rests, window), window)
            rests.clear()
            for w in done:
                put(w)
            if last:
                for w in powers(open_) if window - fill(open_) >= LOOSE else [open_]:
                    put(w)
            else:
                rests.extend(open_)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 500):
                for doc, raw in zip(ids[i : i + 500], encoder.encode(texts[i : i + 500].to_pylist()), strict=True):
                    raw += end
                    total = len(raw) // 4
                    whole = total // window * window
                    for a in range(0, whole, window):
                        put([(doc, a, raw[4 * a : 4 * (a + window)], total)])
                    if total > whole:
                        rests.append((doc, whole, raw[4 * whole :], total))
                if len(rests) >= group:
                    settle(False)
                if len(out) >= 8192:
                    yield _pieces(out)
                    out.clear()
        if rests:
            settle(True)
        if out:
            yield _pieces(out)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=names)
