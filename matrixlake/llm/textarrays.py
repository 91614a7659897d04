"""Whole batches of texts as flat numpy arrays: words, word hashes and shingle hashes.

Texts are UTF-8 bytes. A word is a run of bytes other than space and tab to carriage return.
Work goes through a batch in slices of bounded bytes, so memory doesn't follow the batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_KEYS = mix(np.arange(4096, dtype=U64)) | U64(1)


def position_keys(pos: np.ndarray) -> np.ndarray:
    return _KEYS[pos] if not len(pos) or pos.max() < len(_KEYS) else mix(pos.astype(U64)) | U64(1)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) for runs of texts of about `limit` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


@dataclass
class Words:
    starts: np.ndarray  # byte position of each word
    ends: np.ndarray
    first: np.ndarray  # for each text the index of its first word; one more at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    return Words(starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit multilinear hash of each word's bytes."""
    if not len(w.starts):
        return np.zeros(0, U64)
    begin = w.starts[0]
    part = data[begin:]
    spans = np.diff(np.append(w.starts, len(data)))
    pos = np.arange(len(part)) - np.repeat(w.starts - begin, spans)
    value = np.where(pos < np.repeat(w.ends - w.starts, spans), part.astype(U64) + U64(1), U64(0))
    value *= position_keys(pos)
    return mix(np.add.reduceat(value, w.starts - begin))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; of all its words if they are fewer."""
    n = max(0, len(hashes) - size + 1)
    joined = np.zeros(n, U64)
    for k in range(size):
        joined += hashes[k : k + n] * _KEYS[k]
    joined = mix(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1])
        elif b > a:
            yield mix(np.sum(hashes[a:b] * _KEYS[: b - a], keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, U64)
