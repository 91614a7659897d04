"""Rows of numbers that move between tasks as packed blocks: one row a bucket and flush instead of one a record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def pack(fields: list[np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, its records, field after field) for each bucket that has some."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket, fields = bucket[order], [f[order] for f in fields]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(bucket[a]), b"".join(planes(f[a:b]) for f in fields)


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on; long integers as differences, which are mostly small."""
    if x.dtype == np.int64 and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def numbers(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()
    return np.cumsum(x) if x.dtype == np.int64 else x


def unpack(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // sum(widths), 0
        for part, kind, width in zip(parts, kinds, widths, strict=True):
            part.append(numbers(blob, kind, n, at))
            at += n * width
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, kinds, strict=True)]
