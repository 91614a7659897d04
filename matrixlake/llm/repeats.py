"""Removal of repeated strings by prefix-free parsing.

The text of the corpus is parsed into phrases that overlap, so that every string of LENGTH bytes lies whole in exactly one.
A rolling hash of GRAM bytes triggers a phrase wherever it is the least within some window of LENGTH bytes; the
phrase holds just the windows whose trigger it is. Triggers depend on the window alone, so equal windows have equal
triggers, and the dictionary of distinct phrases is small where the corpus repeats itself.

Phrases go to buckets by trigger, first as fingerprints of themselves and of what lies beside the trigger, with their
places. These only choose: a phrase whose fingerprints occur once in all of the corpus shares no window. All others are
asked for their bytes. Then each bucket holds a part of the dictionary, whose phrases are told apart by their bytes, and
of the parse, the places of each phrase in corpus order (doc_id, then place). A later place of a phrase is a repeat as a
whole. Of phrases that share a side of their trigger with others, the suffixes of LENGTH bytes and more are put in order
by doubling: the part of the dictionary's suffix array that holds the bucket's triggers. Equal strings stand side by side
there; the parse puts them in corpus order, and all but the first are repeats. So the suffix arrays of dictionary
and parse are cut by trigger instead of standing in one place, and every match is one of bytes. Each task keeps its own
dictionary first, so a phrase that occurs very often leaves a task once.

A window is a repeat if an equal one starts earlier: in a smaller doc_id, or earlier in the same text. All bytes of
repeats go. Windows never cross texts and are judged on the input.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing; rows of one doc_id are texts of their own,
neither of which is earlier than the other at the same place; a null doc_id comes before all others; an empty table gives
no rows; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs, textarrays as ta
from .common import partitions, staged

U64 = np.uint64
NULL_ID = -(1 << 63)
GRAM, FLUSH = 24, 300_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = ta.mix(np.arange(256, dtype=U64) + U64(1 << 20))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, x in (("up", BASE), ("down", INVERSE)):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, x, U64)]), dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


class Spans:
    """Rolling hashes of any spans of a run of bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(BYTE[data] * up[:-1], dtype=U64)])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return ta.mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def phrases(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts the trigger, first window, number of windows and text of each phrase."""
    spans, n = Spans(data), len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return spans, none, none, none, none
    at = np.arange(n - GRAM + 1)
    low = (spans.hash(at, GRAM) >> U64(32) << U64(32)) | at.astype(U64)  # the least hash; among equals the first
    width, have = length - GRAM + 1, 1
    while have < width:  # minima over runs of doubling length
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    last = offsets[1:] - length  # of each text the last window
    whole = np.flatnonzero(last >= offsets[:-1])
    count = last[whole] - offsets[:-1][whole] + 1
    start = np.repeat(offsets[:-1][whole] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    text = np.repeat(whole, count)
    trigger = (low[start] & U64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])])) if len(start) else none
    return spans, trigger[cut], start[cut], np.diff(np.append(cut, len(start))), text[cut]


#: key, phrase, left, right, doc, tag, first window, windows. Bucket and key are different bits of the trigger's hash.
RECORD = ["u4", "u4", "u2", "u2", "i8", "u4", "u4", "u1"]
#: doc, tag, first window, windows times four plus what is known of them, bucket that asks for the phrase.
REPLY = ["i8", "u4", "u4", "u2", "u4"]
#: Repeats; may be a repeat as a whole; may also hold windows of other phrases.
SURE, WHOLE, OPEN = 0, 1, 2
#: doc, tag, first window, windows, 1 if it is open plus 2 if the task has settled later places; the bytes of the phrases follow.
ENTRY = ["i8", "u4", "u4", "u1", "u1"]
#: What moves: blocks of phrases, as fingerprints or bytes, of replies, and of documents.
BLOCKS = "bucket int, kind int, block binary"
PHRASES, REPLIES, TEXTS = 0, 1, 2
TEXT_BYTES, SAME_BYTES, ORDER_BYTES = 16 << 20, 1 << 20, 1 << 20


def place(doc: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return (doc ^ (doc >> 17)) % buckets


def _later(doc: np.ndarray, at: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether a record comes after the first of its run; same: it continues the run of the one before."""
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    return same & ((doc != doc[first]) | (at != at[first]))


def flat(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of spans, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether spans from a and from b hold the same bytes, a bounded number at a time."""
    out = np.ones(len(a), bool)
    step = max(1, SAME_BYTES // int(max(length, default=1)))
    for i in range(0, len(a), step):
        n = length[i : i + step]
        equal = data[flat(a[i : i + step], n)] == data[flat(b[i : i + step], n)]
        out[i : i + step] = np.logical_and.reduceat(equal, np.concatenate([[0], np.cumsum(n)[:-1]]))
    return out


class Dictionary:
    """Phrases, told apart by their bytes, with their places in corpus order (the parse).

    In `order` the phrases' places run by phrase and then by corpus; `same`: a place is of the phrase of the one before;
    `later`: it comes after the first of them; `first`: the first of them.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, mark: np.ndarray, doc: np.ndarray, at: np.ndarray, tag: np.ndarray):
        self._sort([tag, at, doc, length, mark], 3)
        order = self.order
        more = np.flatnonzero(self.same)
        other = more[~same_bytes(data, start[order[more]], start[order[self.first[more]]], length[order[more]])]
        if len(other):  # equal marks of other bytes: those runs are sorted by their bytes
            fine, ids = np.zeros(len(order), np.int64), {}
            for i in order[np.isin(self.first, self.first[other])].tolist():
                fine[i] = ids.setdefault(data[start[i] : start[i] + length[i]].tobytes(), len(ids) + 1)
            self._sort([tag, at, doc, fine, length, mark], 3)
        self.later = _later(doc[self.order], at[self.order], self.same)

    def _sort(self, keys: list[np.ndarray], places: int) -> None:
        self.order = np.lexsort(keys)
        named = [k[self.order] for k in keys[places:]]
        self.same = np.zeros(len(self.order), bool)
        self.same[1:] = np.logical_and.reduce([k[1:] == k[:-1] for k in named])
        self.first = np.maximum.accumulate(np.where(self.same, 0, np.arange(len(self.same)))) if len(self.same) else np.zeros(0, np.int64)


def ranks(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The suffix order of a run of phrases, by doubling: of each place the rank of the `length` bytes from there.

    ends: of each place the end of its phrase; -1 where it is nearer than that.
    """
    n, have = len(data), 8
    left, wide, key = ends - np.arange(n), np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64), np.zeros(n, U64)
    for k in range(8):
        key = key << U64(8) | wide[k : k + n]
    at = np.flatnonzero(left >= have)
    rank = np.full(n, -1, np.int64)
    rank[at] = np.unique(key[at], return_inverse=True)[1]
    while have < length:
        step = min(have, length - have)
        at = np.flatnonzero(left >= have + step)
        pair = rank[at].astype(U64) << U64(32) | rank[at + step].astype(U64)
        rank = np.full(n, -1, np.int64)
        rank[at] = np.unique(pair, return_inverse=True)[1]
        have += step
    return rank


def _batches(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 64):
        part = rows[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["bucket", "kind", "block"])


def _blocks(kind: int, fields: list[np.ndarray], bucket: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(b, kind, block) for b, block in blobs.pack(fields, bucket)]


def _replies(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, count: np.ndarray, flag: np.ndarray | int, buckets: int, asks: int = 0) -> list[tuple[int, int, bytes]]:
    packed = ((count.astype(np.int64) - 1) * 4 + flag).astype(np.uint16)
    return _blocks(REPLIES, [doc, tag, at, packed, np.full(len(doc), asks, np.uint32)], place(doc, buckets))


def _text_blocks(rows: pa.Table, buckets: int) -> list[tuple[int, int, bytes]]:
    """Documents by bucket, compressed."""
    bucket = place(rows.column("doc").to_numpy(), buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows.take(pa.array(order)), bucket[order]
    cuts, out = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])), []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
            f.write_table(rows.slice(a, b - a).combine_chunks())
        out.append((int(bucket[a]), TEXTS, sink.getvalue().to_pybytes()))
    return out


def _sort_texts(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= TEXT_BYTES:
                yield from _batches(_text_blocks(pa.Table.from_batches(held), buckets))
                held, size = [], 0
        if held:
            yield from _batches(_text_blocks(pa.Table.from_batches(held), buckets))

    return work


def _parse(length: int, buckets: int):
    """Blocks of phrase records by trigger, and of replies for phrases that the task itself met before."""
    half = (length - GRAM) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        texts: list[np.ndarray] = []
        size = taken = 0

        def flush() -> list[tuple[int, int, bytes]]:
            start, bucket, *fields = (np.concatenate(f) for f in zip(*held, strict=True))
            _, phrase, _, _, doc, tag, at, count = fields
            known = Dictionary(np.concatenate(texts), start, count.astype(np.int64) + length - 1, phrase, doc, at, tag)
            later = np.zeros(len(doc), bool)
            later[known.order] = known.later
            fields[1] = (phrase >> U64(32)).astype(np.uint32)
            out = _blocks(PHRASES, [f[~later] for f in fields], bucket[~later])  # in order of documents, which compresses better
            return out + _replies(doc[later], tag[later], at[later], count[later], SURE, buckets)

        for batch in batches:
            docs, tags = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("tag").to_numpy(zero_copy_only=False).astype(np.uint32)
            for i, data, offsets in ta.slices(batch.column("text")):
                spans, trigger, start, count, text = phrases(data, offsets, length)
                if not len(trigger):
                    continue
                key = spans.hash(trigger, GRAM)
                before = trigger - start  # bytes of the first window before the trigger
                after = before - count + 1  # and of the last window
                left = np.where(before >= half, spans.hash(np.maximum(trigger - half, 0), half + GRAM) >> U64(48) | U64(1), U64(0))
                reach = np.minimum(trigger + GRAM + half, len(data)) - trigger
                right = np.where(after < half, spans.hash(trigger, reach) >> U64(48) | U64(1), U64(0))
                phrase = spans.hash(start, count + length - 1) + before.astype(U64) * U64(0xD6E8FEB86659FD93)
                bucket = (key & U64(0xFFFFFFFF)) % U64(buckets)
                held.append([start + taken, bucket.astype(np.int64), (key >> U64(32)).astype(np.uint32), phrase, left.astype(np.uint16), right.astype(np.uint16), docs[i + text], tags[i + text], (start - offsets[text]).astype(np.uint32), count.astype(np.uint8)])
                texts.append(data)
                size, taken = size + len(key), taken + len(data)
                if size >= FLUSH:
                    yield from _batches(flush())
                    held.clear()
                    texts.clear()
                    size = taken = 0
        if held:
            yield from _batches(flush())

    return work


def _received(batches: Iterator[pa.RecordBatch], kind: int, parts: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Collects blocks of this kind by bucket in parts and lets others through."""
    for batch in batches:
        own = np.asarray(batch.column("kind")) == kind
        mine = batch.filter(pa.array(own))
        for bucket, block in zip(mine.column("bucket").to_pylist(), mine.column("block").to_pylist(), strict=True):
            parts.setdefault(bucket, []).append(block)
        if not own.all():
            yield batch.filter(pa.array(~own))


def _choose(buckets: int):
    """Replies to the documents: the phrases whose fingerprints are those of others too, so that their bytes are wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        yield from _received(batches, PHRASES, parts)
        for bucket in list(parts):
            key, phrase, left, right, doc, tag, at, count = blobs.unpack(parts.pop(bucket), RECORD)
            order = np.lexsort((tag, at, doc, right, left, count, phrase, key))
            key, phrase, left, right, doc, tag, at, count = (f[order] for f in (key, phrase, left, right, doc, tag, at, count))
            go_on = lambda x: np.concatenate([[False], x[1:] == x[:-1]])
            same = go_on(key) & go_on(phrase) & go_on(count) & go_on(left) & go_on(right)
            run = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
            flag = np.zeros(len(doc), np.int64)
            flag[run[_later(doc, at, same)]] = WHOLE
            first, group = np.flatnonzero(~same), np.cumsum(~go_on(key))  # one of each phrase stands for it
            for side in (left, right):
                some = first[side[first] != 0]
                some = some[np.lexsort((side[some], group[some]))]
                agree = (group[some][1:] == group[some][:-1]) & (side[some][1:] == side[some][:-1])
                flag[some[1:][agree]] = flag[some[:-1][agree]] = OPEN
            flag = flag[run]
            asked = flag > 0
            yield from _batches(_replies(doc[asked], tag[asked], at[asked], count[asked], flag[asked], buckets, bucket))

    return work


KEPT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.BinaryType())])


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[new], np.append(reach[new[1:] - 1], reach[-1])


def remove(text: bytes, starts: np.ndarray, ends: np.ndarray, keep: bool) -> tuple[int, int, int, str, bytes | None]:
    starts, ends = covered(starts, ends)
    pieces, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        pieces.append(text[at:a])
        at = b
    kept = b"".join([*pieces, text[at:]])
    whole = kept.decode("utf-8", "ignore").encode() if keep else None  # what is left of characters that were cut goes too
    return len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), whole


class Answers:
    """Replies of one bucket, by document."""

    def __init__(self, blocks: list[bytes]):
        doc, tag, at, count, asks = blobs.unpack(blocks, REPLY)
        order = np.lexsort((tag, doc))
        self.doc, self.tag, self.at, self.count, self.asks = (x[order] for x in (doc, tag, at.astype(np.int64), count.astype(np.int64), asks))

    def of(self, doc: int, tag: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First windows, windows, what is known, and who asks."""
        a, b = np.searchsorted(self.doc, doc, "left"), np.searchsorted(self.doc, doc, "right")
        a, b = a + np.searchsorted(self.tag[a:b], tag, "left"), a + np.searchsorted(self.tag[a:b], tag, "right")
        return self.at[a:b], (self.count[a:b] >> 2) + 1, self.count[a:b] & 3, self.asks[a:b]


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Answers]]:
    """Blocks of documents with the replies of their bucket, which come before them."""
    bucket, replies, answers = None, [], None
    for batch in batches:
        for b, kind, block in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "block")), strict=True):
            if b != bucket:
                bucket, replies, answers = b, [], None
            if kind == REPLIES:
                replies.append(block)
            else:
                answers = answers or Answers(replies)
                for rows in pa.ipc.open_stream(block):
                    yield rows, answers


def _done(rows: list[tuple], rest: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """Finished documents: (doc, n_bytes, n_removed, n_spans, sha256, kept) with the rest of their rows."""
    columns = dict(zip(["doc", *KEPT.names], zip(*rows, strict=True), strict=True)) | {"rest": pa.concat_arrays(rest)}
    return pa.RecordBatch.from_arrays([columns["rest"] if f.name == "rest" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in schema], schema=schema)


def _entries(fields: list[np.ndarray], data: np.ndarray, start: np.ndarray, length: np.ndarray, bucket: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Blocks of phrases with their bytes, compressed."""
    order, out, zstd = np.argsort(bucket, kind="stable"), [], zstandard.ZstdCompressor(level=3)
    bucket, start, length, fields = bucket[order], start[order], length[order], [f[order] for f in fields]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        raw = b"".join(blobs.planes(f[a:b]) for f in fields) + data[flat(start[a:b], length[a:b])].tobytes()
        out.append((int(bucket[a]), PHRASES, np.uint32(b - a).tobytes() + zstd.compress(raw)))
    return out


def _entries_of(blocks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    fields, texts, zstd = [[] for _ in ENTRY], [], zstandard.ZstdDecompressor()
    for block in blocks:
        n, raw, at = int(np.frombuffer(block, "<u4", 1)[0]), zstd.decompress(block[4:]), 0
        for part, kind in zip(fields, ENTRY, strict=True):
            part.append(blobs.numbers(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        texts.append(np.frombuffer(raw, np.uint8, offset=at))
    return [np.concatenate(f) for f in fields], np.concatenate(texts)


def _apply(length: int, keep: bool, buckets: int, schema: pa.Schema):
    """Finished documents; of the others blocks of their texts with what is known, and of the phrases that are asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        asked: list[np.ndarray] = []
        size = taken = 0

        def flush() -> list[tuple[int, int, bytes]]:
            start, mark, doc, tag, at, count, open_, bucket = (np.concatenate(f) for f in zip(*held, strict=True))
            data, long_ = np.concatenate(asked), count + length - 1
            known = Dictionary(data, start, long_, mark, doc, at, tag)
            later = np.zeros(len(doc), bool)
            later[known.order] = known.later
            open_[known.order[known.first[known.later]]] |= 2
            one = ~later  # an open phrase is open wherever it stands, so its first place is too
            out = _entries([doc[one], tag[one], at[one].astype(np.uint32), count[one].astype(np.uint8), open_[one]], data, start[one], long_[one], bucket[one])
            return out + _replies(doc[later], tag[later], at[later].astype(np.uint32), count[later], SURE, buckets)

        def moved(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for batch in _batches(rows):
                yield pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in ("bucket", "kind", "block") else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)

        for rows, answers in _answered(batches):
            done, known, wait = [], [], np.zeros(rows.num_rows, bool)
            texts = rows.column("text")
            for i, (doc, tag) in enumerate(zip(rows.column("doc").to_pylist(), rows.column("tag").to_pylist(), strict=True)):
                at, count, flag, asks = answers.of(doc, tag)
                sure, ask = flag == SURE, flag != SURE
                spans = at[sure], at[sure] + count[sure] - 1 + length
                text = texts[i].as_py()
                if ask.any():
                    wait[i] = True
                    data, k = np.frombuffer(text, np.uint8), int(ask.sum())
                    mark = Spans(data).hash(at[ask], count[ask] + length - 1)
                    held.append([at[ask] + taken, mark, np.full(k, doc), np.full(k, tag, np.uint32), at[ask], count[ask], (flag[ask] == OPEN).astype(np.uint8), asks[ask].astype(np.int64)])
                    asked.append(data)
                    size, taken = size + k, taken + len(data)
                    known.append(np.column_stack(covered(*spans)).astype("<i8").tobytes())
                else:
                    done.append((doc, *remove(text, *spans, keep)))
            if done:
                yield _done(done, [rows.column("rest").filter(pa.array(~wait))], schema)
            if known:
                part = pa.Table.from_batches([rows.filter(pa.array(wait))]).append_column("known", pa.array(known, pa.binary()))
                yield from moved(_text_blocks(part, buckets))
            if size >= FLUSH or taken >= TEXT_BYTES:
                yield from moved(flush())
                held, asked, size, taken = [], [], 0, 0
        if held:
            yield from moved(flush())

    return work


def _compare(length: int, buckets: int):
    """Replies for the windows that occur earlier, by the bucket's part of the dictionary, its suffix order and the parse."""

    def found(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        (doc, tag, at, count, open_), data = _entries_of(blocks)
        count = count.astype(np.int64)
        long_ = count + length - 1
        start = np.cumsum(long_) - long_
        mark, trigger = np.zeros(len(doc), U64), np.zeros(len(doc), U64)
        cuts = [0, *np.searchsorted(start, np.arange(ta.SLICE_BYTES, len(data), ta.SLICE_BYTES)).tolist(), len(doc)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                spans, at_ = Spans(data[start[a] : start[b - 1] + long_[b - 1]]), start[a:b] - start[a]
                mark[a:b] = spans.hash(at_, long_[a:b])
                trigger[a:b] = (spans.hash(at_[:, None] + np.arange(length - GRAM + 1), GRAM) >> U64(32)).min(1)
        known = Dictionary(data, start, long_, mark, doc, at, tag)
        order, later = known.order, known.later
        whole = order[later]
        yield from _batches(_replies(doc[whole], tag[whole], at[whole], count[whole], SURE, buckets))

        # the suffixes of open phrases, each phrase once, in their own order and then in corpus order
        lead = np.flatnonzero(~known.same)
        state = np.bitwise_or.reduceat(open_[order], lead)
        wide = state & 1 > 0
        if ((state == 0) & (np.diff(np.append(lead, len(order))) == 1)).any():  # it met another by fingerprint only: all are compared
            wide[:] = True
        lead = lead[wide]
        one = order[lead]
        if not len(one):
            return
        # equal windows have equal triggers, so whole triggers go to the order together, a bounded number of bytes at a time
        by = np.argsort(trigger[one], kind="stable")
        twins = np.add.reduceat(~later, np.flatnonzero(~known.same), dtype=np.int64)[wide]
        one, lead, twins = one[by], lead[by], twins[by]
        size = np.cumsum(long_[one])
        new = np.concatenate([[0], np.flatnonzero(np.diff(trigger[one])) + 1, [len(one)]])
        at_ = 0
        for edge, after in zip(new[1:].tolist(), [*new[2:].tolist(), None], strict=True):
            if after is None or size[after - 1] - (size[at_ - 1] if at_ else 0) > ORDER_BYTES:
                yield from ordered(one[at_:edge], lead[at_:edge], twins[at_:edge], order, doc, tag, at, count, long_, start, data)
                at_ = edge

    def ordered(one, lead, twins, order, doc, tag, at, count, long_, start, data) -> Iterator[pa.RecordBatch]:
        part, ends = data[flat(start[one], long_[one])], np.cumsum(long_[one])
        rank = ranks(part, np.repeat(ends, long_[one]), length)
        phrase = np.repeat(np.arange(len(one)), count[one])
        offset = flat(np.zeros(len(one), np.int64), count[one])
        rank, where = rank[flat(ends - long_[one], count[one])], at[one][phrase].astype(np.int64) + offset
        suffixes = np.lexsort((where, doc[one][phrase], rank))
        repeat = np.zeros(len(rank), bool)
        repeat[suffixes] = _later(doc[one][phrase][suffixes], where[suffixes], np.concatenate([[False], rank[suffixes][1:] == rank[suffixes][:-1]]))
        # runs of repeated windows of a phrase, for all rows at its first place
        head = np.flatnonzero(repeat & np.concatenate([[True], ~repeat[:-1] | (phrase[1:] != phrase[:-1])]))
        tail = np.flatnonzero(repeat & np.concatenate([~repeat[1:] | (phrase[1:] != phrase[:-1]), [True]]))
        for twin in range(int(twins.max())):  # more than one only where rows share an id and a place
            some = twins[phrase[head]] > twin
            mine = order[lead[phrase[head][some]] + twin]
            yield from _batches(_replies(doc[mine], tag[mine], where[head][some].astype(np.uint32), (tail - head + 1)[some], SURE, buckets))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        yield from _received(batches, PHRASES, parts)
        for bucket in list(parts):
            yield from found(parts.pop(bucket))

    return work


def _finish(length: int, keep: bool, schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, answers in _answered(batches):
            done = []
            for doc, tag, text, known in zip(*(rows.column(c).to_pylist() for c in ("doc", "tag", "text", "known")), strict=True):
                at, count, _, _ = answers.of(doc, tag)
                sure = np.frombuffer(known, "<i8").reshape(-1, 2)
                done.append((doc, *remove(text, np.concatenate([sure[:, 0], at]), np.concatenate([sure[:, 1], at + count - 1 + length]), keep)))
            yield _done(done, [rows.column("rest")], schema)

    return work


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def deduplicated(docs: DataFrame, length: int = 100, keep: bool = False) -> DataFrame:
    """doc_id, rest (the other columns as a struct), n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (whole characters)."""
    n = partitions(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others and keep else F.struct(F.lit(0).alias("none"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    # rows that share an id are told apart by their texts; where none do, nothing need be sent along
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    tag = F.crc32(text) if shared else F.lit(0).cast("bigint")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc"), tag.alias("tag"), text.alias("text"), rest.alias("rest"))

    sent = rows.select("doc", "tag", F.col("text").cast("string").alias("text")).mapInArrow(_parse(length, n), BLOCKS)
    told = sent.repartitionById(n, F.col("bucket")).mapInArrow(_choose(n), BLOCKS)
    texts = rows.mapInArrow(_sort_texts(n), BLOCKS)

    def meet(told: DataFrame, texts: DataFrame) -> DataFrame:
        """Replies and documents by bucket, replies first."""
        return told.union(texts).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "kind")

    kind = rows.schema["rest"].dataType
    last = T.StructType([T.StructField("doc", T.LongType()), T.StructField("rest", kind), *KEPT.fields])
    moved = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("block", T.BinaryType())])
    first = T.StructType([*last.fields, *moved.fields])
    half = staged(meet(told, texts).mapInArrow(_apply(length, keep, n, _arrow(first)), first), "repeats")

    told = half.filter(F.col("kind").isin(PHRASES, REPLIES)).select(*moved.names).repartitionById(n, F.col("bucket")).mapInArrow(_compare(length, n), BLOCKS)
    rest_rows = meet(told, half.filter(F.col("kind") == TEXTS).select(*moved.names)).mapInArrow(_finish(length, keep, _arrow(last)), last)
    out = half.filter("kind is null").select(*last.names).unionByName(rest_rows)
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "rest", *KEPT.names)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with repeats cut from their texts, n_chars (if there) counted anew; a text of which nothing is left goes."""
    out = deduplicated(docs, length, keep=True).filter((F.length("kept") > 0) | (F.col("n_bytes") == 0))
    text = F.col("kept").cast("string")
    own = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("bigint")}
    return out.select(*[own.get(c, F.col(f"rest.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
