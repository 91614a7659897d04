"""N-gram Jaccard join: size-banded tiles of documents, bitmap bounds, then exact intersection.

A document is the set of hashes of its word n-grams. Equal sets are one class from the start. Two sets within the
threshold differ in at most k shingles, k following from the size of the smaller; cut the space of hashes into more
than k parts and they agree on one part at least. So each class sends a signature of each part that isn't empty, for its
own size band and for the one below where partners can be; classes that share a signature are candidates. Small sets,
whose parts hold few shingles, have two parts more than that and send signatures of every two parts, so that one
frequent shingle alone brings nobody together. (A class with too many empty parts also sends its first shingles, one
by one or two by two, which is enough for two such classes to meet.)

A group of classes that share a signature is one tile if it fits; tiles are bounded in rows and in bytes. A larger group
is cut into blocks, and each block makes a tile with the same few pivots of the group: members of near copies are then
connected through the pivots, and the work grows with the group, not with its square. Only where members of a large
group are still apart after that, every two of its blocks that aren't one component already meet in a tile, so no pair is
missed. In a tile, parity bitmaps of hashed shingles bound the overlap from above: the bits in which two differ are at
most their differing shingles. What passes is gathered by connection and tiled in the same way, with the sets
themselves, and intersected exactly. A tile links each document as it is reached, so a group of n near copies costs about
n tests and gives n - 1 links, never all pairs.

Defined results: null or empty texts, and texts without words, have empty sets and link with nothing; with fewer words
than n the whole sequence is one shingle; repeated rows link when their sets are equal; a null doc_id counts as the smallest id;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blobs, textarrays as ta
from .common import discard, few, partitions, scratch, staged
from .graphs import components

U64 = np.uint64
NULL_ID = -(1 << 63)
TILE_ROWS, TILE_BYTES, PIVOTS, FLUSH = 1024, 8 << 20, 48, 1_000_000
BAND_GROWTH = 1.5
#: Sets that may differ in so many shingles at most send signatures of every two parts.
PAIRED = 6
BAND_BITS = 7
#: Rows of two numbers that are sent to all tasks at most, 2 MB; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Shingles that are intersected with a set at once.
MEET = 1 << 17


def bands(num: int, den: int, growth: float, top: int = 1 << 40) -> list[int]:
    """First sizes of size bands."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, math.floor(out[-1] * growth)))
    return out


class Signer:
    """The signatures of a set under the threshold num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = np.array(bands(num, den, BAND_GROWTH))
        high = self.low[1:] - 1
        self.differ = high * (den - num) // num  # by so many shingles at most, for a smaller set of this band
        self.parts = self.differ + np.where(self.differ > 0, 1 + np.maximum(2, np.ceil(self.differ * 0.15).astype(int)), 1)

    def sign(self, h: np.ndarray) -> np.ndarray:
        """Signatures; the lowest bits of each name its size band."""
        n, out = len(h), []
        own = band = int(np.searchsorted(self.low, n, "right")) - 1
        mixed = ta.mix(h)
        while band >= 0 and (band == own or (self.low[band + 1] - 1) * self.den >= n * self.num):
            m, k = int(self.parts[band]), int(self.differ[band])
            part = ((h >> U64(32)) * U64(m)) >> U64(32)  # h is sorted, so parts are runs of it
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            label = U64((band * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)
            marks = [ta.mix(np.add.reduceat(mixed, starts) + ta.mix(part[starts] + label))]
            paired = 1 if 0 < k <= PAIRED else 0  # of m parts at least m - k > 2 agree then
            if len(starts) <= k + paired:
                marks.append(ta.mix(ta.mix(h[: k + 1 + paired] ^ label) + U64(77)))
            for x in marks:
                if paired:
                    i, j = np.triu_indices(len(x), 1)
                    x = ta.mix(x[i] + ta.mix(x[j]))
                out.append(x >> U64(BAND_BITS) << U64(BAND_BITS) | U64(band))
            band -= 1
        return np.concatenate(out)


def digests(h: np.ndarray) -> tuple[int, int]:
    """Two 63-bit digests of a set."""
    a, b = ta.mix(h ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), ta.mix(h ^ U64(0x14057B7EF767814F)).sum(dtype=U64)
    return int(a >> U64(1)), int(b >> U64(1))


def sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for i, data, offsets in ta.slices(column):
        low = ta.LOWER[data]
        w = ta.words(low, offsets)
        for j, h in enumerate(ta.shingles(ta.word_hashes(low, w), w.first, words)):
            yield i + j, h


def _profile(words: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = [], [], []
            for _, h in sets(batch.column("text"), words):
                d1, d2 = digests(h)
                n.append(len(h))
                a.append(d1)
                b.append(d2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["doc_id", "tag", "n", "d1", "d2"])

    return work


def _signatures(words: int, num: int, den: int, buckets: int):
    """Blocks of (signature, digest), each class once a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = Signer(num, den), set()
        keys, owners, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(keys)
            owner = np.repeat(np.array([o for o, _ in owners], np.int64), [c for _, c in owners])
            packed = list(blobs.pack([key, owner], (key >> U64(40)).astype(np.int64) % buckets))
            for i in range(0, len(packed), 64):
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed[i : i + 64]], pa.int32()), pa.array([p[1] for p in packed[i : i + 64]], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for _, h in sets(batch.column("text"), words):
                d1 = digests(h)[0]
                if not len(h) or d1 in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(d1)
                keys.append(signer.sign(h))
                owners.append((d1, len(keys[-1])))
                held += len(keys[-1])
                if held >= FLUSH:
                    yield from flush()
                    keys, owners, held = [], [], 0
        if held:
            yield from flush()

    return work


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each bucket; rows come sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(block)
    if held:
        yield held


def _meet(low: np.ndarray):
    """Members of each group of classes that share a signature, by tile; equal groups of a task once."""
    bitmaps = np.array([width(int(min(n, 1 << 40))) // 8 for n in low])
    holds, most = np.clip(TILE_BYTES // bitmaps, 8, TILE_ROWS), PIVOTS  # sets that a tile holds, by band

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for blocks in _by_bucket(batches):
            key, owner = blobs.unpack(blocks, ["u8", "i8"])
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[fresh], owner[fresh]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(starts, len(key)))
            group = (np.add.reduceat(ta.mix(owner.astype(U64)), starts) >> U64(1)).astype(np.int64)
            _, first = np.unique(group, return_index=True)
            keep = np.zeros(len(starts), bool)
            keep[first] = True
            keep &= count > 1
            if len(told) < 1_000_000:
                keep &= np.array([g not in told for g in group.tolist()], bool)
                told.update(group[keep].tolist())
            band = (key[starts] & U64((1 << BAND_BITS) - 1)).astype(np.int64)
            fits = holds[np.minimum(band + 2, len(holds) - 1)]  # partners are less than two bands larger
            parts = np.where(count <= 2 * fits, 1, -(-count // fits))
            rows = np.repeat(keep, count)
            root, d1, n = np.repeat(group, count)[rows], owner[rows], np.repeat(parts, count)[rows]
            block = (ta.mix(d1.astype(U64)) % n.astype(U64)).astype(np.int64)
            yield from _members(root, block, d1, n)
            for g in np.flatnonzero(keep & (parts > 1)).tolist():  # the pivots of a large group are in all of its tiles
                mine = owner[starts[g] : starts[g] + count[g]][:most]
                all_ = np.arange(parts[g])
                yield from _members(np.full(len(mine) * len(all_), group[g]), np.repeat(all_, len(mine)), np.tile(mine, len(all_)), np.full(len(mine) * len(all_), parts[g]))

    return work


TILES = "root bigint, block bigint, d1 bigint, blocks bigint"


def _members(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000], pa.int64()) for c in columns], names=["root", "block", "d1", "blocks"])


def _tested(num: int, den: int, exact: bool):
    """Links within each tile; rows come sorted by tile."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        now, held = None, {}

        def close() -> None:
            if len(held) > 1:
                n = [x[0] for x in held.values()]
                bits = [x[1] for x in held.values()]
                found = [np.frombuffer(x[2], U64) for x in held.values()] if exact else None
                out.extend(links(list(held), np.array(n), bits, found, num, den))

        for batch in batches:
            for root, block, d1, *row in zip(*(batch.column(c).to_pylist() for c in ("root", "block", "d1", "n", "bits", *(["shingles"] if exact else []))), strict=True):
                if (root, block) != now:
                    close()
                    now, held = (root, block), {}
                    if len(out) >= 50_000:
                        yield _links(out)
                        out = []
                held[d1] = row
        close()
        if out:
            yield _links(out)

    return work


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def width(size: int) -> int:
    """Bits of a set's bitmap: so many that differing bits of unrelated sets outnumber what partners may differ in."""
    return 1 << max(10, (size * 3 // 4).bit_length())


def bitmap(h: np.ndarray) -> bytes:
    """The parity of the number of shingles that hash to each bit."""
    bits = width(len(h))
    return np.packbits(np.bincount((h & U64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of sets in ascending size, folded to any common width that is asked for."""

    def __init__(self, raw: list[bytes]):
        self.raw, self.bytes = raw, np.array([len(x) for x in raw])
        self.made: dict[int, tuple[int, np.ndarray]] = {}

    def at(self, wide: int) -> tuple[int, np.ndarray]:
        """(first set of at least this width, rows of 64-bit words from there on)."""
        if wide not in self.made:
            first = int(np.searchsorted(self.bytes, wide // 8))
            rows = np.zeros((len(self.raw) - first, wide // 64), U64)
            for row, x in zip(rows, self.raw[first:], strict=True):
                row[:] = np.bitwise_xor.reduce(np.frombuffer(x, U64).reshape(-1, wide // 64), 0)
            self.made[wide] = first, rows
        return self.made[wide]


def links(ids: list[int], size: np.ndarray, bits: list[bytes], found: list[np.ndarray] | None, num: int, den: int) -> list[tuple[int, int]]:
    """A link for each set that is reached from another; together they connect what the threshold connects.

    Without the sets themselves (found) they connect what the bitmaps let pass, which is that and perhaps more.
    """
    order = np.argsort(size, kind="stable")
    ids, size = [ids[i] for i in order], size[order]
    found, maps = found and [found[i] for i in order], Bitmaps([bits[i] for i in order])
    left, out = np.arange(len(ids)), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            p = todo.pop()
            mine, n = int(size[p]), size[left]
            low = -(-mine * num // den)
            a, b = np.searchsorted(n, [low, mine * den // num + 1])
            if a == b:
                continue
            first, rows = maps.at(width(min(low, mine)))
            total = n[a:b] + mine
            need = -(-total * num // (num + den))
            apart = np.bitwise_count(rows[left[a:b] - first] ^ rows[p - first]).sum(1, dtype=np.int64)
            near = np.flatnonzero(total - apart >= 2 * need)  # the overlap is at most (total - apart) / 2
            hit = [] if found else (a + near).tolist()
            step = max(1, MEET // max(mine, 1))
            for i in range(0, len(near) if found else 0, step):
                part = near[i : i + step]
                flat = np.concatenate([found[left[a + j]] for j in part])
                at = np.minimum(np.searchsorted(found[p], flat), len(found[p]) - 1)
                same = np.add.reduceat((found[p][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(n[a + part])[:-1]]))
                hit += (a + part[same >= need[part]]).tolist()
            out += [(ids[p], ids[left[j]]) for j in hit]
            todo += left[hit].tolist()
            left = np.delete(left, hit)
    return out


def classes(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id; also tag, a hash of the text, and first, whether the row stands for its component.

    A row without words stands for itself. Rows that repeat one id and text stand for their component together.
    """
    n = partitions(docs.sparkSession)
    with scratch() as s:
        rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
        base = staged(rows.mapInArrow(_profile(words), "doc_id bigint, tag bigint, n bigint, d1 bigint, d2 bigint"), "shingle-sets")
        many = base.count()  # tables of numbers are written in files by their rows
        # of each class one row, the first by id and text, stands for it
        class_ = staged(few(base.filter("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "tag")).alias("rep")), many), "classes")

        sent = rows.select("text").mapInArrow(_signatures(words, num, den, 4 * n), "bucket int, block binary")
        tiles = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(Signer(num, den).low), TILES).distinct()
        tiles = staged(few(tiles, 8 * many), "signature-groups")  # some 5 a document
        wanted = class_.join(tiles.select("d1").distinct(), "d1").select("d1", "d2", F.col("rep.doc_id").alias("_id"), F.col("rep.tag").alias("_tag"))
        texts = rows.join(wanted, (F.col("doc_id") == F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("text", "d1", "d2")
        known_sets = staged(texts.mapInArrow(_recall(words), "d1 bigint, n bigint, bits binary, shingles binary"), "candidate-sets")

        # first by bitmaps within each group, so that a common passage doesn't chain texts together; then exactly
        close = connected(tiles, known_sets.select("d1", "n", "bits"), num, den, False)
        exact = staged(few(_tiles(close, known_sets), close.count()), "close-tiles")
        linked = connected(exact, known_sets, num, den, True)
        discard(tiles, known_sets, close, exact)

        met = linked.join(class_.select(F.col("d1").alias("node"), "rep"), "node")
        first = met.groupBy("root").agg(F.min("rep").alias("first"))
        named = linked.join(first, "root").select(F.col("node").alias("d1"), "first")
        named = class_.join(named, "d1", "left").select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), F.coalesce("first", "rep").alias("first"))
        named = staged(few(named, many), "components")
        out = base.join(named, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
        component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
        stands = F.col("first").isNull() | ((F.col("first.doc_id") == F.col("doc_id")) & F.col("first.tag").eqNullSafe(F.col("tag")))
        known = lambda c: F.when(c != NULL_ID, c)
        result = out.select(known(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"), "tag", stands.alias("first"))
        return s.keep(staged(few(result, many), "ngram-join"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, but of each component only one; rows without words all stay."""
    stay = classes(docs, words, num, den).filter("first and n_shingles > 0").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("tag").alias("_tag")).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False))
    rows = docs.filter(worded).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_tag"))
    turn = F.row_number().over(Window.partitionBy("_id", "_tag").orderBy("_id"))
    return rows.join(stay, ["_id", "_tag"]).withColumn("turn", turn).filter("turn = 1").select("row.*").union(docs.filter(~worded))


def _recall(words: int):
    """The sets of candidates, from their texts, with their bitmaps; each once, as rows of an id come to one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            d1, d2, ids, found = batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), [], []
            for i, h in sets(batch.column("text"), words):
                if d1[i] not in seen and digests(h) == (d1[i], d2[i]):  # rows of one id may have several texts
                    seen.add(d1[i])
                    ids.append(d1[i])
                    found.append(h)
                if len(found) == 500:
                    yield _set_rows(ids, found)
                    ids, found = [], []
            if found:
                yield _set_rows(ids, found)

    return work


def _set_rows(ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    bits = [bitmap(h) for h in found]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array(bits, pa.binary()), pa.array([h.tobytes() for h in found], pa.binary())], names=["d1", "n", "bits", "shingles"])


def _links_in(tiles: DataFrame, known_sets: DataFrame, num: int, den: int, exact: bool, rows: int) -> DataFrame:
    """The links found in tiles(root, block, d1), about so many rows; the sets join only here."""
    n = partitions(tiles.sparkSession)
    held = tiles.select("root", "block", "d1").join(known_sets, "d1").repartition(n, "root", "block").sortWithinPartitions("root", "block")
    return staged(few(held.mapInArrow(_tested(num, den, exact), "a bigint, b bigint").distinct(), rows), "links")


def connected(tiles: DataFrame, known_sets: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """(node, root) by the links of all pairs of each group; tiles of more than one block hold a block and the pivots."""
    with scratch() as s:
        rows = tiles.count()  # a tile has fewer links than rows
        links = _links_in(tiles, known_sets, num, den, exact, rows)
        found = components(links)
        apart = _apart(tiles, found, rows)
        if apart is not None:
            found = components(links.union(_links_in(apart, known_sets, num, den, exact, rows)))
        return s.keep(staged(few(found, rows), "connected"))


def _apart(tiles: DataFrame, found: DataFrame, rows: int) -> DataFrame | None:
    """Of so many rows of tiles, those of every two blocks of a large group that aren't of one component; None if there are no such groups."""
    large = tiles.filter("blocks > 1").select("root", "d1").distinct()
    if not large.limit(1).count():
        return None
    large = staged(few(large.join(found.toDF("d1", "c"), "d1", "left").select("root", "d1", F.coalesce("c", "d1").alias("c")), rows), "large-groups")
    sizes = large.groupBy("root", "c").agg(F.count("*").alias("k"))
    several = sizes.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.when(F.col("k") < TILE_ROWS, F.col("k"))).alias("rest")).filter("n > 1")
    cut = staged(few(sizes.join(several, "root").select("root", "c", F.when(F.col("k") < TILE_ROWS, F.lit(None)).otherwise(F.col("c")).alias("piece"), F.ceil(F.when(F.col("k") < TILE_ROWS, F.col("rest")).otherwise(F.col("k")) / TILE_ROWS).alias("n")), rows), "pieces")
    if not cut.limit(1).count():
        return None
    # components of many members are pieces of their own; the others lie together in blocks by hash
    pieces = cut.select("root", "piece", "n").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    name = lambda piece, part: F.xxhash64(F.coalesce(piece, F.lit(0)), piece.isNull(), part)
    pieces = pieces.select("root", "piece", name(F.col("piece"), F.col("part")).alias("name"))
    p, q = pieces.toDF("root", "p", "one"), pieces.toDF("root", "q", "two")
    met = p.join(q, "root").filter((F.col("one") < F.col("two")) & ~F.coalesce(F.col("p") == F.col("q"), F.lit(False)) | (F.col("one") == F.col("two")) & F.col("p").isNull())
    met = met.select("root", F.xxhash64("root", "one", "two").alias("block"), F.explode(F.array_distinct(F.array("one", "two"))).alias("name"))
    members = large.join(cut, ["root", "c"]).select("root", "d1", name(F.col("piece"), F.pmod(F.xxhash64("d1"), F.col("n"))).alias("name"))
    return members.join(met, ["root", "name"]).select("root", "block", "d1")


def _tiles(close: DataFrame, known_sets: DataFrame) -> DataFrame:
    """The tiles of components: one if it fits, else blocks, each with the pivots."""
    members = close.select(F.col("node").alias("d1"), "root").join(known_sets.select("d1", (8 * F.col("n") + F.length("bits")).alias("weight")), "d1")
    sizes = members.groupBy("root").agg(F.count("*").alias("k"), F.sum("weight").alias("weight"))
    large = staged(sizes.select("root", F.greatest(F.ceil(F.col("k") / TILE_ROWS), F.ceil(F.col("weight") / TILE_BYTES)).alias("blocks")).filter("blocks > 2"), "large-components")
    own = close.select("root", F.lit(0).cast("bigint").alias("block"), F.col("node").alias("d1"), F.lit(1).cast("bigint").alias("blocks"))
    many = large.count()
    if not many:
        return own
    large = F.broadcast(large) if many <= BROADCAST_ROWS else large
    marked = own.select("root", "d1").join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("bigint"))
    own = marked.select("root", F.pmod(F.xxhash64("d1"), F.col("blocks")).alias("block"), "d1", "blocks")
    # a pivot of each of so many parts by hash: an aggregate, where the smallest of all would take a sort of each component
    pivots = marked.filter("blocks > 1").groupBy("root", F.pmod(F.xxhash64("root", "d1"), F.lit(PIVOTS)).alias("part")).agg(F.min("d1").alias("d1"), F.first("blocks").alias("blocks"))
    every = pivots.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return own.union(every.select("root", "block", "d1", "blocks")).distinct()
