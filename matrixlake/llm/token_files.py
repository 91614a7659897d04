"""Token-ID files: independent zstandard frames, then an index of documents and a seek table with checksums.

A file is a run of zstandard frames, each of whole documents, then two skippable frames. The first (INDEX_MAGIC) holds,
for each frame, its number of documents and ids, and for each document its id and number of ids. The last is the seek
table: for each frame compressed size, raw size and the low 32 bits of XXH64 of the raw bytes, then the number of frames,
a descriptor byte (checksums present) and SEEK_MAGIC. Any zstandard reader skips both, so the file also decompresses
as one stream of little-endian unsigned 32-bit ids. A reader that wants one document reads the two tables and one frame.

Defined results: a null text is empty (its ids are the end id only); rows come in ascending doc_id, a null doc_id first,
rows of the same id by their text; every repeated row is a document of its own; an empty table gives no file.
Other columns play no part. A lost task's file stays unlisted: only files that the manifest names count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch, shared_dir, staged
from .tokens import Encoder

FRAME_BYTES = 1 << 20
INDEX_MAGIC, SKIP_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
MANIFEST = "part int, path string, n_docs bigint, n_tokens bigint"
ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class Writer:
    """Appends documents; a frame closes when it has FRAME_BYTES of ids."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=3)
        self.frames, self.seek, self.docs = [], [], []
        self.buffer, self.buffered, self.open_docs, self.tokens = [], 0, 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, len(ids) // 4))
        self.buffer.append(ids)
        self.buffered += len(ids)
        self.open_docs += 1
        if self.buffered >= self.frame_bytes:
            self._close_frame()

    def _close_frame(self) -> None:
        if not self.open_docs:
            return
        raw = b"".join(self.buffer)
        packed = self.pack.compress(raw)
        self.stream.write(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.frames.append((self.open_docs, len(raw) // 4))
        self.tokens += len(raw) // 4
        self.buffer, self.buffered, self.open_docs = [], 0, 0

    def finish(self) -> None:
        self._close_frame()
        ids, null, lengths = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        index = struct.pack("<IQ", len(self.frames), len(self.docs)) + np.array(self.frames, "<u8").tobytes()
        index += np.array(ids, "<i8").tobytes() + np.array(null, "u1").tobytes() + np.array(lengths, "<u8").tobytes()
        index = zstandard.ZstdCompressor(level=3).compress(index)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in self.seek)
        foot = struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEK_MAGIC)
        self.stream.write(struct.pack("<II", SKIP_SEEK, len(table) + len(foot)) + table + foot)


class Reader:
    """Reads documents of a file; decompresses only the frames that hold them, and checks each against its checksum."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, how, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or how != CHECKSUMS:
            raise ValueError("not a token file with checksums")
        file.seek(size - 9 - 12 * n)
        self.seek = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        file.seek(int(self.begin[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != INDEX_MAGIC:
            raise ValueError("the index of documents is missing")
        index = zstandard.ZstdDecompressor().decompress(file.read(length))
        frames, docs = struct.unpack_from("<IQ", index)
        self.frames = np.frombuffer(index, "<u8", 2 * frames, 12).reshape(frames, 2).astype(np.int64)
        at = 12 + 16 * frames
        self.ids = np.frombuffer(index, "<i8", docs, at)
        self.null = np.frombuffer(index, "u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.frames[:, 0])])

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.begin[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
        if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(position in the file, doc_id, ids) of all documents, or of those whose id is wanted."""
        for k in range(len(self.frames)):
            a, b = int(self.first[k]), int(self.first[k + 1])
            if wanted is not None and not any(not z and int(x) in wanted for x, z in zip(self.ids[a:b], self.null[a:b], strict=True)):
                continue
            ids = np.frombuffer(self.frame(k), "<u4")
            cuts = np.concatenate([[0], np.cumsum(self.lengths[a:b])])
            for j in range(a, b):
                doc = None if self.null[j] else int(self.ids[j])
                if wanted is None or doc in wanted:
                    yield j, doc, ids[cuts[j - a] : cuts[j - a + 1]]


def opened(uri: str):
    """(file system, path) of a URI or absolute path, by whichever store it names."""
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes the ids of docs(doc_id, text) as token files, one for each range of (doc_id, text); returns the manifest.

    Without a folder they go to one of their own in the shared folder, which counts as staged.
    """
    spark = docs.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
        scratch.note(spark, folder)
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # ids that many rows share, or null ones, are cut by how their texts begin
    ordered = ordered.repartitionByRange(partitions(spark), "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = writer = out = None
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids.zst"
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs, path = opened(folder)
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)  # by name, it would compress once more
                writer = Writer(out, frame_bytes)
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for i in range(0, len(ids), 500):
                for doc, raw in zip(ids[i : i + 500], encoder.encode(texts[i : i + 500].to_pylist()), strict=True):
                    writer.add(doc, raw + end)
        if writer is not None:
            writer.finish()
            out.close()
            row = [[TaskContext.get().partitionId()], [f"{folder}/{name}"], [len(writer.docs)], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return staged(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, ids of all documents before it, its ids' number and checksum."""
    spark = manifest.sparkSession
    files, start, rows = sorted(manifest.collect()), 0, []  # one row a file
    for part in files:
        rows.append((part.path, start))
        start += part.n_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = opened(uri)
                with fs.open_input_file(path) as f:
                    reader, out, at = Reader(f), [], base
                    for _, doc, ids in reader.documents():
                        out.append((doc, at, len(ids), zlib.crc32(ids)))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    spread = spark.createDataFrame(rows, "path string, base bigint").repartition(max(1, len(rows)))
    return spread.mapInArrow(read, ROWS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
