"""Token files: independent zstandard frames, a document index and a trailing seek table.

One file holds consecutive documents in ascending doc_id order:

    frame 0 | frame 1 | ... | skippable frame: document index | skippable frame: seek table

* A data frame is an independent zstandard frame of ids (little-endian, 16 bits
  where the vocabulary allows, else 32); a long document spans several frames.
* The document index (skippable magic 0x184D2A50) holds, zstandard-compressed,
  the id width, the keys and the number of ids of each document.
* The seek table follows the public seekable layout: skippable magic
  0x184D2A5E, per frame (compressed size, raw size, low 32 bits of XXH64 of the
  raw bytes), then the number of frames, a descriptor byte with the checksum
  flag and the magic 0x8F92EAB1.

A reader seeks to the end, reads the seek table and the index, and decompresses
only the frames that hold the documents it wants; every frame read is checked.

Writing range-partitions by doc_id (and, where it repeats, the text's hash), so each task writes one file, streaming
frame by frame; file names are unique per attempt and only the written
manifest (one row per file) says which files count, so retried or speculative
tasks do no harm.  Paths go through ``pyarrow.fs`` (file, hdfs, s3, ...), below
the shared folder.

Defined results: NULL text counts as empty (only the end id); a NULL doc_id
sorts first and is kept; repeated doc_ids are ordered by a hash of the text (so that
rows of one key can be dealt to several files); an empty table
gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterspark.operators.ordered import running_totals

from . import tokens
from .common import shared_path, stored, text_bytes

# The public seekable format.
INDEX_MAGIC, SEEK_MAGIC, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FRAME_BYTES = 1 << 18
FILE_BYTES = 256 << 20


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Writer:
    """Appends documents to an output stream; ``close`` adds the index and the seek table."""

    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.z = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.pending, self.waiting = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.keys: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, key: int | None, ids: bytes | np.ndarray) -> None:
        """``ids``: little-endian unsigned 32-bit (bytes or an array)."""
        wide = np.frombuffer(ids, "<u4")
        if self.width == 2 and len(wide) and int(wide.max()) > 0xFFFF:
            raise ValueError("an id does not fit 16 bits")
        data = wide.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.keys.append(key)
        self.sizes.append(len(wide))
        self.pending.append(data)
        self.waiting += len(data)
        if self.waiting >= self.frame_bytes:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.pending)
        at = 0
        while len(data) - at >= self.frame_bytes or last and at < len(data):
            self._frame(data[at:at + self.frame_bytes])
            at += self.frame_bytes
        rest = data[at:]
        self.pending, self.waiting = ([rest] if rest else []), len(rest)

    def _frame(self, raw: bytes) -> None:
        import xxhash

        packed = self.z.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush(True)
        missing = np.array([k is None for k in self.keys], bool)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        body = self.z.compress(struct.pack("<IQ", self.width, len(keys)) + missing.tobytes() + keys.tobytes()
                               + np.array(self.sizes, "<i8").tobytes())
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class Reader:
    """Random access to one file opened with ``seek``/``read``."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.z = source, zstandard.ZstdDecompressor()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flag & CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table_at = size - 9 - 12 * n
        if struct.unpack("<II", self._at(table_at - 8, 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("broken seek table")
        f = np.frombuffer(self._at(table_at, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.sums = f[:, 2]
        self.place = np.concatenate([[0], np.cumsum(f[:, 0])])
        self.raw = np.concatenate([[0], np.cumsum(f[:, 1])])
        at = int(self.place[-1])
        magic, n_bytes = struct.unpack("<II", self._at(at, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("broken document index")
        body = self.z.decompress(self._at(at + 8, n_bytes))
        self.width, count = struct.unpack_from("<IQ", body)
        self.missing = np.frombuffer(body, bool, count, 12)
        self.keys = np.frombuffer(body, "<i8", count, 12 + count)
        self.begin = np.concatenate([[0], np.cumsum(np.frombuffer(body, "<i8", count, 12 + 9 * count))])
        self.held: tuple[int, bytes] = (-1, b"")
        self.frames_read = 0

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(int(place))
        return self.source.read(int(n))

    def _frame(self, k: int) -> bytes:
        import xxhash

        if self.held[0] != k:
            raw = self.z.decompress(self._at(self.place[k], self.place[k + 1] - self.place[k]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"checksum of frame {k} differs")
            self.held = (k, raw)
            self.frames_read += 1
        return self.held[1]

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document; only the frames that hold it are read."""
        a, b = int(self.begin[i]) * self.width, int(self.begin[i + 1]) * self.width
        out, k = [], int(np.searchsorted(self.raw, a, "right")) - 1
        while a < b:
            end = min(b, int(self.raw[k + 1]))
            out.append(self._frame(k)[a - int(self.raw[k]):end - int(self.raw[k])])
            a, k = end, k + 1
        return np.frombuffer(b"".join(out), "<u2" if self.width == 2 else "<u4")

    def find(self, keys: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(key, ids) of every document whose key is asked for."""
        wanted = np.array(sorted(set(keys)), np.int64)
        for i in np.flatnonzero(np.isin(self.keys, wanted) & ~self.missing):
            yield int(self.keys[i]), self.ids(int(i))


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 2, vocabulary: int = 1 << 16,
          file_bytes: int = FILE_BYTES, least_files: int | None = None) -> DataFrame:
    """Encode and write all documents; the manifest, one row per file: part, path, bytes, n_docs, n_tokens."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    least = least_files or 4 * spark.sparkContext.defaultParallelism
    files = max(least, -(-text_bytes(docs) // file_bytes))
    width = 2 if vocabulary <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, total = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                store, root = _fs(folder)
                store.create_dir(root, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
                stream = store.open_output_stream(f"{root}/{name}")
                out = Writer(stream, width)
            keys = b.column(0).to_pylist()
            for x, texts in tokens.encoded(tokenizer, b.column(1), end_id):
                for key, ids in zip(keys[x:x + len(texts)], texts):
                    out.add(key, ids)
        if out is not None:
            out.close()
            stream.close()
            total = sum(out.sizes)
            info = store.get_file_info(f"{root}/{name}").size
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([info], pa.int64()),
                 pa.array([len(out.sizes)], pa.int64()), pa.array([total], pa.int64())],
                ["part", "path", "bytes", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return stored(ordered.select("doc_id", "text").mapInArrow(run, "part int, path string, bytes long, n_docs long, n_tokens long"), "token-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    files = max(1, manifest.count())
    work = running_totals(manifest, [F.col("part")], {"_end": "n_tokens"}, min(files, 200)).select(
        "path", "bytes", (F.col("_end") - F.col("n_tokens")).alias("begin"), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns)):
                store, where = _fs(path)
                with store.open_input_file(where) as f:
                    t = Reader(f, size)
                    for a in range(0, len(t), 5000):
                        part = range(a, min(a + 5000, len(t)))
                        crc = [zlib.crc32(t.ids(i).astype("<u4").tobytes()) for i in part]
                        cut = slice(a, a + len(crc))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(t.keys[cut], pa.int64(), mask=t.missing[cut]), pa.array(t.begin[:-1][cut] + start, pa.int64()),
                             pa.array(np.diff(t.begin)[cut], pa.int64()), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])

    plan = work.repartitionByRange(files, "part").select("path", "bytes", "begin")
    return plan.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
