"""Exact repeated-substring removal by blockwise suffix sorting with a difference cover.

A byte goes when some ``width``-byte string over it also starts earlier (in a
document with a smaller doc_id, or earlier in the same one).  Only equality of
suffixes in their first ``width`` bytes matters, so suffixes are compared that far.

1. Cover sample.  Positions whose remainder modulo v lies in a difference
   cover are sampled.  Of two equal windows some shift below v puts both on
   sampled positions, so a repeated window contains a sampled suffix that
   repeats in its first ``width - v + 1`` bytes.  Sampled suffixes are bucketed
   and sorted by a hash of those bytes; one whose hash is alone certainly does
   not repeat and rules its neighbourhood out.
2. Blocks.  The windows next to the other sampled suffixes are the candidates.
   They are dealt into suffix buckets by a 64-bit hash and sorted one bucket per
   task, in rounds, so that what is on disk at a time does not exceed about the
   size of the texts.  Every window but the first of its hash claims to repeat
   that first one.
3. Long ties.  Following windows with one earlier document and one distance are
   one claim, and a claim is compared by its bytes: the whole stretch travels to
   the earlier document once, not ``width`` bytes per window.  If a claim is
   false (different strings share a hash), all windows whose hash may be shared
   are grouped by their bytes instead, so the result is exact whatever the hash.
4. True claims are merged into maximal runs per document.

Documents equal to an earlier one are recognised by their SHA-256 first and
take no part in 1 to 3 (all their windows repeat).  Suffixes travel as packed
blocks (compressed position steps and hashes).  A map task reports repeats among
the entries it holds itself and sends the first start only, so a string that
stands in very many documents is one entry of every block of ``BLOCK_ENTRIES``;
a bucket holds its share of the different strings and such entries.  Only the
bit table of step 3's rare path (fixed size) is collected.

Order of documents: doc_id ascending, NULL first; rows that repeat a doc_id
follow the order of their texts.  Defined results: NULL text counts as empty;
texts shorter than ``width`` lose nothing; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import Scratch, bucket_count, stored, text_bytes

# Perfect difference sets (every remainder is a difference of two members), by modulus.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
}
#: Text bytes whose suffixes share a bucket, and entries held before a block is sent.
SUFFIX_BUCKET_BYTES = 16 << 20
BLOCK_ENTRIES = 1 << 21
#: Bytes on disk for one candidate window of a round (its entry, and its share of what it reports).
ENTRY_BYTES = 14
#: Bytes of claims a task remembers, and entries of the table of hashes that different strings share.
CLAIM_BYTES = 16 << 20
SHARED_BITS = 1 << 23
_U = np.uint64
_BLOCK = "bucket long, docs binary, counts binary, steps binary, keys binary"


def cover_for(width: int) -> tuple[int, np.ndarray]:
    """Modulus and members: the largest known cover that leaves at least 0.4 of the width to compare."""
    v = max((m for m in COVERS if m <= 0.6 * width + 1), default=1)
    return v, np.array(COVERS.get(v, (0,)), np.int64)


def pack(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray, key_bytes: int, *keys: np.ndarray) -> pa.RecordBatch:
    """Block rows of (bucket, document, position, key) entries.

    Positions of a document travel as compressed steps, keys as their low ``key_bytes`` bytes; claims
    (``key_bytes`` -1) as compressed pairs of the earlier document and the distance to the earlier start.
    """
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    order = np.lexsort((pos, doc, bucket))
    bucket, doc, pos, keys = bucket[order], doc[order], pos[order].astype(np.int64), [k[order] for k in keys]
    new_bucket = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) | new_bucket
    step = np.diff(pos, prepend=0)
    step[new] = pos[new]
    edge = np.flatnonzero(new_bucket)
    out = []
    for a, b in zip(edge, np.append(edge[1:], len(bucket))):
        at = np.flatnonzero(new[a:b])
        packed = b""
        if key_bytes > 0:
            packed = keys[0][a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :key_bytes].tobytes()
        elif key_bytes < 0:
            packed = z.compress(b"".join(k[a:b].astype("<i8").tobytes() for k in keys))
        out.append((int(bucket[a]), doc[a:b][at].astype("<i8").tobytes(), np.diff(np.append(at, b - a)).astype("<u4").tobytes(),
                    z.compress(step[a:b].astype("<u4").tobytes()), packed))
    c = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])],
                                      ["bucket", "docs", "counts", "steps", "keys"])


def unpack(t: pa.Table, key_bytes: int) -> tuple[np.ndarray, ...]:
    """(document, position, key...) of all block rows; claims have two keys."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    docs, poss, keys = [], [], []
    for d, c, s, k in zip(*(t.column(x).to_pylist() for x in ("docs", "counts", "steps", "keys"))):
        count = np.frombuffer(c, "<u4").astype(np.int64)
        step = np.frombuffer(z.decompress(s), "<u4").astype(np.int64)
        total = np.cumsum(step)
        start = np.cumsum(count) - count
        poss.append(total - np.repeat(total[start] - step[start], count))
        docs.append(np.repeat(np.frombuffer(d, "<i8"), count))
        if key_bytes > 0:
            wide = np.zeros((len(step), 8), np.uint8)
            wide[:, :key_bytes] = np.frombuffer(k, np.uint8).reshape(-1, key_bytes)
            keys.append(wide.view("<u8").reshape(1, -1))
        elif key_bytes < 0:
            keys.append(np.frombuffer(z.decompress(k), "<i8").reshape(2, -1))
    return np.concatenate(docs), np.concatenate(poss), *(np.concatenate(keys, axis=1) if keys else ())


def _first_starts(doc: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of their keys, for each the entry where its key starts first, and how many share its key."""
    order = np.argsort(key)
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(edge, len(key)))
    _, index = np.unique(doc, return_inverse=True)
    place = ((index.astype(np.uint64) << _U(32)) | pos.astype(np.uint64))[order]
    lead = order[place == np.repeat(np.minimum.reduceat(place, edge), size)]
    return order, np.repeat(lead, size), np.repeat(size, size)


def _reported(doc: np.ndarray, pos: np.ndarray, key: np.ndarray, later_only: bool, blocks: int, base: int):
    """(block rows of the repeating entries, one entry per key): all entries of a key, or claims of all but the first."""
    order, first, size = _first_starts(doc, pos, key)
    if later_only:
        own = order != first
        at, source = order[own], first[own]
        extra = (-1, doc[source], pos[source] - pos[at])
    else:
        at, extra = order[size > 1], (0,)
    where = (shingles.mix(doc[at].view(np.uint64), 9) % _U(blocks)).astype(np.int64) + base
    return pack(where, doc[at], pos[at], *extra) if len(at) else None, order[order == first]


class Packer:
    """Collects (document, position, hash) and turns them into block rows for the suffix buckets.

    Entries whose hash repeats among those held are reported at once, to groups numbered from ``buckets`` on, and
    only the first start of a hash goes to its bucket: a string that repeats everywhere is one entry of every block.
    """

    def __init__(self, key_bytes: int, shift: int, buckets: int, later_only: bool):
        self.key_bytes, self.shift, self.buckets, self.later_only = key_bytes, shift, buckets, later_only
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, doc, pos, h) -> None:
        if len(h):
            self.held.append((doc, pos, h))
            self.waiting += len(h)

    def send(self, last: bool) -> Iterator[pa.RecordBatch]:
        if self.waiting < (1 if last else BLOCK_ENTRIES):
            return
        doc, pos, h = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.waiting = [], 0
        told, heads = _reported(doc, pos, h, self.later_only, self.buckets, self.buckets)
        if told is not None:
            yield told
        h = h[heads]
        yield pack((h % _U(self.buckets)).astype(np.int64), doc[heads], pos[heads], self.key_bytes, h >> _U(self.shift))


class _Hasher:
    """Hashes of byte strings inside one slice of texts, cut to ``bits`` bits."""

    def __init__(self, data: np.ndarray, bits: int = 64):
        self.mask = _U((1 << bits) - 1)
        self.inverse = shingles._powers(len(data) + 1)[1]
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(shingles._BYTE[data] * shingles._powers(len(data) + 1)[0][:len(data)], out=self.total[1:])

    def at(self, pos: np.ndarray, length: int) -> np.ndarray:
        return shingles.mix((self.total[pos + length] - self.total[pos]) * self.inverse[pos], 5) & self.mask


def _sample_blocks(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Step 1, map side: hashes of the sampled suffixes' first bytes."""
    v, cover = cover_for(width)
    reach = width - v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(5, 24, buckets, False)
        grid = np.zeros(0, np.int64)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            raw, offsets = shingles.text_buffers(b.column(1))
            with np.errstate(over="ignore"):
                for x, y in shingles.slices(offsets):
                    off = offsets[x:y + 1] - offsets[x]
                    size = np.diff(off)
                    if size.max(initial=0) < width:
                        continue
                    if len(grid) == 0 or grid[-1] < size.max():
                        grid = (np.arange(int(size.max()) // v + 2)[:, None] * v + cover).ravel()
                    n = np.where(size >= width, np.searchsorted(grid, size - reach, "right"), 0)
                    inside = grid[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    h = _Hasher(raw[offsets[x]:offsets[y]]).at(inside + np.repeat(off[:-1], n), reach)
                    packer.add(np.repeat(ids[x:y], n), inside, h)
                    yield from packer.send(False)
        yield from packer.send(True)

    return docs.mapInArrow(run, _BLOCK)


def _repeating(blocks: DataFrame, key_bytes: int, later_only: bool, buckets: int) -> DataFrame:
    """Sort each bucket and report its repeating entries, dealt by document; what tasks reported before passes through."""
    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        if bucket >= buckets:
            return t.set_column(0, "bucket", pa.array(np.full(len(t), bucket - buckets), pa.int64()))
        told, _ = _reported(*unpack(t, key_bytes), later_only, buckets, 0)
        return pa.Table.from_batches([told]) if told is not None else t.slice(0, 0)

    return blocks.groupBy("bucket").applyInArrow(run, _BLOCK)


def _per_document(dealt: DataFrame, before: int, after: int) -> DataFrame:
    """(id, runs): positions p of each document as merged runs [p - before, p + after), as pairs of 64-bit numbers."""
    def run(t: pa.Table) -> pa.Table:
        doc, pos = unpack(t, 0)
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        start = fresh | np.concatenate([[True], pos[1:] - before > pos[:-1] + after])
        at = np.flatnonzero(start)
        last = np.append(at[1:], len(pos)) - 1
        pairs = np.column_stack([np.maximum(pos[at] - before, 0), pos[last] + after]).astype("<i8")
        lead = np.flatnonzero(fresh[at])
        ends = np.append(lead[1:], len(at))
        return pa.table({"id": pa.array(doc[at[lead]], pa.int64()),
                         "runs": pa.array([pairs[a:b].tobytes() for a, b in zip(lead, ends)], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "id long, runs binary")


def _segments(dealt: DataFrame, width: int) -> DataFrame:
    """(id, runs, claims): merged runs of each document, and its claims as (start, windows, earlier document, earlier start).

    A claim is a longest stretch of following windows with one earlier document and one distance.
    """
    def run(t: pa.Table) -> pa.Table:
        doc, pos, source, gap = unpack(t, -1)
        order = np.lexsort((pos, doc))
        doc, pos, source, gap = doc[order], pos[order], source[order], gap[order]
        fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
        turn = fresh | np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (source[1:] != source[:-1]) | (gap[1:] != gap[:-1])])
        at = np.flatnonzero(turn)
        claims = np.column_stack([pos[at], np.diff(np.append(at, len(pos))), source[at], pos[at] + gap[at]]).astype("<i8")
        begin = np.flatnonzero(fresh | np.concatenate([[True], pos[1:] > pos[:-1] + width]))
        runs = np.column_stack([pos[begin], pos[np.append(begin[1:], len(pos)) - 1] + width]).astype("<i8")
        lead = np.flatnonzero(fresh)
        c, r = np.searchsorted(at, np.append(lead, len(pos))), np.searchsorted(begin, np.append(lead, len(pos)))
        return pa.table({"id": pa.array(doc[lead], pa.int64()),
                         "runs": pa.array([runs[a:b].tobytes() for a, b in zip(r, r[1:])], pa.binary()),
                         "claims": pa.array([claims[a:b].tobytes() for a, b in zip(c, c[1:])], pa.binary())})

    return dealt.groupBy("bucket").applyInArrow(run, "id long, runs binary, claims binary")


def _false_claims(cand: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(piece): bytes of the claims whose earlier document holds other bytes there.

    A task sends each (earlier document, place, bytes) once as long as it remembers it, so that a string copied
    everywhere is claimed a few times only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, bytes]] = set()
        held = 0
        for b in batches:
            new = []
            raw, offsets = shingles.text_buffers(b.column(0))
            for begin, claims in zip(offsets[:-1].tolist(), b.column(1).to_pylist()):
                for start, n, source, place in np.frombuffer(claims, "<i8").reshape(-1, 4).tolist():
                    c = (source, place, raw[begin + start:begin + start + n + width - 1].tobytes())
                    if c not in seen:
                        seen.add(c)
                        new.append(c)
                        held += len(c[2]) + 100
                        if held > CLAIM_BYTES:
                            yield _claim_rows(new)
                            seen, new, held = set(), [], 0
            if new:
                yield _claim_rows(new)

    told = cand.join(found, "id").select("text", "claims").mapInArrow(run, "id long, place long, piece binary")
    there = F.substr(F.col("text").cast("binary"), (F.col("place") + 1).cast("int"), F.length("piece"))
    return told.join(cand.select("id", "text"), "id").where(there != F.col("piece")).select("piece")


def _claim_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    source, place, piece = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(source, pa.int64()), pa.array(place, pa.int64()), pa.array(piece, pa.binary())],
                                      ["id", "place", "piece"])


def _compared(cand: DataFrame, found: DataFrame, wrong: DataFrame, width: int, bits: int) -> DataFrame:
    """(id, runs) when different strings share a hash: every window whose hash may be shared is grouped by its bytes.

    The hashes concerned travel as a bit table of fixed size; windows of other hashes keep what was found.
    """
    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in b.column(0).to_pylist():
                with np.errstate(over="ignore"):
                    h = _Hasher(np.frombuffer(piece, np.uint8), bits).at(np.arange(len(piece) - width + 1), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h % _U(SHARED_BITS)).astype(np.int64))], ["bit"])

    flags = wrong.mapInArrow(bad, "bit long").select(F.shiftright("bit", 5).alias("w"), (F.col("bit") % 32).cast("int").alias("k"))
    flags = flags.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("m")).collect()  # at most SHARED_BITS / 32 rows
    table = np.zeros(SHARED_BITS, bool)
    for w, m in flags:
        table[32 * w:32 * w + 32] = (m >> np.arange(32)) & 1
    shared = cand.sparkSession.sparkContext.broadcast(np.packbits(table))

    def windows(batches: Iterator[pa.RecordBatch], marked: bool):
        """(ids, text bytes, positions) per text: candidate windows with a shared hash, or marked ones without."""
        known = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            raw, offsets = shingles.text_buffers(b.column(1))
            for i, (id_, spans) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                data = raw[offsets[i]:offsets[i + 1]]
                pair = np.frombuffer(spans, "<i8").reshape(-1, 4 if marked else 2)
                low, high = pair[:, 0], np.minimum(pair[:, 0] + pair[:, 1] if marked else pair[:, 1], len(data) - width + 1)
                n = np.maximum(high - low, 0)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                with np.errstate(over="ignore"):
                    own = known[(_Hasher(data, bits).at(at, width) % _U(SHARED_BITS)).astype(np.int64)]
                yield id_, data, at[~own if marked else own]

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, data, at in windows(batches, False):
            for k in range(0, len(at), 10_000):
                p = at[k:k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), id_, np.int64)), pa.array(p, pa.int64()),
                                                  pa.array([data[x:x + width].tobytes() for x in p], pa.binary())], ["id", "pos", "s"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for id_, _, at in windows(batches, True):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), id_, np.int64)), pa.array(at, pa.int64())], ["id", "pos"])

    spread = stored(cand.select("id", "text", "runs").mapInArrow(strings, "id long, pos long, s binary"), "strings")
    first = spread.groupBy("s").agg(F.min(F.struct("id", "pos")).alias("first"))
    later = spread.join(first, "s").where(F.struct("id", "pos") != F.col("first")).select("id", "pos")
    same = cand.select("id", "text").join(found, "id").select("id", "text", "claims").mapInArrow(kept, "id long, pos long")

    def merge(t: pa.Table) -> pa.Table:
        pos = np.sort(t.column("pos").to_numpy())
        begin = np.flatnonzero(np.concatenate([[True], pos[1:] > pos[:-1] + width]))
        runs = np.column_stack([pos[begin], pos[np.append(begin[1:], len(pos)) - 1] + width]).astype("<i8")
        return pa.table({"id": t.column("id").slice(0, 1), "runs": pa.array([runs.tobytes()], pa.binary())})

    return later.unionByName(same).groupBy("id").applyInArrow(merge, "id long, runs binary")


def _window_blocks(cand: DataFrame, width: int, buckets: int, part: int, rounds: int,
                   bits: int) -> DataFrame:
    """Step 2, map side: hashes of the candidate windows that belong to this round's suffix buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(8, 0, buckets, True)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            runs = b.column(2).to_pylist()
            raw, offsets = shingles.text_buffers(b.column(1))
            with np.errstate(over="ignore"):
                for x, y in shingles.slices(offsets):
                    off = offsets[x:y + 1] - offsets[x]
                    size = np.diff(off)
                    spans = [np.frombuffer(runs[i], "<i8").reshape(-1, 2) for i in range(x, y)]
                    owner = np.repeat(np.arange(y - x), [len(s) for s in spans])
                    pair = np.concatenate(spans)
                    low, high = pair[:, 0], np.minimum(pair[:, 1], size[owner] - width + 1)
                    n = np.maximum(high - low, 0)
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                    who = np.repeat(owner, n)
                    h = _Hasher(raw[offsets[x]:offsets[y]], bits).at(inside + off[who], width)
                    own = (h >> _U(40)) % _U(rounds) == _U(part)
                    packer.add(ids[x:y][who[own]], inside[own], h[own])
                    yield from packer.send(False)
        yield from packer.send(True)

    return cand.select("id", "text", "runs").mapInArrow(run, _BLOCK)


def _numbered(docs: DataFrame) -> DataFrame:
    """(id, doc_id, text): ``id`` is a number in document order, one per row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    s = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).agg(
        F.max("c"), F.min("doc_id"), F.max("doc_id"), F.max(F.col("doc_id").isNull())).first()
    most, low, high, missing = (s[0] or 1), (s[1] or 0), (s[2] or 0), bool(s[3])
    if max(abs(low - 1), abs(high)) * most >= 1 << 62:
        raise ValueError("doc_ids are too large to number repeated rows")
    key = F.coalesce("doc_id", F.lit(low - 1)) if missing else F.col("doc_id")
    if most == 1:
        return base.select(key.alias("id"), "doc_id", "text")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    return base.select((key * most + place).alias("id"), "doc_id", "text")


def repeated_runs(docs: DataFrame, width: int = 100, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(numbered documents, (id, runs) of the byte runs to remove; NULL runs mean the whole text).

    ``bits`` shortens the window hashes; results do not depend on it.
    """
    scratch = Scratch(docs.sparkSession)
    stored = scratch.stored
    numbered = _numbered(docs)
    keyed = stored(numbered.where(F.octet_length("text") >= width).select("id", F.unhex(F.sha2("text", 256)).alias("f")), "prints")
    first = keyed.groupBy("f").agg(F.min("id").alias("first"))
    copies = stored(keyed.join(first, "f").where("id <> first").select("id"), "copies")
    scratch.drop("prints")
    own = numbered.select("id", "text").where(F.octet_length("text") >= width).join(copies, "id", "left_anti")
    total = text_bytes(docs)
    buckets = bucket_count(total, SUFFIX_BUCKET_BYTES)
    v, _ = cover_for(width)
    near = stored(_per_document(_repeating(_sample_blocks(own, width, buckets), 5, False, buckets), v - 1, 1), "near")
    scratch.drop()
    cand = stored(own.join(near, "id"), "candidates")
    windows = near.select(F.sum(F.octet_length("runs")).cast("long")).first()[0] or 0
    if windows:
        def count(batches):
            for b in batches:
                pair = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([int(sum((p[:, 1] - p[:, 0]).sum() for p in pair))], pa.int64())], ["n"])

        windows = near.select("runs").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    scratch.drop("near")
    rounds = max(1, -(-ENTRY_BYTES * int(windows) // max(1, total)))
    marked = None
    for part in range(rounds if windows else 0):
        found = stored(_repeating(_window_blocks(cand, width, buckets, part, rounds, bits), 8, True, buckets), "marked")
        marked = found if marked is None else marked.unionByName(found)
        scratch.drop()
    whole = copies.select("id", F.lit(None).cast("binary").alias("runs"))
    if marked is None:
        return numbered, whole
    found = stored(_segments(marked, width), "runs")
    scratch.drop("marked")
    wrong = stored(_false_claims(cand, found, width), "wrong")
    runs = found.select("id", "runs") if wrong.isEmpty() else stored(_compared(cand, found, wrong, width, bits), "compared")
    scratch.drop("candidates")
    return numbered, runs.unionByName(whole)


def remove_repeats(docs: DataFrame, width: int = 100, keep_text: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes) of every document."""
    numbered, runs = repeated_runs(docs, width, bits)
    marked = runs.select("id", F.col("runs").alias("r"), F.lit(True).alias("hit"))
    rows = numbered.join(marked, "id", "left").select("doc_id", "text", F.col("r").alias("runs"), F.coalesce("hit", F.lit(False)).alias("hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, r, hit in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                data = text.encode()
                spans = [] if not hit else [(0, len(data))] if r is None else np.frombuffer(r, "<i8").reshape(-1, 2).tolist()
                kept, at = [], 0
                for x, y in spans:
                    kept.append(data[at:x])
                    at = y
                rest = b"".join(kept) + data[at:]
                out.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            n, gone, spans, sha, rest = (list(x) for x in zip(*out)) if out else ([],) * 5
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array(rest, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return rows.mapInArrow(run, schema)
