"""N-gram Jaccard join through PartEnum signatures.

A document is the set of its distinct word shingles; two documents link when
100 * |A & B| >= threshold * |A | B|.  Sets are put into size bands
(r = l * 100 / threshold, so a linked pair lies in the same or neighbouring
bands).  For a band with largest size r, a linked pair differs in at most
k = floor(2 r (100 - t) / (100 + t)) elements.  The feature domain is hashed
into n1 first-level partitions and each of those into n2 second-level ones.
Some first-level partition then holds at most k2 differences, and a subset of
n2 - k2 of its second-level partitions holds none: the projections on all such
subsets are the signatures, so a linked pair shares one.  Each set signs for
its own band and the next.

Empty projections are never signatures (they would join everything).  The
guarantee is kept by counting: a partition is good for a set when the set has
elements in more than k2 of its second-level partitions, and a set with more
than k / (k2 + 1) good partitions is strong.  One strong side suffices; the few
weak sets also sign with twice as many, unsplit partitions, and again, until
they are strong.

Signatures travel as packed blocks per bucket of signatures and meet by
sorting (buckets grow in number with the input; equal sets sign once per task,
and a signature that very many different sets share makes its bucket larger).  Of a
signature 40 bits travel: two that agree in them and in the bucket make one run, which
adds candidates and never drops one.  A run of up to
``CAP`` documents gives all its pairs; a longer run gives a star around its
most central member instead.  Candidates are pruned by a histogram bound of the
symmetric difference (exact: it never drops a link), and the survivors are
verified on the whole sets.  When a star leaves members in different
components, all members of that pivot's stars sign once more with longer
projections, carrying their component; the sets in runs of more than one component
get their histograms, and in each bucket the pairs
of different components that the bound lets through grow trees, and only the
trees' edges are sent on (fewer than the bucket has sets).  The ends of every
link between different components are then in one tree of all buckets' edges; the
members of each such tree are compared block by block, all pairs, and a task sends
no more links than join its components, so components are exact.

A link that is still missing joins two members of stars in one component.  The
classes in stars are therefore dealt by component into blocks, every two blocks
of a component meet in a task, and all their pairs are compared exactly.  The
link table is complete; link counts are summed inside those tasks, so that
counting makes no row per pair.

Sets equal to each other are one class and are compared once per task.

Defined results: text without words (or NULL) has no set and links with
nothing; rows that repeat a doc_id are compared each, and are in one component (linked
to whatever any of its texts is linked to); rows without doc_id have a NULL component and no links;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import bucket_count, release, stored, text_bytes
from .components import components

#: (k2, n2) of the first and the refining signing.
FIRST, FINE = (1, 3), (2, 5)
CAP = 8
CELLS = 128
SLACK = 1.08
#: Text bytes per signature bucket, entries held before a block is sent, and partners of a hub per verifying task.
SIGNATURE_BUCKET_BYTES = 32 << 20
BLOCK_ENTRIES = 1 << 21
HUB = 64
#: Members of a run that one task pairs; a longer run is cut into parts of this size, two of which meet in a task.
LONG = 8192
#: Tasks that share the members of one pivot.
SALT = 32
#: Classes and shingles per block of one component.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1 << 20
_U = np.uint64


class Bands:
    """Size bands of one threshold (percent)."""

    def __init__(self, threshold: int, largest: int):
        self.r: list[int] = []
        low = 1
        while not self.r or self.r[-1] < largest:
            self.r.append(low * 100 // threshold)
            low = self.r[-1] + 1
        self.r += [low * 100 // threshold]  # the band after the last, for the second signing
        self.upper = np.array(self.r)
        self.k = np.array([2 * x * (100 - threshold) // (100 + threshold) for x in self.r])

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.upper, sizes)


def _sign(h, begin, docs, band, k, n1, k2, n2, salt):
    """Signatures (key, index into docs) and weak documents for one signing of the sets ``docs``.

    ``band``, ``k`` and ``n1`` are per set.
    """
    size = (begin[1:] - begin[:-1])[docs]
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(docs)), size)
    x = h[np.arange(start[-1]) - np.repeat(start[:-1] - begin[:-1][docs], size)]
    place = shingles.mix(x, 11 + salt)
    value = shingles.mix(x, 12 + salt)
    n1 = n1.astype(np.uint64)
    p1 = ((place >> _U(32)) * n1[owner]) >> _U(32)
    p2 = ((place & _U(0xFFFFFFFF)) * _U(n2)) >> _U(32)
    base = np.concatenate([[0], np.cumsum(n1.astype(np.int64))])
    cell = (base[:-1][owner] + p1.astype(np.int64)) * n2 + p2.astype(np.int64)
    sums = np.zeros(int(base[-1]) * n2, np.uint64)
    np.add.at(sums, cell, value)
    count = np.bincount(cell, minlength=len(sums)).reshape(-1, n2)
    sums = sums.reshape(-1, n2)
    good = (count > 0).sum(1) > k2
    weak = np.add.reduceat(good, base[:-1]) * (k2 + 1) <= k
    part_owner = np.repeat(np.arange(len(docs)), n1.astype(np.int64))
    part = np.arange(len(part_owner)) - base[:-1][part_owner]
    tag = shingles.mix(part.astype(np.uint64) * _U(1 << 20) + band[part_owner].astype(np.uint64), 13 + salt)
    keys, owners = [], []
    for j, subset in enumerate(combinations(range(n2), n2 - k2)):
        cols = list(subset)
        full = count[:, cols].sum(1) > 0
        keys.append(shingles.mix(sums[full][:, cols].sum(1) + tag[full], 50 + j))
        owners.append(part_owner[full])
    return np.concatenate(keys), np.concatenate(owners), np.flatnonzero(weak)


def signatures(h: np.ndarray, begin: np.ndarray, bands: Bands, k2: int, n2: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of joined sorted sets: (key, index of the set)."""
    size = np.diff(begin)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for ahead in (0, 1):
        band = bands.of(size) + ahead
        docs = np.flatnonzero((size > 0) & (bands.k[np.minimum(band, len(bands.k) - 1)] > 0))
        tier = 0
        while len(docs):  # k = 0 needs no signature: such sets link only when equal
            b = band[docs]
            k = bands.k[b]
            if tier:
                n1, a2, m2 = (k + 1) * 2**tier, 0, 1
            else:
                n1, a2, m2 = (SLACK * k / (k2 + 1)).astype(np.int64) + 1, k2, n2
            key, own, weak = _sign(h, begin, docs, b, k, n1, a2, m2, 1000 * k2 + 20 * tier)
            keys.append(key)
            owners.append(docs[own])
            docs, tier = docs[weak], tier + 1
    return np.concatenate(keys), np.concatenate(owners)


def _set_prints(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprint of every set."""
    out = []
    for seed in (21, 22):
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(shingles.mix(h, seed), out=run[1:])
        out.append(shingles.mix(run[begin[1:]] - run[begin[:-1]], seed))
    return out[0].view(np.int64), out[1].view(np.int64)


def set_profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), f1, f2 (set fingerprint) and the histogram of the set over ``CELLS`` cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, h, begin in shingles.text_sets(batch.column(1), width):
                n = np.diff(begin)
                f1, f2 = _set_prints(h, begin)
                cell = np.repeat(np.arange(b - a), n) * CELLS + (shingles.mix(h, 31) % _U(CELLS)).astype(np.int64)
                hist = np.minimum(np.bincount(cell, minlength=(b - a) * CELLS), 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(CELLS), b - a, [None, pa.py_buffer(hist.tobytes())]).cast(pa.binary())],
                    ["doc_id", "n", "f1", "f2", "hist"])

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, hist binary")


_BLOCK = "bucket long, docs binary, counts binary, keys binary, labels binary"
_FULL = "bucket long, docs binary, counts binary, keys binary, labels binary, sizes binary, hists binary"
#: Bits of a signature that do not travel, and bytes of those that do.
CUT, KEY_BYTES = 24, 5


def _pack(packer, a: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: small ones take little more than their low bytes."""
    return packer.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpack(z, packed: list[bytes], kind: str) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    return [np.ascontiguousarray(np.frombuffer(z.decompress(x), np.uint8).reshape(size, -1).T).view(kind).ravel() for x in packed]


def _entries(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(key, set, label) of all entries of one bucket; a key is unlike those of other buckets."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    counts = np.concatenate(_unpack(z, t.column("counts").to_pylist(), "<u4"))
    docs = np.concatenate([np.cumsum(x) for x in _unpack(z, t.column("docs").to_pylist(), "<i8")])
    raw = np.frombuffer(b"".join(t.column("keys").to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
    key = np.zeros((len(raw), 8), np.uint8)
    key[:, CUT // 8:] = raw
    key = key.view("<u8").ravel() + _U(t.column("bucket")[0].as_py())
    label = None
    if t.column("labels")[0].as_py() is not None:
        label = np.repeat(docs - np.concatenate(_unpack(z, t.column("labels").to_pylist(), "<i8")), counts)
    return key, np.repeat(docs, counts), label


def _blocks(docs: DataFrame, buckets: int, bands: Bands, width: int, k2: int, n2: int, fine: bool = False) -> DataFrame:
    """Packed signature blocks: (bucket, ids of sets, entries of each, keys).

    ``fine``: ``docs`` also has label, n and hist; only entries whose key sets of different labels share, with these.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen: set[tuple[int, int]] = set()  # classes this task has signed for
        held: list[tuple[np.ndarray, np.ndarray]] = []
        more: dict[int, int] = {}
        packer = zstandard.ZstdCompressor(level=1)
        waiting = 0

        def flush() -> pa.RecordBatch:
            key, doc = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            bucket = (key % _U(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            key, doc, bucket = key[order], doc[order], bucket[order]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(edge[1:], len(bucket))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])])
            rows = []
            for a, b in zip(edge, ends):
                at = np.flatnonzero(new[a:b])
                own = doc[a:b][at]
                label = _pack(packer, own - np.array([more[d] for d in own.tolist()], "<i8")) if fine else None
                rows.append((int(bucket[a]), _pack(packer, np.diff(own, prepend=0)),
                             _pack(packer, np.diff(np.append(at, b - a)).astype("<u4")),
                             key[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, CUT // 8:].tobytes(), label))
            more.clear()
            c = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])],
                                              ["bucket", "docs", "counts", "keys", "labels"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, h, begin in shingles.text_sets(batch.column(1), width):
                f1, f2 = _set_prints(h, begin)
                keep = []
                for i, p in enumerate(zip(f1.tolist(), f2.tolist())):
                    if begin[i + 1] > begin[i] and p not in seen:
                        seen.add(p)
                        keep.append(i)
                if not keep:
                    continue
                if len(keep) < b - a:
                    sub = np.concatenate([h[begin[i]:begin[i + 1]] for i in keep])
                    sub_begin = np.concatenate([[0], np.cumsum([begin[i + 1] - begin[i] for i in keep])])
                else:
                    sub, sub_begin = h, begin
                key, own = signatures(sub, sub_begin, bands, k2, n2)
                if len(key):
                    held.append((key, ids[a:b][keep][own].astype("<i8")))
                    waiting += len(key)
                    if fine:
                        for i in keep:
                            more[int(ids[a + i])] = batch.column(2)[a + i].as_py()
                if waiting >= BLOCK_ENTRIES:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    light = docs.select("doc_id", "text", *["label"] * fine).mapInArrow(run, _BLOCK)
    return _mixed(light, docs.select("doc_id", "label", "n", "hist")) if fine else light


def _mixed(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """The entries of runs with more than one label, packed anew with the labels, sizes and histograms of their sets."""
    def run(t: pa.Table) -> pa.Table:
        key, doc, label = _entries(t)
        order = np.lexsort((label, key))
        key, doc, label = key[order], doc[order], label[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        edge = np.append(np.flatnonzero(first), len(key))
        keep = (label[edge[:-1]] != label[edge[1:] - 1])[np.cumsum(first) - 1]
        key, doc = key[keep], doc[keep]
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        edge = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1))
        return pa.table({"bucket": pa.array(np.full(len(edge), t.column("bucket")[0].as_py())), "doc_id": pa.array(doc[edge]),
                         "keys": pa.array([key[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(key)))], pa.binary())})

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for t in batches:
            if not t.num_rows:
                continue
            bucket, doc, label, n = (t.column(c).to_numpy() for c in ("bucket", "doc_id", "label", "n"))
            keys, hist = t.column("keys").to_pylist(), t.column("hist").to_pylist()
            order = np.lexsort((doc, bucket))
            rows = []
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                rows.append((int(bucket[at[0]]), doc[at].tobytes(), np.array([len(keys[i]) // 8 for i in at], "<u4").tobytes(),
                             b"".join(keys[i] for i in at), label[at].tobytes(), n[at].tobytes(),
                             packer.compress(b"".join(hist[i] for i in at))))
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])],
                                             ["bucket", "docs", "counts", "keys", "labels", "sizes", "hists"])

    shared = blocks.groupBy("bucket").applyInArrow(run, "bucket long, doc_id long, keys binary")
    return shared.join(known.hint("shuffle_merge"), "doc_id").select(
        "bucket", "doc_id", "keys", "label", "n", "hist").mapInArrow(packed, _FULL)


def _runs(key: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members ordered by key, and where each run of equal keys begins (+ total)."""
    order = np.lexsort((idx, key))
    key, idx = key[order], idx[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (idx[1:] != idx[:-1])])  # a set signs once per key
    key, idx = key[new], idx[new]
    return idx, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))


def run_pairs(key: np.ndarray, doc: np.ndarray, cap: int):
    """Distinct candidate pairs (a, b, star) of equal keys; ``star`` marks a pair of a pivot (a) with a member."""
    ids, idx = np.unique(doc, return_inverse=True)
    idx, edge = _runs(key, idx)
    length = np.diff(edge)
    codes, n = [np.zeros(0, np.int64)], len(ids)
    for m in range(2, cap + 1):
        rows = idx[edge[:-1][length == m][:, None] + np.arange(m)]
        for i, j in combinations(range(m), 2):
            codes.append(np.unique(rows[:, i] * n + rows[:, j]))
    stars = [np.zeros(0, np.int64)]
    large = np.flatnonzero(length > cap)
    if len(large):
        member = np.concatenate([np.arange(edge[r], edge[r + 1]) for r in large])
        run = np.repeat(np.arange(len(large)), length[large])
        who = idx[member]
        # in how many long runs of this bucket a set takes part, in powers of two: buckets then agree on pivots
        central = np.frexp(np.bincount(who, minlength=n))[1]
        order = np.lexsort((who, -central[who], run))
        first = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]]))
        pivot = who[order][first][run]
        stars.append(np.unique((pivot * n + who)[pivot != who]))
    plain, star = np.unique(np.concatenate(codes)), np.unique(np.concatenate(stars))
    both = np.concatenate([plain, star])
    mark = np.concatenate([np.zeros(len(plain), bool), np.ones(len(star), bool)])
    return ids[both // n] if n else both, ids[both % n] if n else both, mark


def may_link(far: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets whose symmetric difference is at least ``far`` can reach the threshold."""
    return far * (100 + threshold) <= (size_a + size_b) * (100 - threshold)


def merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (smallest member of each tree) after the edges a - b."""
    while True:
        x, y = root[a], root[b]
        other = x != y
        if not other.any():
            return root
        a, b, x, y = a[other], b[other], x[other], y[other]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def open_trees(key, doc, label, size, hist, threshold: int, chunk: int = 1 << 15, side=None, long: int | None = None):
    """Trees over the sets that may link: (set, root) for every set joined to a smaller one, and the runs left out.

    Sets of equal keys, different labels and admissible sizes and histograms are joined, ``chunk`` comparisons at a time;
    two sets that already share a tree are not compared again, so what leaves a bucket never exceeds its sets.
    ``label``, ``size`` and ``hist`` belong to the entries of ``doc``'s distinct values in ascending order, like ``side``:
    only pairs of different sides then count.  With ``long``, runs of more sets are left out: (key, indexes of the sets in
    ascending size).
    """
    ids, idx = np.unique(doc, return_inverse=True)
    order = np.sort(key)
    keys = order[np.concatenate([[True], order[1:] != order[:-1]])] if len(order) else order
    idx, edge = _runs(key, idx)
    root, left, x, y, waiting = np.arange(len(ids)), [], [], [], 0

    def settle() -> None:
        nonlocal root
        a, b = np.concatenate(x), np.concatenate(y)
        for at in range(0, len(a), chunk):
            i, j = a[at:at + chunk], b[at:at + chunk]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            far = np.abs(hist[i].astype(np.int16) - hist[j]).sum(1, dtype=np.int64)
            near = may_link(far, size[i], size[j], threshold)
            root = merged(root, i[near], j[near])

    for k, a, b in zip(keys, edge[:-1], edge[1:]):
        w = idx[a:b]
        if b - a < 2 or (label[w] == label[w[0]]).all() or (root[w] == root[w[0]]).all():
            continue
        w = w[np.argsort(size[w], kind="stable")]  # partners of a set lie in a range of sizes
        if long and len(w) > long:
            left.append((k, w))
            continue
        end = np.searchsorted(size[w], size[w] * 100 // threshold, "right")
        for i in range(len(w) - 1):
            other = w[i + 1:end[i]]
            other = other[(label[other] != label[w[i]]) & (root[other] != root[w[i]])]
            if side is not None:
                other = other[side[other] != side[w[i]]]
            if len(other):
                x.append(np.full(len(other), w[i]))
                y.append(other)
                waiting += len(other)
            if waiting >= chunk:
                settle()
                x, y, waiting = [], [], 0
    if waiting:
        settle()
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]], left


def _joined(t: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in t.column(name).to_pylist()])


def _candidates(blocks: DataFrame, cap: int) -> DataFrame:
    """Distinct pairs (a, b, star) whose sets share a signature."""
    def run(t: pa.Table) -> pa.Table:
        a, b, star = run_pairs(*_entries(t)[:2], cap)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "star": pa.array(star, pa.bool_())})

    found = blocks.groupBy("bucket").applyInArrow(run, "a long, b long, star boolean")
    return found.groupBy("a", "b").agg(F.max("star").alias("star"))


def _open_candidates(blocks: DataFrame, threshold: int, long: int = LONG) -> DataFrame:
    """Edges (a, b) of trees that span, bucket by bucket, the sets of different components that share a fine signature and
    may link: both ends of every such link are in one component of these edges.

    A run of more than ``long`` sets leaves its bucket in parts of that size, and each two parts meet in a task of their own.
    """
    def table(a, b, parts=()):
        c = list(zip(*parts)) or [()] * 7
        empty = [None] * len(parts)
        return pa.table({"a": pa.array([*a, *empty], pa.int64()), "b": pa.array([*b, *empty], pa.int64()),
                         **{k: pa.array([None] * len(a) + list(x), t) for (k, t), x in zip(
                             [("run", pa.int64()), ("part", pa.int64()), ("parts", pa.int64()), ("docs", pa.binary()),
                              ("labels", pa.binary()), ("sizes", pa.binary()), ("hists", pa.binary())], c)}})

    def run(t: pa.Table) -> pa.Table:
        import zstandard

        docs = _joined(t, "docs", "<i8")
        ids, first = np.unique(docs, return_index=True)
        z, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        hist = np.frombuffer(b"".join(map(z.decompress, t.column("hists").to_pylist())), np.uint8).reshape(-1, CELLS)
        label, size, hist = _joined(t, "labels", "<i8")[first], _joined(t, "sizes", "<i8")[first], hist[first]
        a, b, left = open_trees(_joined(t, "keys", "<u8"), np.repeat(docs, _joined(t, "counts", "<u4")), label, size, hist,
                                threshold, long=long)
        rows = []
        for key, w in left:
            for i, at in enumerate(range(0, len(w), long)):
                x = w[at:at + long]
                rows.append((int(key.astype(np.int64)), i, -(-len(w) // long), ids[x].tobytes(), label[x].tobytes(),
                             size[x].tobytes(), packer.compress(hist[x].tobytes())))
        return table(a, b, rows)

    def meet(t: pa.Table) -> pa.Table:
        import zstandard

        z = zstandard.ZstdDecompressor()
        docs, label, size = (_joined(t, c, "<i8") for c in ("docs", "labels", "sizes"))
        hist = np.frombuffer(b"".join(map(z.decompress, t.column("hists").to_pylist())), np.uint8).reshape(-1, CELLS)
        side = np.repeat(np.arange(t.num_rows), [len(x) // 8 for x in t.column("docs").to_pylist()])
        ids, first = np.unique(docs, return_index=True)
        a, b, _ = open_trees(np.zeros(len(docs), np.uint64), docs, label[first], size[first], hist[first], threshold,
                             side=side[first] if t.num_rows > 1 else None)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    packed = "run long, part long, parts long, docs binary, labels binary, sizes binary, hists binary"
    found = stored(blocks.groupBy("bucket").applyInArrow(run, "a long, b long, " + packed), "open")
    pairs = found.where("run IS NULL").select("a", "b")
    parts = found.where("run IS NOT NULL")
    if not parts.isEmpty():
        dealt = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
            "run", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "docs", "labels", "sizes", "hists")
        pairs = pairs.unionByName(dealt.groupBy("run", "x", "y").applyInArrow(meet, "a long, b long"))
    return pairs.distinct()


def _prune(pairs: DataFrame, profiles: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose sizes and histograms allow a link (the histogram distance never exceeds the true one)."""
    own = profiles.select("doc_id", "n", "f1", "f2", "hist")

    def side(s):
        return own.select(F.col("doc_id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "f1", "f2", "hist")))

    rows = (pairs.join(side("a"), "a").join(side("b"), "b")
            .where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold)
                   & ~((F.col("f1_a") == F.col("f1_b")) & (F.col("f2_a") == F.col("f2_b")) & (F.col("n_a") == F.col("n_b")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            x = np.frombuffer(b"".join(t.column("hist_a").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
            y = np.frombuffer(b"".join(t.column("hist_b").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16)
            far = np.abs(x - y).sum(1, dtype=np.int64)
            keep = may_link(far, t.column("n_a").to_numpy(), t.column("n_b").to_numpy(), threshold)
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    return rows.select("a", "b", "n_a", "n_b", "hist_a", "hist_b").mapInArrow(run, "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links among ``pairs``: whole sets compared; a hub's partners are split over tasks."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("long").alias("parts"))
    dealt = pairs.join(degree, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).drop("parts")
    wanted = dealt.select(F.col("b").alias("doc_id"), "a", "part").unionByName(
        dealt.select(F.col("a").alias("doc_id"), "a", "part").distinct())
    rows = wanted.join(docs.hint("shuffle_merge"), "doc_id")  # both sides grow with the input: never broadcast

    def run(t: pa.Table) -> pa.Table:
        a, ids = t.column("a")[0].as_py(), t.column("doc_id").to_numpy()
        sets: list[np.ndarray] = []
        for _, _, h, begin in shingles.text_sets(t.column("text"), width):
            sets += [h[x:y] for x, y in zip(begin[:-1], begin[1:])]
        hubs, found = [s for s, d in zip(sets, ids) if d == a], set()
        for s, d in zip(sets, ids):
            if d != a:
                for hub in hubs:
                    both = len(np.intersect1d(s, hub, assume_unique=True))
                    if both and 100 * both >= threshold * (len(s) + len(hub) - both):
                        found.add(int(d))
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return rows.groupBy("a", "part").applyInArrow(run, "a long, b long")


def block_links(sets: list[np.ndarray], side: np.ndarray, threshold: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs (i, j): i of side 0 and j of side 1, or i < j when there is one side."""
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    size = np.array([len(x) for x in sets], np.int64)
    value, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times > 1  # a shingle of one set adds to no overlap
    place = np.cumsum(shared) - 1
    keep = shared[col]
    col, owner = place[col[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    both = np.zeros((len(left), len(right)), np.float32)  # counts below 2**24 are exact
    for at in range(0, int(shared.sum()), chunk):
        x, y = np.searchsorted(col, [at, at + chunk])
        has = np.zeros((len(sets), chunk), np.float32)
        has[owner[x:y], col[x:y] - at] = 1
        both += has[left] @ has[right].T
    both = both.astype(np.int64)
    link = (both > 0) & (100 * both >= threshold * (size[left][:, None] + size[right][None, :] - both))
    if not side.any():
        link = np.triu(link, 1)
    i, j = np.nonzero(link)
    return left[i], right[j]


def _dense_blocks(star: DataFrame, texts: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes of stars that share their component with another, those dealt into pairs of blocks with their texts)."""
    weight = member.groupBy("class").agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("n"))
    near = (star.select(F.col("member").alias("doc_id"), "label").distinct().join(member.select("doc_id", "class"), "doc_id")
            .groupBy("class", "label").agg(F.min("doc_id").alias("doc_id")).join(weight, "class"))
    near = stored(_with_parts(near), "near")
    return near, _dealt(near, texts, "docs")


def _with_parts(near: DataFrame) -> DataFrame:
    """Groups (``label``) of two and more classes, with the number of blocks that hold the group's classes."""
    group = near.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size")).where("m > 1").select(
        "label", F.greatest(F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("size") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    return near.join(group, "label")


def _dealt(near: DataFrame, texts: DataFrame, *more: str) -> DataFrame:
    """Every two blocks (x <= y) of a group, with the texts of their classes."""
    rows = near.join(texts.hint("shuffle_merge"), "doc_id").select("class", "label", *more, "parts", "text")
    part = F.pmod(F.xxhash64("class"), F.col("parts"))
    dealt = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return dealt.select("label", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"),
                        (F.col("part") > F.col("other")).alias("upper"), "class", *more, "text")


def _block_sets(t: pa.Table, width: int) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of one task, one per class, and their shingle sets."""
    t = t.take(pa.array(np.unique(t.column("class").to_numpy(), return_index=True)[1]))  # rows may repeat a document
    sets: list[np.ndarray] = []
    for _, _, h, begin in shingles.text_sets(t.column("text"), width):
        sets += [h[x:y] for x, y in zip(begin[:-1], begin[1:])]
    return t, sets


def _tree_links(trees: DataFrame, known: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links that join the components (``own``) of sets in one candidate tree: all its pairs are compared block by block, and
    a task sends at most one link fewer than it has components."""
    near = (components(trees, "a", "b").withColumnRenamed("component", "label").join(
        known.select(F.col("doc_id").alias("node"), F.col("label").alias("own"), "n"), "node")
        .select("label", F.col("node").alias("class"), F.col("node").alias("doc_id"), "own", "n"))

    def run(t: pa.Table) -> pa.Table:
        t, sets = _block_sets(t, width)
        names, own = t.column("class").to_numpy(), np.unique(t.column("own").to_numpy(), return_inverse=True)[1]
        i, j = block_links(sets, t.column("upper").to_numpy().astype(np.int64), threshold)
        a, b = [], []
        apart = own[i] != own[j]
        i, j = i[apart], j[apart]
        root = np.arange(len(names))
        while len(i):  # take the first link left, join its components, drop the links this settles
            x, y = root[own[i]], root[own[j]]
            _, first = np.unique(np.maximum(x, y), return_index=True)  # one link per component, to a smaller one: no cycle
            a.append(names[i[first]])
            b.append(names[j[first]])
            root = merged(root, own[i[first]], own[j[first]])
            still = root[own[i]] != root[own[j]]
            i, j = i[still], j[still]
        none = np.zeros(0, np.int64)
        return pa.table({"a": pa.array(np.concatenate([none, *a]), pa.int64()), "b": pa.array(np.concatenate([none, *b]), pa.int64())})

    return _dealt(stored(_with_parts(near), "trees"), texts, "own").groupBy("label", "x", "y").applyInArrow(run, "a long, b long")


def _dense_links(dealt: DataFrame, width: int, threshold: int, counts: bool) -> DataFrame:
    """Links (u, v) between classes of one component, or with ``counts`` the documents linked to each class in each task."""
    def run(t: pa.Table) -> pa.Table:
        t, sets = _block_sets(t, width)
        names = t.column("class").to_numpy()
        i, j = block_links(sets, t.column("upper").to_numpy().astype(np.int64), threshold)
        if not counts:
            return pa.table({"u": pa.array(np.minimum(names[i], names[j])), "v": pa.array(np.maximum(names[i], names[j]))})
        docs = t.column("docs").to_numpy()
        total = np.zeros(len(names), np.int64)
        np.add.at(total, i, docs[j])
        np.add.at(total, j, docs[i])
        some = np.flatnonzero(total)
        return pa.table({"class": pa.array(names[some]), "found": pa.array(total[some])})

    return dealt.groupBy("label", "x", "y").applyInArrow(run, "class long, found long" if counts else "u long, v long")


def similarity_links(docs: DataFrame, threshold: int = 80, width: int = 5, cap: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles with the class of every document, all links (u < v) between classes, components of linked classes).

    Needs one row per doc_id.
    """
    member, links, joined, star, texts = _linked(_known(docs), threshold, width, cap)
    near, dealt = _dense_blocks(star, texts, member)
    return member, _other_links(links, member, near).unionByName(_dense_links(dealt, width, threshold, False)), joined


def _other_links(links: DataFrame, member: DataFrame, near: DataFrame) -> DataFrame:
    """The links (u < v) between classes that are not compared in blocks."""
    by_class = (links.join(member.select(F.col("doc_id").alias("a"), F.col("class").alias("x")), "a")
                .join(member.select(F.col("doc_id").alias("b"), F.col("class").alias("y")), "b")
                .where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
    return (by_class.join(near.select(F.col("class").alias("u"), F.lit(True).alias("in_u")), "u", "left")
            .join(near.select(F.col("class").alias("v"), F.lit(True).alias("in_v")), "v", "left")
            .where("in_u IS NULL OR in_v IS NULL").select("u", "v"))


def _link_counts(member: DataFrame, links: DataFrame, star: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """(class, n_links): other rows whose set links with the set of the class."""
    near, dealt = _dense_blocks(star, texts, member)
    dense = stored(_dense_links(dealt, width, threshold, True), "dense")
    release(member.sparkSession)
    docs = member.where("n > 0").groupBy("class").agg(F.count(F.lit(1)).alias("docs"))
    other = _other_links(links, member, near)
    other = other.unionByName(other.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = other.join(docs.withColumnRenamed("class", "v"), "v").select(F.col("u").alias("class"), F.col("docs").alias("found"))
    own = docs.select("class", (F.col("docs") - 1).alias("found"))
    return dense.unionByName(found).unionByName(own).groupBy("class").agg(F.sum("found").alias("n_links"))


def _known(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows with a doc_id."""
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a key of their own: the doc_id where it is unique, else a number (column ``id`` keeps the doc_id).

    The second result joins the rows that repeat a doc_id: (u, v); None when there are none.
    """
    known = _known(docs)
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        return known.withColumn("id", F.col("doc_id")), None
    rows = stored(known.select(F.col("doc_id").alias("id"), "text", F.monotonically_increasing_id().alias("doc_id")), "numbered")
    first = rows.groupBy("id").agg(F.min("doc_id").alias("v"))
    return rows, rows.join(first, "id").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v")


def _linked(docs: DataFrame, threshold: int, width: int, cap: int, same: DataFrame | None = None
            ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(classes, links that span every component, components, members of stars with their component, texts compared).

    ``same``: rows (u, v) that are one document although their sets need not link.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    profiles = stored(set_profiles(docs, width), "sets")
    classes = profiles.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class"))
    member = stored(profiles.join(classes, ["n", "f1", "f2"], "left").select(
        "doc_id", "n", F.coalesce("class", "doc_id").alias("class")), "classes")
    stats = profiles.agg(F.max("n")).first()
    bands = Bands(threshold, max(1, int(stats[0] or 1)))
    buckets = min(bucket_count(text_bytes(docs), SIGNATURE_BUCKET_BYTES), 1 << CUT)

    def connected(links: DataFrame) -> DataFrame:
        first, second = (member.select(F.col("doc_id").alias(x), F.col("class").alias(c)) for x, c in (("a", "u"), ("b", "v")))
        edges = links if same is None else links.unionByName(same.select(F.col("u").alias("a"), F.col("v").alias("b")))
        return stored(components(edges.join(first, "a").join(second, "b").select("u", "v"), "u", "v"), "components")

    pairs = stored(_candidates(_blocks(docs, buckets, bands, width, *FIRST), cap), "pairs")
    release(spark)
    likely = stored(_prune(pairs.select("a", "b"), profiles, threshold), "likely")
    star = pairs.where("star").select(F.col("a").alias("pivot"), F.col("b").alias("member"))
    star = star.unionByName(star.select("pivot", F.col("pivot").alias("member")).distinct())
    # The texts of all documents that may still be compared, fetched once: the list grows with the input, so it is
    # never broadcast, and later steps shuffle this part only.
    ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).unionByName(
        star.select(F.col("member").alias("doc_id"))).distinct()
    texts = stored(docs.join(ids.hint("shuffle_merge"), "doc_id", "left_semi"), "texts")
    release(spark)
    links = stored(_verify(likely, texts, width, threshold), "links")
    release(spark)
    joined = connected(links)
    label = member.join(joined, member["class"] == joined["node"], "left").groupBy("doc_id").agg(
        F.min(F.coalesce("component", "class")).alias("label"))
    star = stored(star.join(label.withColumnRenamed("doc_id", "member"), "member"), "stars")
    mixed = star.groupBy("pivot").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    salt = F.pmod(F.xxhash64("member"), F.lit(SALT)).cast("int")  # a pivot with very many members is met in several tasks
    mixed = mixed.select("pivot", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    who = stored(star.withColumn("salt", salt).join(mixed, ["pivot", "salt"], "left_semi").select(
        F.col("member").alias("doc_id"), "label").distinct(), "again")
    if not who.isEmpty():
        known = who.join(profiles.select("doc_id", "n", "hist"), "doc_id")
        scope = texts.join(known.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "label", "n", "hist")
        trees = stored(_open_candidates(_blocks(scope, buckets, bands, width, *FINE, fine=True), threshold), "open")
        release(spark)
        links = stored(links.unionByName(_tree_links(trees, known, texts, width, threshold)), "links")
        release(spark)
        joined = connected(links)
        star = star.select("member").distinct().join(
            member.join(joined, member["class"] == joined["node"], "left").groupBy(F.col("doc_id").alias("member")).agg(
                F.min(F.coalesce("component", "class")).alias("label")), "member")
    return member, links, joined, star, texts


def link_components(docs: DataFrame, threshold: int = 80, width: int = 5, cap: int = CAP) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id and n_links of every row of ``docs``.

    ``n_links`` counts the other rows with a doc_id whose set links with the row's own (equal sets link).
    """
    rows, same = _numbered(docs)
    member, links, joined, star, texts = _linked(rows, threshold, width, cap, same)
    out = _labelled(docs, rows, same, member, joined, width)
    count = _link_counts(member, links, star, texts, width, threshold)
    return out.join(count, out["_class"] == count["class"], "left").select(
        *(c for c in out.columns if c != "_class"),
        F.when(F.col("n_shingles") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def _labelled(docs: DataFrame, rows: DataFrame, same: DataFrame | None, member: DataFrame, joined: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row of ``docs``; ``_class`` is the key of its class."""
    out = member.join(joined, member["class"] == joined["node"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("class").alias("_class"), F.coalesce("component", "class").alias("component_id"))
    if same is None:
        out = out.withColumn("class_id", F.col("_class"))
    else:  # keys are row numbers: classes and components are named by their smallest doc_id
        out = stored(out.join(rows.select("doc_id", "id"), "doc_id"), "rows")
        for key, name in (("_class", "class_id"), ("component_id", "_component")):
            out = out.join(out.groupBy(key).agg(F.min("id").alias(name)), key)
        out = out.withColumn("component_id", F.col("_component")).withColumn("doc_id", F.col("id"))
    names = ["doc_id", "n_shingles", "class_id", "component_id", "_class"]
    lost = docs.where(F.col("doc_id").isNull())
    profile = set_profiles(lost.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), width)
    none = F.lit(None).cast("long")
    return out.select(*names).unionByName(profile.select("doc_id", F.col("n").alias("n_shingles"), *(none.alias(c) for c in names[2:])))


def keep_one(docs: DataFrame, threshold: int = 80, width: int = 5) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component; all columns stay.

    Rows without doc_id stay; of rows that repeat a doc_id the one with the smallest text stays.
    """
    rows, same = _numbered(docs)
    member, _, joined, *_ = _linked(rows, threshold, width, CAP, same)
    found = _labelled(docs, rows, same, member, joined, width).where(F.col("doc_id").isNotNull())
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    out = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    repeated = stored(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")), "repeated")
    if repeated.isEmpty():
        return out
    twice = out.join(repeated, out["doc_id"] == repeated["_twice"], "left_semi").groupBy("doc_id").agg(
        F.min(F.struct("text", *[c for c in docs.columns if c not in ("text", "doc_id")])).alias("_row"))
    rest = out.join(repeated, out["doc_id"] == repeated["_twice"], "left_anti")
    return rest.unionByName(twice.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`") for c in docs.columns]))
