"""Benchmark decontamination: CGK embedding, bit sampling and exact edit verification on words.

Words are runs of letters and digits, A-Z lower-cased.  The CGK walk reads a
word sequence: at step t it emits the word under its pointer and advances by a
random bit that depends on (t, word).  Sequences at small edit distance emit
streams at small Hamming distance, so a key of a few sampled steps is equal
with good probability; ``repeats`` independent walks raise the recall.  Every word of every document begins a window;
windows are as long as the items of a length class, whose steps are sampled
from 1.2 times that length.  A window walks only as far as its next sampled
step and goes on only while the words sampled so far are a prefix of some
item's key, which gives the same matches as computing whole keys.

The walks alone miss edited passages, above all those with a changed beginning,
so the recall does not rest on them: an item that may have k edits is also cut
into k + 1 pieces of nearly equal length.  Each edit touches at most one piece,
so some piece stands unchanged in any text within k edits, and every place that
holds a piece is verified too.  Every stretch within ``max_edit`` is found.

Matching windows are verified by the exact edit distance between the item and
the best-fitting stretch of the document around the window: at most
``max_edit`` edits per item word.  Items of fewer than ``min_words`` words are
too short to embed and match as exact word sequences.

The benchmark is handled in blocks of ``block`` items, each one scan over the
documents with an index of bounded size; documents are never shuffled.

Defined results: NULL or empty texts and items without words match nothing;
repeated items and rows give repeated matches; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles

_U = np.uint64


@dataclass(frozen=True)
class Settings:
    samples: int = 4
    repeats: int = 10
    max_edit: float = 0.2
    min_words: int = 8
    ratio: float = 1.2
    block: int = 5000
    seed: int = 17


@dataclass
class Index:
    """Keys of one block of items."""

    s: Settings
    ids: list
    words: list[np.ndarray]
    #: per repeat: classes as (sampled steps, per prefix length the sorted prefix keys, sorted full keys, items of each).
    repeats: list[list] = field(default_factory=list)
    #: per repeat: low 16 bits of the items' words at the first sampled step.
    heads: list[np.ndarray] = field(default_factory=list)
    short: dict[int, tuple[np.ndarray, list]] = field(default_factory=dict)
    #: per number of words: sorted keys of the pieces of that length, (item, first word in the item) of each.
    pieces: dict[int, tuple[np.ndarray, list]] = field(default_factory=dict)


def texts_words(texts: pa.Array):
    """Per slice: (first text, end text, word hashes, start bytes, end bytes, first word of each text + total)."""
    raw, offsets = shingles.text_buffers(texts)
    with np.errstate(over="ignore"):
        for a, b in shingles.slices(offsets):
            yield (a, b, *shingles.words(raw, offsets[a:b + 1], shingles.NOT_ALNUM))


def _step_seed(repeat: int, seed: int, block: int) -> int:
    return 1000 + seed * 100 + 4 * repeat + block


def _advance(i: np.ndarray, h: np.ndarray, a: int, b: int, repeat: int, seed: int, early: np.ndarray | None = None) -> np.ndarray:
    """Pointers after steps a..b-1; 64 steps share one random word per word hash (``early``: that of the first 64)."""
    for t in range(a, b):
        bits = early[i] if early is not None and t < 64 else shingles.mix(h[i], _step_seed(repeat, seed, t >> 6))
        i = i + ((bits >> _U(t & 63)) & _U(1)).astype(np.int8)
    return i


def _fold(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return shingles.mix(key * _U(0x9E3779B97F4A7C15) + word, 3)


_LOW = _U(0x1FFF)


def _member(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is a key: a small table of low bits first, then a search for what it lets through."""
    table = np.zeros(int(_LOW) + 1, bool)
    table[(sorted_keys & _LOW).astype(np.int64)] = True
    out = table[(x & _LOW).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.searchsorted(sorted_keys, x[maybe])
    at[at == len(sorted_keys)] = 0
    out[maybe] = sorted_keys[at] == x[maybe]
    return out


def edits_allowed(n: int, s: Settings) -> int:
    return int(s.max_edit * n) if n >= s.min_words else 0


def build_index(ids: list, words: list[np.ndarray], s: Settings) -> Index:
    out = Index(s, ids, words)
    longer = [k for k, w in enumerate(words) if len(w) >= s.min_words]
    for k, w in enumerate(words):
        if 0 < len(w) < s.min_words:
            out.short.setdefault(len(w), []).append(k)
    with np.errstate(over="ignore"):
        for n, items in list(out.short.items()):
            key = np.array([_sequence_key(words[k], n)[0] for k in items], np.uint64)
            order = np.argsort(key, kind="stable")
            out.short[n] = (key[order], [items[i] for i in order])
        for k in longer:
            cut = edits_allowed(len(words[k]), s) + 1
            edge = [len(words[k]) * j // cut for j in range(cut + 1)]
            for x, y in zip(edge, edge[1:]):
                out.pieces.setdefault(y - x, []).append((k, x))
        for n, parts in list(out.pieces.items()):
            key = np.array([_sequence_key(words[k][x:x + n], n)[0] for k, x in parts], np.uint64)
            order = np.argsort(key, kind="stable")
            out.pieces[n] = (key[order], [parts[i] for i in order])
        classes: dict[int, list[int]] = {}
        for k in longer:
            low = s.min_words
            while int(low * s.ratio) + 1 <= len(words[k]):
                low = int(low * s.ratio) + 1
            classes.setdefault(low, []).append(k)
        for r in range(s.repeats):
            rng = np.random.default_rng([s.seed, r])
            head = r % 4  # the first sampled step is shared by all classes
            found, heads = [], set()
            for low, items in sorted(classes.items()):
                steps = int(1.2 * low)
                more = rng.choice(np.arange(head + 1, steps), min(s.samples - 1, steps - head - 1), replace=False)
                picked = [head, *sorted(int(x) for x in more)]
                prefixes = [[] for _ in picked]
                for k in items:
                    w = np.append(words[k], np.full(steps + 1, 0x5151, np.uint64))  # an end mark no document word has
                    i, t, key = np.zeros(1, np.int64), 0, np.zeros(1, np.uint64)
                    for j, step in enumerate(picked):
                        i = _advance(i, w, t, step, r, s.seed)
                        t, key = step, _fold(key, w[i])
                        if not j:
                            heads.add(int(w[i][0] & _U(0xFFFF)))
                        prefixes[j].append(key[0])
                full = np.array(prefixes[-1], np.uint64)
                order = np.argsort(full, kind="stable")
                found.append((picked, [np.unique(np.array(p, np.uint64)) for p in prefixes], full[order], [items[i] for i in order]))
            out.repeats.append(found)
            out.heads.append(np.array(sorted(heads), np.int64))
    return out


def _sequence_key(w: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(max(len(w) - n + 1, 0), np.uint64)
    for j in range(n):
        key = _fold(key, w[j:j + len(key)])
    return key


def _matches(sorted_keys, items, key, at):
    """(window, item) pairs of equal keys."""
    low, high = np.searchsorted(sorted_keys, key), np.searchsorted(sorted_keys, key, "right")
    for w, x, y in zip(at.tolist(), low.tolist(), high.tolist()):
        for z in range(x, y):
            yield w, items[z]


def candidates(h: np.ndarray, index: Index) -> set[tuple[int, int]]:
    """(window start, item) pairs whose sampled walks agree in some repeat, over one run of words."""
    out: set[tuple[int, int]] = set()
    n = len(h)
    if not n:
        return out
    for size, (keys, items) in index.short.items():
        key = _sequence_key(h, size)
        hit = np.flatnonzero(_member(keys, key)) if len(key) else np.zeros(0, int)
        out.update(_matches(keys, items, key[hit], hit))
    most = max((c[0][-1] for classes in index.repeats for c in classes), default=0)
    padded = np.append(h, np.full(most + 1, 0x7272, np.uint64))
    low = (padded & _U(0xFFFF)).astype(np.int64)
    for r, classes in enumerate(index.repeats):
        if not classes:
            continue
        head = classes[0][0][0]
        pointer = np.arange(n, dtype=np.int32)
        bits = shingles.mix(padded, _step_seed(r, index.s.seed, 0))
        for t in range(head):
            pointer += ((bits >> _U(t)) & _U(1)).astype(np.int8)[pointer]
        starts = np.zeros(1 << 16, bool)  # low bits of the words some item shows at the first sampled step
        starts[index.heads[r]] = True
        alive = np.flatnonzero(starts[low][pointer])
        pointer = pointer[alive]
        first = _fold(np.zeros(1, np.uint64), padded[pointer])
        for picked, prefixes, full, items in classes:
            own = _member(prefixes[0], first)
            at, i, key, t = alive[own], pointer[own], first[own], head
            for step, known in zip(picked[1:], prefixes[1:]):
                if not len(at):
                    break
                i = _advance(i, padded, t, step, r, index.s.seed, bits)
                t, key = step, _fold(key, padded[i])
                keep = _member(known, key)
                at, i, key = at[keep], i[keep], key[keep]
            out.update(_matches(full, items, key, at))
    return out


def piece_candidates(h: np.ndarray, first: np.ndarray, index: Index) -> set[tuple[int, int]]:
    """(window start, item) pairs where an unchanged piece of the item stands; a window never begins before its text."""
    out: set[tuple[int, int]] = set()
    for size, (keys, parts) in index.pieces.items():
        key = _sequence_key(h, size)
        hit = np.flatnonzero(_member(keys, key)) if len(key) else np.zeros(0, int)
        begin = first[np.searchsorted(first, hit, "right") - 1]
        for j, (item, x) in _matches(keys, parts, key[hit], np.arange(len(hit))):
            out.add((max(int(hit[j]) - x, int(begin[j])), item))
    return out


def fit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, begin, end) of the stretch of ``text`` nearest to ``item`` (insertions, deletions, replacements)."""
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    steps = np.arange(n + 1)
    for w in item:
        turn = cost[:-1] + (text != w)
        best, origin = cost + 1, begin.copy()  # the item's word left out
        better = turn < best[1:]
        best[1:][better], origin[1:][better] = turn[better], begin[:-1][better]
        low = np.minimum.accumulate(best - steps) + steps  # words of the text put in
        moved = low < best
        if moved.any():
            source = np.maximum.accumulate(np.where(moved, 0, steps))
            origin = np.where(moved, origin[source], origin)
        cost, begin = low, origin
    end = int(cost.argmin())
    return int(cost[end]), int(begin[end]), end


def verified(h: np.ndarray, first: np.ndarray, found: set[tuple[int, int]], index: Index):
    """(text, item, edits, first word, end word), one per text and item: the match with the fewest edits."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for start, item in sorted(found):
        doc = int(np.searchsorted(first, start, "right")) - 1
        w = index.words[item]
        allowed = edits_allowed(len(w), index.s)
        a, b = max(int(first[doc]), start - allowed), min(int(first[doc + 1]), start + len(w) + 2 * allowed)
        if done.get((doc, item), -1) >= b or best.get((doc, item), (1,))[0] == 0:
            continue
        text = h[a:b]
        if len(text) < len(w) - allowed or np.isin(w, text).sum() < len(w) - allowed:
            continue  # each word that is not there costs an edit
        edits, x, y = fit_distance(w, text)
        done[(doc, item)] = b
        if edits <= allowed and edits < best.get((doc, item), (1 << 30,))[0]:
            best[(doc, item)] = (edits, a + x, a + y)
    for (doc, item), (edits, x, y) in sorted(best.items()):
        yield doc, item, edits, x, y


def _blocks(items: DataFrame, s: Settings) -> Iterator[Index]:
    """Indexes of the benchmark, ``block`` items at a time (rows are streamed, never all held)."""
    ids, words = [], []
    for r in items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        ids.append(r["item_id"])
        words += [h for *_, h in ((None, x[2]) for x in texts_words(pa.array([r["text"]])))] or [np.zeros(0, np.uint64)]
        if len(ids) == s.block:
            yield build_index(ids, words, s)
            ids, words = [], []
    if ids:
        yield build_index(ids, words, s)


def find_matches(docs: DataFrame, items: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, item_id, edits, start and end (UTF-8 byte span) of every item found in every document."""
    s = s or Settings()
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("edits", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = None
    for index in _blocks(items, s):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most ``block`` items

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                raw, offsets = shingles.text_buffers(batch.column(1))
                rows = []
                for a, _, h, start, end, first in texts_words(batch.column(1)):
                    with np.errstate(over="ignore"):
                        found = candidates(h, ix) | piece_candidates(h, first, ix)
                    for doc, item, edits, x, y in verified(h, first, found, ix):
                        base = int(offsets[a + doc])
                        rows.append((a + doc, ix.ids[item], edits, int(start[x]) - base if y > x else 0, int(end[y - 1]) - base if y > x else 0))
                if rows:
                    at, item, edits, x, y = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), pa.array(item), pa.array(edits, pa.int32()),
                         pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["doc_id", "item_id", "edits", "start", "end"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean_documents(docs: DataFrame, items: DataFrame, s: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` in which no item is found; all columns stay (judged row by row)."""
    s = s or Settings()
    out, text = docs, docs.columns.index("text")
    for index in _blocks(items, s):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for a, _, h, _, _, first in texts_words(batch.column(text)):
                    with np.errstate(over="ignore"):
                        found = candidates(h, ix) | piece_candidates(h, first, ix)
                    for doc, *_ in verified(h, first, found, ix):
                        keep[a + doc] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
