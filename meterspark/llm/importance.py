"""Target-distribution importance resampling with a position-table CRC.

Words are maximal runs of letters, digits and non-ASCII characters, only A-Z
lower-cased; a feature is a run of 1 to ``width`` consecutive words joined by
one space, and its bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.
Every bucket's gain is the log ratio of its smoothed share in the target texts
(the benchmark) to its share in the corpus; a document's weight is the floored
mean gain of its features.  Gumbel noise from a hash of the key turns the
weights into a sample without replacement: the highest scores are drawn.

The CRC is linear, so a feature's CRC is the XOR of one precomputed
contribution per byte, looked up by (distance from the feature's end, byte), and
a constant of the length; ``numpy.bitwise_xor.reduceat`` folds all features of a
slice at once.  A feature longer than ``DEPTH`` bytes is cut into blocks from its
end, and the blocks are folded after moving each by its distance with doubling
tables, so a word of a megabyte costs as much per byte as any other.

Two narrow scans of the texts: the first gives at most ``buckets`` counts per
task (added up before and after the shuffle), the second the scores.  Only the
gains (``buckets`` integers, a fixed bound) pass through the driver.  Ranks come
from a range partitioning of the drawn rows, so no task holds all of them.

Defined results: NULL or wordless texts have no features, weight 0 and are never
drawn; an empty target gives equal targets for all buckets; a NULL key hashes as
the empty string and sorts first; rows that repeat a key count and are drawn
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterspark.operators.ordered import running_totals

from . import shingles
from .common import stored

#: Distances from a feature's end with table entries of their own; also the block length of longer features.
DEPTH = 64
_CRC_POLYNOMIAL = 0xEDB88320  # fixed value: reflected CRC-32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _zero_byte(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC states after one more zero byte."""
    return (state >> np.uint32(8)) ^ table[state & np.uint32(255)]


def _position_table(depth: int = DEPTH) -> np.ndarray:
    """Contribution of every byte (second axis) at every distance from the end (first axis)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & np.uint32(1), (one >> np.uint32(1)) ^ np.uint32(_CRC_POLYNOMIAL), one >> np.uint32(1))
    rows = [one.astype(np.uint32)]
    for _ in range(depth - 1):
        rows.append(_zero_byte(rows[-1], rows[0]))
    return np.stack(rows)


_TABLE = _position_table()
_FLAT = _TABLE.ravel()
#: ``_DOUBLING[k]``: states after 2**k zero bytes, by place and value of the state's bytes; grown on demand.
_DOUBLING: list[np.ndarray] = [np.stack([_zero_byte(np.arange(256, dtype=np.uint32) << np.uint32(8 * j), _TABLE[0]) for j in range(4)])]


def _moved(state: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][state & np.uint32(255)]
    for j in range(1, 4):
        out = out ^ table[j][(state >> np.uint32(8 * j)) & np.uint32(255)]
    return out


def advance(state: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC states after so many zero bytes each (one table per bit of the counts)."""
    state, left, k = state.astype(np.uint32), zeros.astype(np.int64), 0
    while left.any():
        if k == len(_DOUBLING):
            _DOUBLING.append(_moved(_DOUBLING[-1], _DOUBLING[-1]))
        odd = np.flatnonzero(left & 1)
        if len(odd):
            state[odd] = _moved(state[odd], _DOUBLING[k])
        left, k = left >> 1, k + 1
    return state


def length_constants(n: np.ndarray) -> np.ndarray:
    """CRC-32 of so many zero bytes: what the start value and the final inversion add to a message of that length."""
    ones = np.full(len(n), 0xFFFFFFFF, np.uint32)
    return advance(ones, n) ^ ones


_LENGTH = length_constants(np.arange(DEPTH + 1))


def _folded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the byte contributions of spans of 1 to ``DEPTH`` bytes."""
    if not len(start):
        return np.zeros(0, np.uint32)
    size = end - start
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(begin[-1]) + np.repeat(start - begin[:-1], size)
    place = np.repeat(end - 1, size) - at
    return np.bitwise_xor.reduceat(_FLAT[(place << 8) | data[at]], begin[:-1])


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for every span (spans may overlap; none may be empty)."""
    size = end - start
    out = np.empty(len(size), np.uint32)
    short = size <= DEPTH
    out[short] = _folded(data, start[short], end[short]) ^ _LENGTH[size[short]]
    far = np.flatnonzero(~short)
    if len(far):
        blocks = -(-size[far] // DEPTH)
        first = np.concatenate([[0], np.cumsum(blocks)])
        back = np.repeat(first[1:] - 1, blocks) - np.arange(first[-1])  # blocks between this one and the span's end
        stop = np.repeat(end[far], blocks) - back * DEPTH
        part = _folded(data, np.maximum(stop - DEPTH, np.repeat(start[far], blocks)), stop)
        out[far] = np.bitwise_xor.reduceat(advance(part, back * DEPTH), first[:-1]) ^ length_constants(size[far])
    return out


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray,
              width: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC of every feature of a slice of texts, and the first feature of each text (+ total)."""
    if width == 1:
        return crc32_spans(data, start, end), first
    # the words of all texts, joined by one space each: a feature is one span of this row
    size = end - start
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(begin[-1], 32, np.uint8)
    offset = np.concatenate([[0], np.cumsum(size)])
    run = np.arange(offset[-1])
    joined[run + np.repeat(begin[:-1] - offset[:-1], size)] = data[run + np.repeat(start - offset[:-1], size)]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    crc, owner = [], []
    for w in range(1, width + 1):
        i = np.flatnonzero(doc[:len(doc) - w + 1] == doc[w - 1:]) if len(doc) >= w else np.zeros(0, np.int64)
        crc.append(crc32_spans(joined, begin[i], begin[i + w] - 1) if len(i) else np.zeros(0, np.uint32))
        owner.append(doc[i])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(crc)[order], np.searchsorted(owner[order], np.arange(len(first)))


def text_features(col: pa.Array, buckets: int, width: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a text column: feature buckets, first feature of each text (+ total), words of each text."""
    raw, offsets = shingles.text_buffers(col)
    for a, b in shingles.slices(offsets):
        base = int(offsets[a])
        data = _LOWER[raw[base:int(offsets[b])]]
        start, end, first = shingles.word_spans(data, offsets[a:b + 1] - base, shingles.NOT_ALNUM)
        crc, begin = _features(data, start, end, first, width)
        yield (crc % np.uint32(buckets)).astype(np.int64), begin, np.diff(first)


def bucket_counts(texts: DataFrame, buckets: int, width: int = 1) -> DataFrame:
    """(bucket, n): features per bucket; a task sends at most ``buckets`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for ids, _, _ in text_features(b.column(0), buckets, width):
                total += np.bincount(ids, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(texts: DataFrame, buckets: int, width: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in bucket_counts(texts, buckets, width).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    n, all_t, all_s = len(corpus), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
                     for t, s in zip(target.tolist(), corpus.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, width: int = 1) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every document."""
    kind = docs.schema["doc_id"].dataType
    names = ["n_features", "n_words", "weight"]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, words, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for ids, begin, many in text_features(b.column(1), len(gain), width):
                run_sum = np.concatenate([[0], np.cumsum(gain[ids])])
                size = np.diff(begin)
                n.append(size)
                words.append(many)
                weight.append((run_sum[begin[1:]] - run_sum[begin[:-1]]) // np.maximum(size, 1))
            cols = [pa.array(np.concatenate(x), pa.int64()) for x in (n, words, weight)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_noise(weighed: DataFrame, seed: str = "2024") -> DataFrame:
    """Add ``score``: the weight plus Gumbel noise (in thousandths) from a hash of seed and key."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Add ``rank``: 1, 2, 3... of the drawn rows by falling score, then doc_id; NULL for the rest.

    ``scored`` is read several times: pass a written table.  The lowest drawn score comes from the counts of
    the whole-number scores (as many rows as scores can differ, a few 100,000 whatever the input).
    """
    able = F.col("n_words") >= least_words
    hist = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    above = F.sum("_n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    hist = hist.withColumn("_above", F.coalesce(above, F.lit(0)))
    take = F.floor(F.lit(percent) * F.sum("_n").over(Window.partitionBy()) / 100)
    last = hist.withColumn("_take", take).where(F.col("_above") < F.col("_take")).agg(
        F.min("score").alias("cut"), F.max("_take").alias("take")).first()
    none = F.lit(None).cast("long").alias("rank")
    if last["cut"] is None:
        return scored.select("*", none)
    near = able & (F.col("score") >= last["cut"])
    ranked = running_totals(scored.where(near), [F.desc("score"), F.asc_nulls_first("doc_id")], {"rank": F.lit(1)})
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= last["take"], F.col("rank")).cast("long"))
    return ranked.unionByName(scored.where(~near).select("*", none))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, width: int = 1, percent: int = 10,
             least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, drawn towards the texts of ``target``."""
    gain = gains(_counts(target, buckets, width), _counts(docs, buckets, width))
    scored = stored(with_noise(weigh(docs, gain, width), seed), "importance")
    return draw(scored, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")
