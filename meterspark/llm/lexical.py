"""Ranked lexical search by pipelined term partitioning.

Terms are maximal runs of letters, digits and non-ASCII characters, only A-Z
lower-cased.  Every term has one owner: the stage that holds its postings.
Item bundles pass through the owners one after another, rarest terms first, and
carry sparse accumulators (document, partial score); each owner meets the
bundles in a cogroup and adds the whole-number contributions of its terms.
After the last owner the best documents of every item are selected.

Postings are dealt by owner *and* by segment of about ``SEGMENT_BYTES`` of text,
so the list of a very frequent term is spread over the segments and a task
holds one segment of one owner with one block of items.  Between stages an accumulator is
dropped only when even the largest possible contribution of the owners still to
come cannot lift it to the ``k``-th best partial score of its segment, and a
document that no earlier owner has seen is admitted unless the same holds for
it; contributions are never negative, so the result is exact.

One scan of the texts keeps the postings of terms that may occur in an item:
those whose hash is set in a bitmap of fixed size (``BITMAP_BITS``; its bound does
not grow with the items).  Hashes only find words quickly: words of equal hash are
compared by their bytes, and postings, weights and bundles meet by the term itself.

Defined results: NULL or termless texts are not counted and never found; items
without known terms give no rows; every row of the items table is ranked on its
own (NULL or repeated ids included); rows that repeat a doc_id are found each, a NULL doc_id
sorts first among equal scores; empty tables give an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles
from .common import stored

SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 1 << 14
BITMAP_BITS = 23
#: Items that travel in one bundle.
BLOCK_ITEMS = 256
#: Segments that one copy of the bundles serves when they are dealt out.
COPY_SEGMENTS = 64
#: Owners by share of the documents that hold a term: up to 2 %, up to 20 %, above.
BANDS = (0.02, 0.2)
#: No occurrence count gives more than this per unit of weight.
MOST_PER_WEIGHT = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap holds the leading bits of these hashes."""
    at = (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _grouped(data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Term number of every word, and the terms: words of one hash are one term only if their bytes are equal."""
    _, one, group = np.unique(h, return_index=True, return_inverse=True)
    size = end - start
    same = size == size[one][group]
    at = np.concatenate([[0], np.cumsum(size)])
    if same.all() and at[-1]:
        place = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
        twin = np.arange(at[-1]) + np.repeat(start[one][group] - at[:-1], size)
        same = data[place] == data[twin]
    if not same.all():  # a collision: group this segment's words by their bytes
        words = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist())]
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
        return group, list(number)
    return group, [data[a:b].tobytes() for a, b in zip(start[one].tolist(), end[one].tolist())]


def postings(raw: np.ndarray, offsets: np.ndarray, bits: np.ndarray | None, mask: int = (1 << 64) - 1):
    """Terms (bytes, hash), documents holding each, documents and counts of each, and terms per document of a slice of texts."""
    base = int(offsets[0])
    data = _LOWER[raw[base:int(offsets[-1])]]
    many, found = [], []
    for a, b in shingles.slices(offsets):
        with np.errstate(over="ignore"):
            h, start, end, first = shingles.words(raw, offsets[a:b + 1], shingles.NOT_ALNUM)
        h = h & np.uint64(mask)
        many.append(np.diff(first))
        doc = np.repeat(np.arange(a, b), many[-1])
        keep = slice(None) if bits is None else np.flatnonzero(_marked(bits, h))
        found.append((h[keep], doc[keep], start[keep] - base, end[keep] - base))
    n = np.concatenate(many) if many else np.zeros(0, np.int64)
    if not len(n) or not sum(len(x[0]) for x in found):
        return [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n
    h, doc, start, end = (np.concatenate(x) for x in zip(*found))
    group, terms = _grouped(data, h, start, end)
    key_of = np.zeros(len(terms), np.uint64)
    key_of[group] = h
    pair, tf = np.unique(group * len(n) + doc, return_counts=True)
    df = np.bincount(pair // len(n), minlength=len(terms))
    return terms, key_of, df, pair % len(n), tf, n


def _segments(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in shingles.slices(offsets, SEGMENT_BYTES):
        for x in range(a, b, SEGMENT_DOCS):
            yield x, min(b, x + SEGMENT_DOCS)


def _strings(terms: list[bytes]) -> pa.Array:
    return pa.array([t.decode("utf-8", "replace") for t in terms], pa.string())


def _one(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """A list column with one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def item_terms(items: DataFrame, mask: int = (1 << 64) - 1) -> DataFrame:
    """(_item, item_id, term, hash, times): the terms of every item; a row of ``items`` is an item of its own."""
    kind = items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("_item", T.LongType()), T.StructField("item_id", kind), T.StructField("term", T.StringType()),
                           T.StructField("hash", T.LongType()), T.StructField("times", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = shingles.text_buffers(b.column(2))
            for x, y in _segments(offsets):
                terms, key, df, doc, tf, _ = postings(raw, offsets[x:y + 1], None, mask)
                at = np.repeat(np.arange(len(terms)), df)
                row = pa.array(doc + x, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), _strings(terms).take(pa.array(at, pa.int64())),
                     pa.array(key.view(np.int64)[at], pa.int64()), pa.array(tf, pa.int64())], schema.names)

    return items.select(F.monotonically_increasing_id().alias("_item"), "item_id", "text").mapInArrow(run, schema)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the leading bits of column ``hash`` (at most 2**BITMAP_BITS bits, whatever the number of rows)."""
    place = F.shiftrightunsigned("hash", 64 - BITMAP_BITS).cast("long") + 1  # Spark's bitmaps count from 1
    rows = (hashes.select(place.alias("p"))
            .groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows.collect():  # a fixed number of 4,096-byte pieces
        out[(r["k"] - 1) * 4096:][:4096] = np.frombuffer(r["m"], np.uint8)
    return out


def index(docs: DataFrame, bits: np.ndarray, mask: int = (1 << 64) - 1) -> DataFrame:
    """One row per segment: its documents, their lengths, and the postings of the terms the bitmap may hold."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("n_docs", T.LongType()),
        T.StructField("n_terms", T.LongType()), T.StructField("lengths", T.BinaryType()), T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("dfs", T.ArrayType(T.LongType())),
        T.StructField("docs", T.BinaryType()), T.StructField("tfs", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for b in batches:
            raw, offsets = shingles.text_buffers(b.column(1))
            for x, y in _segments(offsets):
                terms, key, df, doc, tf, n = postings(raw, offsets[x:y + 1], bits, mask)
                ids = b.column(0).slice(x, y - x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int64()), _one(ids, ids.type), pa.array([int((n > 0).sum())], pa.int64()),
                     pa.array([int(n.sum())], pa.int64()), pa.array([n.astype("<i8").tobytes()], pa.binary()),
                     _one(_strings(terms), pa.string()), _one(pa.array(key.view(np.int64)), pa.int64()), _one(pa.array(df), pa.int64()),
                     pa.array([doc.astype("<u2").tobytes()], pa.binary()), pa.array([tf.astype("<u4").tobytes()], pa.binary())],
                    schema.names)
                segment += 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def weigh(indexed: DataFrame, terms: DataFrame, n_docs: int, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(term, hash, weight, owner) of every term that items and documents share."""
    df = (indexed.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select("t.terms", "t.dfs")
          .groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df")))
    ratio = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)
    owner = sum((F.when(F.col("df") > F.lit(b * n_docs), 1).otherwise(0) for b in bands), F.lit(0))
    known = df.join(terms.select("term", "hash").distinct(), "term")
    return known.select("term", "hash", F.floor(1000 * F.log(ratio)).alias("weight"), owner.cast("int").alias("owner"))


def bundles(terms: DataFrame, weights: DataFrame, blocks: int) -> DataFrame:
    """One row per block of items: the items, how many terms each has, and the terms with gain (weight x times) and owner."""
    each = (terms.select("_item", "term", "times").join(weights, "term").groupBy("_item")
            .agg(F.array_sort(F.collect_list(F.struct("term", (F.col("weight") * F.col("times")).alias("gain"), "owner"))).alias("t")))
    block = F.pmod(F.xxhash64("_item"), F.lit(blocks)).cast("int").alias("block")
    got = each.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("_item", "t"))).alias("i"))
    flat = F.flatten(F.col("i.t"))
    return got.select("block", F.col("i._item").alias("items"), F.transform("i", lambda x: F.size(x["t"]).cast("long")).alias("sizes"),
                      flat["term"].alias("terms"), flat["gain"].alias("gains"), flat["owner"].alias("owners"))


def _dealt(bundled: DataFrame, indexed: DataFrame, blocks: int, segments: int) -> DataFrame:
    """Every bundle for every segment: copies of the bundles, each meeting ``COPY_SEGMENTS`` segments."""
    copies = -(-segments // COPY_SEGMENTS)
    where = indexed.select("segment", F.pmod(F.xxhash64("segment"), F.lit(copies)).alias("copy"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    copied = bundled.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
    blank = F.lit(b"").cast("binary")
    return where.join(copied, ["block", "copy"]).select(
        "segment", "block", "items", "sizes", "terms", "gains", "owners", blank.alias("acc_sizes"), blank.alias("acc_docs"),
        blank.alias("acc_scores"))


def _owned(indexed: DataFrame, bits: np.ndarray, blocks: int) -> DataFrame:
    """Postings of one owner: the terms whose hash its bitmap may hold, once per block of items."""
    schema = T.StructType([f for f in indexed.schema.fields if f.name not in ("n_docs", "n_terms")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                col = dict(zip(one.schema.names, one.columns))
                key = col["hashes"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                df = col["dfs"].flatten().to_numpy(zero_copy_only=False)
                keep = _marked(bits, key) if len(key) else np.zeros(0, bool)
                each = np.repeat(keep, df)
                pick = pa.array(np.flatnonzero(keep), pa.int64())
                doc = np.frombuffer(col["docs"][0].as_py(), "<u2")[each]
                tf = np.frombuffer(col["tfs"][0].as_py(), "<u4")[each]
                yield pa.RecordBatch.from_arrays(
                    [col["segment"], col["doc_ids"], col["lengths"], *(_one(col[c].flatten().take(pick), col[c].type.value_type)
                     for c in ("terms", "hashes", "dfs")), pa.array([doc.tobytes()], pa.binary()), pa.array([tf.tobytes()], pa.binary())],
                    schema.names)

    out = indexed.select(*schema.names).mapInArrow(run, schema)
    return out.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _least_kept(scores: np.ndarray, k: int) -> int:
    """The ``k``-th best score, or 0 with fewer scores."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def contributions(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Contribution per unit of weight of ``tf`` occurrences in a document of ``n`` terms."""
    m = 25 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _stage(owner: int, last: bool, n_docs: int, n_terms: int, k: int, kind: pa.DataType):
    """The cogroup of one owner: bundles of one segment and block with the owner's postings of that segment."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(last, kind, left)
        lists = {c: left.column(c).combine_chunks().flatten() for c in ("items", "sizes", "terms", "gains", "owners")}
        length = np.frombuffer(right.column("lengths")[0].as_py(), "<i8")
        doc = np.frombuffer(right.column("docs")[0].as_py(), "<u2").astype(np.int64)
        tf = np.frombuffer(right.column("tfs")[0].as_py(), "<u4").astype(np.int64)
        df = right.column("dfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        part = contributions(tf, length[doc], n_docs, n_terms)
        begin = np.concatenate([[0], np.cumsum(df)])
        number = {t: i for i, t in enumerate(right.column("terms").combine_chunks().flatten().to_pylist())}
        owners, gains = (lists[c].to_numpy(zero_copy_only=False) for c in ("owners", "gains"))
        terms = lists["terms"].to_pylist()
        edge = np.concatenate([[0], np.cumsum(lists["sizes"].to_numpy(zero_copy_only=False))]).astype(int)
        acc_n = np.frombuffer(left.column("acc_sizes")[0].as_py(), "<i8")
        acc_doc = np.frombuffer(left.column("acc_docs")[0].as_py(), "<u2")
        acc_score = np.frombuffer(left.column("acc_scores")[0].as_py(), "<i8")
        acc_at = np.concatenate([[0], np.cumsum(acc_n)]) if len(acc_n) else np.zeros(len(edge), np.int64)
        ids = right.column("doc_ids").combine_chunks().flatten()
        place = np.empty(len(ids), np.int64)  # position of every document in the order of doc_id, NULL first
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        docs_out, scores_out, item_out = [], [], []
        for i, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            score = np.zeros(len(length), np.int64)
            had, before = acc_doc[acc_at[i]:acc_at[i + 1]], acc_score[acc_at[i]:acc_at[i + 1]]
            score[had] = before
            still = int(gains[a:b][owners[a:b] >= owner].sum()) * MOST_PER_WEIGHT
            for j in range(a, b):
                t = number.get(terms[j]) if owners[j] == owner else None
                if t is not None:
                    at = slice(begin[t], begin[t + 1])
                    score[doc[at]] += gains[j] * part[at]  # a document is once in a term's list
            if _least_kept(before, k) > still:  # no newcomer can reach the best ``k`` any more
                seen = np.zeros(len(score), bool)
                seen[had] = True
                score[~seen] = 0
            to_come = int(gains[a:b][owners[a:b] > owner].sum()) * MOST_PER_WEIGHT
            held = np.flatnonzero(score > 0)
            held = held[score[held] + to_come >= _least_kept(score[held], k)]
            if last:
                held = held[np.lexsort((place[held], -score[held]))[:k]]
            docs_out.append(held)
            scores_out.append(score[held])
            item_out.append(len(held))
        joined = np.concatenate(docs_out) if docs_out else np.zeros(0, np.int64)
        total = np.concatenate(scores_out) if scores_out else np.zeros(0, np.int64)
        if last:
            item = np.repeat(lists["items"].to_numpy(zero_copy_only=False), item_out)
            return pa.table({"_item": pa.array(item, pa.int64()), "doc_id": ids.take(pa.array(joined, pa.int64())),
                             "score": pa.array(total, pa.int64())})
        packed = (np.array(item_out, "<i8"), joined.astype("<u2"), total.astype("<i8"))
        out = left.select([c for c in left.column_names if not c.startswith("acc_")])
        for name, x in zip(("acc_sizes", "acc_docs", "acc_scores"), packed):
            out = out.append_column(name, pa.array([x.tobytes()], pa.binary()))
        return out

    return run


def _empty(last: bool, kind: pa.DataType, left: pa.Table) -> pa.Table:
    if last:
        return pa.table({"_item": pa.array([], pa.int64()), "doc_id": pa.array([], kind), "score": pa.array([], pa.int64())})
    return left  # a segment without postings of this owner: the bundle passes on as it is


def search(docs: DataFrame, items: DataFrame, k: int = 10, bands: tuple[float, ...] = BANDS, block_items: int = BLOCK_ITEMS,
           mask: int = (1 << 64) - 1) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item (score above 0).

    ``mask`` keeps only some bits of the word hashes (tests force collisions with it).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    id_type, doc_type = items.schema["item_id"].dataType, docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item_id", id_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type),
                           T.StructField("score", T.LongType())])
    terms = stored(item_terms(items, mask), "item-terms")
    indexed = stored(index(docs, bitmap(terms), mask), "postings")
    size = indexed.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t"), F.count(F.lit(1)).alias("s")).first()
    n_items = terms.select("_item").distinct().count()
    if not n_items or not size["t"]:
        return spark.createDataFrame([], schema)
    blocks = -(-n_items // block_items)
    weights = stored(weigh(indexed, terms, size["d"], bands), "term-weights")
    state = _dealt(bundles(terms, weights, blocks), indexed, blocks, size["s"])
    kind = to_arrow_type(doc_type)
    for owner in range(len(bands) + 1):
        last = owner == len(bands)
        mine = _owned(indexed, bitmap(weights.where(F.col("owner") == owner)), blocks)
        out = T.StructType([T.StructField("_item", T.LongType()), schema["doc_id"], schema["score"]]) if last else state.schema
        state = (state.groupBy("segment", "block").cogroup(mine.groupBy("segment", "block"))
                 .applyInArrow(_stage(owner, last, size["d"], size["t"], k, kind), out))
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(terms.select("_item", "item_id").distinct(), "_item").select(*schema.names)
