"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

Each document is encoded once, ended with ``end_id`` and, only when it is
longer than a sequence, cut from its end into full pieces (the first piece
takes the remainder).  Full pieces are sequences of their own.  The rest are
dealt by a hash of their row number into groups of bounded size (so rows that repeat
a key, or have none, spread as well); within a group pieces are placed in
order of falling length, each into the open sequence whose choice makes the sum
over gaps of (open sequences with that gap) squared smallest; a new sequence
opens only when no open one has room.  Groups pack independently, so the
result grows with the input, and a group of G pieces wastes a few sequences at
most.

Defined results: NULL text counts as empty (one piece holding the end id);
repeated rows are packed each; an empty table gives an empty table; ties are
broken by (length, doc_id, piece); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import stored

#: Pieces packed together in one task.
GROUP_PIECES = 16_384


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size (each below ``capacity``), placed in the order given."""
    open_by_gap = np.zeros(capacity + 1, np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by gap, last opened last
    where, offset, n_bins = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        fits = np.flatnonzero(open_by_gap[s:])
        if len(fits):
            # change of the sum of squares: gap g loses one bin, gap g - s gains one (a full bin leaves the sum)
            gain = np.where(fits > 0, 2 * open_by_gap[fits] + 1, 0) - 2 * open_by_gap[fits + s] + 1
            gap = int(fits[gain.argmin()]) + s
            b = bins[gap].pop()
            open_by_gap[gap] -= 1
        else:
            gap, b = capacity, n_bins
            n_bins += 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            open_by_gap[gap - s] += 1
    return where, offset


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in names[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, out = [], []
            for x, part in tokens.encoded(tokenizer, b.column(1), end_id):
                for i, ids in enumerate(part, x):
                    n = len(ids)
                    first = n if n <= capacity else n % capacity or capacity
                    cuts = [0, *range(first, n + 1, capacity)]
                    for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
                        row.append(i)
                        out.append((k, p, q - p, zlib.crc32(ids[p:q])))
            k, p, n, c = (list(v) for v in zip(*out)) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(k, pa.int32()), pa.array(p, pa.int64()),
                 pa.array(n, pa.int64()), pa.array(c, pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(pieces_: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (columns doc_id, piece, length, ...)."""
    small = pieces_.where(F.col("length") < capacity)
    n = small.count()
    groups = max(1, -(-n // group_pieces))
    full = pieces_.where(F.col("length") >= capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = T.StructType([*pieces_.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces_.columns

    def run(table: pa.Table) -> pa.Table:
        g = table.column("_group")[0].as_py()
        table = table.drop_columns(["_group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        b, o = sum_of_squares(table.column("length").to_numpy(), capacity)
        table = table.append_column("sequence_id", pa.array(b + (g << 32), pa.int64()))
        return table.append_column("offset", pa.array(o, pa.int64()))

    dealt = small.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(run, schema).select(*names, "sequence_id", "offset").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Encode, cut and pack; the table of pieces is written once, so texts are encoded once."""
    return pack(stored(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity, group_pieces)
