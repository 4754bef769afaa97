"""Exact k-nearest-neighbour regression on several features (M5) by pivot cells.

Training rows belong to the cell of their nearest pivot (a stable sample of
the rows; their number grows with the square root of the table up to
``MAX_PIVOTS``).  Per cell the extreme distances to the pivot, the row count and the k smallest
distances are kept.  They bound a query's k-th distance from above, and the
triangle inequality and the plane between two pivots bound from below what
a cell can offer: a query is sent only to the cells it can gain from.  A cell
is dealt into parts of about ``PART_ROWS`` rows by a hash of the rows, so a hot
cell (many equal rows) is many tasks; every part gives each of its queries the
k best rows it has, and these are merged per query.

Neighbours are ranked by (squared distance, train id).  Rows and queries with a
NULL, NaN or infinite feature, and train rows with a NULL target, take no part;
a query row that repeats in full is one query.  The driver holds pivots and
their cell statistics only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored_table

MAX_PIVOTS = 2048
PART_ROWS = 50_000
#: Room for rounding in the bounds (relative to the distances compared).
_SLACK = 1e-9
_BLOCK = 1 << 22


def _finite(cols: Sequence[str]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf"))) for c in cols])


def _points(batch, first: int, dims: int) -> np.ndarray:
    cols = [batch.column(first + i).to_numpy() if isinstance(batch, pa.Table) else batch.column(first + i).to_numpy(zero_copy_only=False)
            for i in range(dims)]
    return np.column_stack(cols) if len(cols[0]) else np.zeros((0, dims))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of two small blocks, features added in order."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[:, i]
        out += d * d
    return out


def _blocks(x: np.ndarray, width: int) -> Iterator[slice]:
    step = max(1, _BLOCK // max(1, width))
    return (slice(i, i + step) for i in range(0, len(x), step))


def _pivots(train: DataFrame, names: list[str], n: int) -> np.ndarray:
    want = int(min(MAX_PIVOTS, max(1, n ** 0.5)))
    order = F.xxhash64(*names)
    rows = train.select(*names).distinct().orderBy(order, *names).limit(want).collect()
    return np.array([list(r) for r in rows], float).reshape(-1, len(names))


def knn_regress(train: DataFrame, queries: DataFrame, features: Sequence[str], y: str, train_id: str, query_id: str,
                k: int = 10, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, features, prediction, n_neighbors): mean target of the k nearest train rows of every query."""
    features, dims = list(features), len(features)
    names = [f"x{i}" for i in range(dims)]
    point = [F.col(c).cast("double").alias(n) for c, n in zip(features, names)]
    # -0.0 and 0.0 are one point.
    zero = [(F.col(n) + F.lit(0.0)).alias(n) for n in names]
    t = stored_table(train.select(F.col(train_id).cast("long").alias("id"), F.col(y).cast("double").alias("y"), *point)
                     .where(_finite(names) & F.col("y").isNotNull()).select("id", "y", *zero))
    q = queries.select(F.col(query_id).alias("qid"), *point).where(_finite(names)).select("qid", *zero).distinct()
    n = t.count()
    pivots = _pivots(t, names, n)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _points(b, 2, dims)
            cell, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for s in _blocks(x, len(pivots)):
                d = _squared(x[s], pivots)
                cell[s] = d.argmin(axis=1)
                far[s] = np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *b.columns], ["cell", "far", *b.schema.names])

    fields = ", ".join(f"{c} double" for c in names)
    schema = q.schema.fields[0]
    out_type = f"`{query_id}` {schema.dataType.simpleString()}, " + ", ".join(f"`{c}` double" for c in features) \
        + ", prediction double, n_neighbors long"
    if not n:
        return train.sparkSession.createDataFrame([], out_type)
    celled = stored_table(t.mapInArrow(to_cells, f"cell int, far double, id long, y double, {fields}"))

    # The k smallest distances of a cell: k per task and cell first, then per cell.
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, far = np.zeros(0, np.int32), np.zeros(0)
        for b in batches:
            cell = np.concatenate([cell, b.column(0).to_numpy(zero_copy_only=False)])
            far = np.concatenate([far, b.column(1).to_numpy(zero_copy_only=False)])
            order = np.lexsort((far, cell))
            cell, far = cell[order], far[order]
            edge = np.flatnonzero(np.diff(cell, prepend=-1))
            size = np.diff(np.append(edge, len(cell)))
            keep = np.arange(len(cell)) - np.repeat(edge, size) < k
            cell, far = cell[keep], far[keep]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far)], ["cell", "far"])

    low = celled.select("cell", "far").mapInArrow(nearest, "cell int, far double").groupBy("cell").agg(
        F.slice(F.sort_array(F.collect_list("far")), 1, k).alias("low"))  # at most k per task and cell
    stats = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("high"), F.min("far").alias("least")).join(low, "cell")
    rows = stats.collect()
    cells = np.array([r["cell"] for r in rows])
    centre, high, least = pivots[cells], np.array([r["high"] for r in rows]), np.array([r["least"] for r in rows])
    parts = np.array([-(-r["n"] // part_rows) for r in rows])
    smallest = np.full((len(rows), k), np.inf)
    for i, r in enumerate(rows):
        smallest[i, :len(r["low"])] = r["low"]
    between = np.sqrt(_squared(centre, centre))
    between[between == 0] = np.inf

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _points(b, 1, dims)
            for s in _blocks(x, len(cells) * k):
                d = np.sqrt(_squared(x[s], centre))
                upper = (d[:, :, None] + smallest).reshape(len(d), -1)
                bound = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else upper.max(axis=1)
                own = d.argmin(axis=1)
                rows_ = np.arange(len(d))[:, None]
                plane = (d * d - d[rows_, own[:, None]] ** 2) / (2 * between[own])
                lower = np.maximum(np.maximum(d - high, least - d), plane)
                room = bound[:, None] + _SLACK * (d + high + np.where(np.isfinite(bound), bound, 0)[:, None])
                who, c = np.nonzero(lower <= room)
                times = parts[c]
                who, c = np.repeat(who, times), np.repeat(c, times)
                part = np.arange(len(c)) - np.repeat(np.cumsum(times) - times, times)
                got = b.slice(s.start, len(d)).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(cells[c].astype(np.int32)), pa.array(part.astype(np.int32)), *got.columns],
                                                 ["cell", "part", *b.schema.names])

    part_of = {int(c): int(p) for c, p in zip(cells, parts) if p > 1}
    dealt = F.lit(1)
    if part_of:
        dealt = F.coalesce(F.create_map(*[F.lit(v) for kv in part_of.items() for v in kv])[F.col("cell")], F.lit(1))
    left = celled.withColumn("part", F.pmod(F.xxhash64("id", "y", *names), dealt.cast("long")).cast("int"))
    qtype = schema.dataType.simpleString()
    right = q.mapInArrow(send, f"cell int, part int, qid {qtype}, {fields}")

    def search(rows_: pa.Table, asked: pa.Table) -> pa.Table:
        x, ids, ys = _points(rows_.select(names), 0, dims), rows_.column("id").to_numpy(), rows_.column("y").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids, ys = x[order], ids[order], ys[order]
        at = _points(asked.select(names), 0, dims)
        who, best, near = [], [], []
        for s in _blocks(at, len(x)):
            if not len(x):
                break
            d = _squared(at[s], x)
            if len(x) > k:  # all rows up to the k-th distance (ties included), then by (distance, id)
                limit = np.partition(d, k - 1, axis=1)[:, k - 1:k]
                row, col = np.nonzero(d <= limit)
            else:
                row, col = np.nonzero(np.ones(d.shape, bool))
            dist = d[row, col]
            o = np.lexsort((col, dist, row))
            row, col, dist = row[o], col[o], dist[o]
            start = np.searchsorted(row, row)
            keep = np.arange(len(row)) - start < k
            who.append(row[keep] + s.start)
            best.append(col[keep])
            near.append(dist[keep])
        who, best = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (who, best))
        got = asked.select(["qid", *names]).take(pa.array(who))
        return pa.table({**{c: got.column(c) for c in got.schema.names}, "d": np.concatenate(near) if near else np.zeros(0),
                         "id": ids[best], "y": ys[best]})

    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(
        search, f"qid {qtype}, {fields}, d double, id long, y double")
    # A query's candidates: k from each part it was sent to.
    top = found.groupBy("qid", *names).agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "id", "y"))), 1, k).alias("top"))
    total = F.aggregate("top", F.lit(0.0), lambda s, r: s + r["y"])
    return top.select(F.col("qid").alias(query_id), *[F.col(a).alias(b) for a, b in zip(names, features)],
                      (total / F.size("top")).alias("prediction"), F.size("top").cast("long").alias("n_neighbors"))
