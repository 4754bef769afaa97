"""Random forests on cells of equal bins (M6).

Spark ML's forest keeps, for every training row, its bins and one count per tree, and every level of the trees goes over
all rows.  Rows that agree in all bins stand in the same node of every tree, so here a level goes over the different
cells: a cell's share in a tree is the number of its drawn rows and the sum of their labels.  The draws (per row and tree
a Poisson number with mean 1, as there) are made anew in every pass from a seed per block of rows, so what is stored is
the bins of a cell and 8 bytes a row.  Trees are grown by ``boosting``: levels of large nodes by histograms, then
everything below a node of few cells in one task, all trees in the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, stored_at
from . import boosting

#: Rows of one block, and cells that are put down the trees at once.
BLOCK, UNITS = 1 << 14, 1 << 16
_BLOCKS = "id long, cells long, bins binary, sizes binary, ys binary"


def blocks(df: DataFrame, features: Sequence[str], label: str, edges: Sequence[np.ndarray]) -> tuple[DataFrame, str]:
    """The rows in the order of their bins, in blocks of cells (bins and rows of each) with the labels of all rows; its folder."""
    rows, path = boosting.binned_in_order(df, features, label, edges)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in boosting._blocks(batches, BLOCK):
            first = boosting._runs(b.column(0), len(edges))
            sizes = np.diff(np.append(first, b.num_rows)).astype(np.int32)
            bins = b.column(0).take(pa.array(first))
            x = np.ascontiguousarray(boosting._matrix(bins, np.uint8, len(edges)))
            y = np.ascontiguousarray(b.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(first)]), *(pa.array([v.tobytes()], pa.binary()) for v in (x, sizes, y))],
                                             ["id", "cells", "bins", "sizes", "ys"])
            number += 1

    out = stored_at(rows.mapInArrow(packed, _BLOCKS))
    drop_stored(df.sparkSession, path)
    return out


def _drawn(batches: Iterator[pa.RecordBatch], width: int, trees: int, seed: int, bootstrap: bool):
    """(bins, label sums per tree, drawn rows per tree) of the cells, about ``UNITS`` at a time."""
    held, cells = [], 0
    for b in batches:
        for id_, n, *parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *b.columns[2:]):
            x, sizes, y = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(parts, (np.uint8, np.int32, np.float64)))
            at = np.append(0, np.cumsum(sizes)[:-1])
            if bootstrap:
                drawn = np.random.default_rng((seed, id_)).poisson(1.0, (trees, len(y)))
            else:
                drawn = np.ones((trees, len(y)), np.int64)
            held.append((x.reshape(-1, width), np.add.reduceat(drawn * y, at, axis=1), np.add.reduceat(drawn, at, axis=1).astype(float)))
            cells += n
            if cells >= UNITS:
                yield tuple(np.concatenate(v, axis=int(i > 0)) for i, v in enumerate(zip(*held)))
                held, cells = [], 0
    if held:
        yield tuple(np.concatenate(v, axis=int(i > 0)) for i, v in enumerate(zip(*held)))


def _units(batches: Iterator[pa.RecordBatch], chosen: Sequence[int], width: int, trees: int, seed: int, bootstrap: bool):
    """(tree, bins, gradient, rows) of the cells of which a chosen tree has drawn rows."""
    for x, sums, n in _drawn(batches, width, trees, seed, bootstrap):
        for m in chosen:
            live = np.flatnonzero(n[m])
            if len(live):
                yield m, x[live], -sums[m, live], n[m, live]


def fit(df: DataFrame, features: Sequence[str], label: str, trees: int = 50, depth: int = 10, bins: int = 32, min_child: float = 1.0,
        seed: int = 6, bootstrap: bool = True, small: int = boosting.SMALL_CELLS) -> boosting.Booster:
    """A forest as Spark ML's ``RandomForestRegressor`` fits it with all features in every node.

    Every tree is grown by loss of variance on its own draw of the rows (all rows without ``bootstrap``); a prediction is the
    mean of the trees.  Missing values are higher than all others; training rows without a label or a feature are an error,
    as there.  Beyond ``boosting.EXACT_ROWS`` rows split points come from quantiles of all rows (Spark ML: of a sample).
    """
    features = list(features)
    s = boosting.Settings(rounds=trees, depth=depth, rate=1.0 / trees, alpha=0.0, lam=0.0, column_share=1.0, min_child=min_child,
                          base=0.0, bins=bins, seed=seed, loss="absolute")
    n = boosting.whole_rows(df, features, label)
    booster = boosting.Booster(features, boosting.split_points(df, features, bins, n), s, label=label)
    table, path = blocks(df, features, label, booster.edges)
    cells = table.agg(F.sum("cells")).first()[0]
    units = partial(_units, width=len(features), trees=trees, seed=seed, bootstrap=bootstrap)
    grown = boosting._round(table, units, dict.fromkeys(range(trees), cells), trees, s.columns(len(features), 0), s, small)
    booster.trees = [[t] for t in grown]
    drop_stored(df.sparkSession, path)
    return booster
