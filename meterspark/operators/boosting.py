"""Second-order gradient boosting over a binned table, many models in one run (M9-M11).

Features are quantised once (missing values are bin 0).  Rows with equal bins have
one margin in every model, so they are summed up to one cell, and the stored table
has for every cell and model the number of rows and the sum of their gradients: a
pass takes as long as there are different cells (at most the rows).  Bit m of a mask
says whether a row trains model m, so one pass over the table serves every model: one per meter,
or one per (training size, fold) of a learning curve.  When the columns drawn
for a round have few cells, the round is one job: tasks add gradients and
counts per (model, cell), the sums are merged, and each tree is grown from its
cells in a task.  Otherwise a level of all trees is one job: tasks add gradients and counts per (model, node, feature, bin) in
arrays, send one packed histogram per (model, node), and the histograms are
merged and the best cut is chosen per (model, node) in tasks.  Nodes that hold
at most ``SMALL`` cells wait until no larger one is open; then the cells of each
meet in one task, which finishes the subtree, all of them in one job.  The
driver gets one row per node.  Every ``REFRESH`` rounds the gradients are stored anew, so
a lost executor repeats a task and never an earlier round.

Objective: squared error with L1 (``alpha``) and L2 (``lam``) on the leaves.  A
node with gradient sum G over H rows is worth T(G)^2 / (H + lam) with
T(G) = sign(G) * max(|G| - alpha, 0), and a leaf predicts -T(G) / (H + lam).
Missing values go to the side that gains more (absolute error: see ``fit_absolute``).  ``column_share`` of the features
is drawn per tree.

Sizes: a task holds open nodes x drawn features x bins pairs of numbers per
model, a cell 16 bytes per model; models are limited to ``MAX_MODELS``.  Rows without a label train
nothing.  A model without training rows predicts ``base``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..session import drop_stored, stored_at, stored_table

MAX_MODELS = 62
REFRESH = 10
#: Cells up to which a node's subtree is finished in one task.
SMALL = 1 << 16
#: A split has to gain more than this.
MIN_GAIN = 1e-6
#: Cells of the drawn columns up to which a round is one pass (over all models of one job).
CUBE = 1 << 22
#: Leaf values kept as lookup tables in one task.
LOOKUP = 1 << 24
#: Rows per task of a table of sorted rows, and numbers of one kind that a task holds of the cells it reads.
TASK_ROWS, TASK_SUMS = 1 << 22, 1 << 21
_TABLE = "bins binary, ns binary, gs binary"


@dataclass(frozen=True)
class Settings:
    """Defaults are the reference's settings for this model (fixed values), ``lam`` to ``base`` its library's defaults."""

    rounds: int = 100
    depth: int = 10
    rate: float = 0.1
    alpha: float = 10.0
    column_share: float = 0.3
    lam: float = 1.0
    min_child: float = 1.0
    base: float = 0.5
    bins: int = 64
    seed: int = 6
    #: "squared" or "absolute" (see ``fit_absolute``)
    loss: str = "squared"

    @property
    def high(self) -> bool:
        """Missing values count as higher than all others (and are no bin of their own)."""
        return self.loss == "absolute"

    @property
    def min_gain(self) -> float:
        return 0.0 if self.loss == "absolute" else MIN_GAIN

    def gain(self, gl, hl, g, h):
        """What a node (g, h) gains by a cut with (gl, hl) on the left."""
        if self.loss == "absolute":  # loss of variance, for targets of square 1
            whole, left, right = ((n - s * s / np.maximum(n, 1)) / np.maximum(n, 1) for s, n in ((g, h), (gl, hl), (g - gl, h - hl)))
            return whole - hl / h * left - (h - hl) / h * right
        return 0.5 * (self.worth(gl, hl) + self.worth(g - gl, h - hl) - self.worth(g, h))

    def worth(self, g, h):
        t = np.maximum(np.abs(g) - self.alpha, 0.0)
        return t * t / (h + self.lam)

    def leaf(self, g: float, h: float) -> float:
        return float(-np.sign(g) * max(abs(g) - self.alpha, 0.0) / (h + self.lam) * self.rate)

    def columns(self, n: int, round_: int) -> np.ndarray:
        """Features of the trees of a round (the same for every model)."""
        take = max(1, int(self.column_share * n))
        return np.sort(np.random.default_rng((self.seed, round_)).permutation(n)[:take])


class Tree:
    """A binary tree in heap order: node i has the children 2i + 1 (bins up to the cut) and 2i + 2."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature, self.cut = np.full(n, -1, np.int16), np.zeros(n, np.uint8)
        self.missing_left, self.value = np.zeros(n, bool), np.zeros(n)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Node that each row of bins ends in."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            rows = rows[self.feature[node[rows]] >= 0]
            if not len(rows):
                break
            at = node[rows]
            b = x[rows, self.feature[at]]
            left = np.where(b == 0, self.missing_left[at], b <= self.cut[at])
            node[rows] = 2 * at + 2 - left
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.place(x)]

    def cells(self, cols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The prediction of every cell of the columns that the tree reads: every leaf fills its box."""
        out, where = np.empty(sizes[cols]), {int(c): j for j, c in enumerate(cols)}
        todo = [(0, [np.arange(n) for n in out.shape])]
        while todo:
            node, box = todo.pop()
            if self.feature[node] < 0:
                out[np.ix_(*box)] = self.value[node]
                continue
            j = where[int(self.feature[node])]
            left = np.where(box[j] == 0, self.missing_left[node], box[j] <= self.cut[node])
            for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
                if side.any():
                    todo.append((child, [*box[:j], box[j][side], *box[j + 1:]]))
        return out.ravel()


class Steps:
    """Adds the trees of some rounds to margins.

    The trees of a round read the drawn columns only, so their leaf values form a table (cell, model) over the cells of
    these columns.  It is made when the rows scored so far make up for it; the tables together hold at most ``LOOKUP`` values.
    """

    def __init__(self, rounds: Sequence[tuple[np.ndarray, list[Tree]]], sizes: np.ndarray):
        self.rounds, self.sizes = rounds, sizes
        self.room, self.seen, self.tables = LOOKUP, 0, {}

    def _table(self, i: int) -> np.ndarray | None:
        cols, trees = self.rounds[i]
        n = float(np.prod(self.sizes[cols].astype(float)))
        if i not in self.tables and n * len(trees) <= self.room and min(n, 1 << 15) * len(trees) <= self.seen:
            if n > 1 << 15:
                found = [t.cells(cols, self.sizes) for t in trees]
            else:
                x = np.zeros((int(n), len(self.sizes)), np.uint8)
                x[:, cols] = np.column_stack(np.unravel_index(np.arange(int(n)), self.sizes[cols]))
                found = [t.predict(x) for t in trees]
            self.tables[i] = np.column_stack(found)
            self.room -= self.tables[i].size
        return self.tables.get(i)

    def add(self, x: np.ndarray, at: dict[int, np.ndarray], out: dict[int, np.ndarray]) -> None:
        """Add to ``out[m]`` what model m says on the rows ``at[m]``."""
        self.seen += sum(map(len, at.values()))
        for i, (cols, trees) in enumerate(self.rounds):
            table = self._table(i)
            code = None if table is None else _codes(x, cols, self.sizes)
            for m, rows in at.items():
                if len(rows):
                    out[m] = out[m] + (trees[m].predict(x[rows]) if table is None else table[code[rows], m])

    def sums(self, x: np.ndarray, models: int) -> np.ndarray:
        """What every model says on every row of bins: (row, model)."""
        self.seen += len(x) * models
        out = np.zeros((len(x), models))
        for i, (cols, trees) in enumerate(self.rounds):
            table = self._table(i)
            if table is None:
                for m, t in enumerate(trees):
                    out[:, m] += t.predict(x)
            else:
                out += table.take(_codes(x, cols, self.sizes), axis=0)
        return out


def _codes(x: np.ndarray, cols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    code = np.zeros(len(x), np.int64)
    for c in cols:
        code = code * int(sizes[c]) + x[:, c]
    return code


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The batches, joined to about ``rows`` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _bits(mask: np.ndarray, models: int) -> dict[int, np.ndarray]:
    return {m: np.flatnonzero(mask >> m & 1) for m in range(models)}


@dataclass
class Booster:
    features: list[str]
    edges: list[np.ndarray]
    settings: Settings
    trees: list[list[Tree]] = field(default_factory=list)  # per round, one tree per model
    label: str = ""

    def save(self, path: str) -> None:
        """Write edges, settings and trees to ``path`` as one Parquet row per round, replacing what is there."""
        head = json.dumps([self.features, [e.tolist() for e in self.edges], asdict(self.settings), self.label])
        rows = [(i, head if i < 0 else json.dumps([[t.depth, t.feature.tolist(), t.cut.tolist(), t.missing_left.tolist(), t.value.tolist()]
                                                   for t in self.trees[i]])) for i in range(-1, len(self.trees))]
        SparkSession.active().createDataFrame(rows, "round int, content string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> Booster | None:
        """The model that ``save`` wrote, or None if ``path`` holds something else."""
        try:
            rows = SparkSession.active().read.schema("round int, content string").parquet(path).orderBy("round").collect()
        except AnalysisException:
            return None
        if not rows:
            return None
        features, edges, settings, label = json.loads(rows[0]["content"])
        trees = []
        for r in rows[1:]:
            trees.append([])
            for depth, *arrays in json.loads(r["content"]):
                t = Tree(depth)
                t.feature[:], t.cut[:], t.missing_left[:], t.value[:] = arrays
                trees[-1].append(t)
        return cls(features, [np.array(e) for e in edges], Settings(**settings), trees, label)

    def predict(self, df: DataFrame, keep: Sequence[str], model: Column | None = None) -> DataFrame:
        """``keep`` and ``prediction``; ``model`` is the number of the model that scores a row (NULL: ``base``)."""
        edges, base, n, high, rounds, sizes = self.edges, self.settings.base, len(keep), self.settings.high, self.rounds(), self.sizes()
        rows = df.select(*keep, (F.lit(0) if model is None else model).cast("int").alias("_model"),
                         *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            steps = Steps(rounds, sizes)
            for b in batches:
                x = _bins([b.column(n + 1 + i) for i in range(len(edges))], edges, b.num_rows, high)
                who = b.column(n).fill_null(-1).to_numpy(zero_copy_only=False)
                out = np.full(b.num_rows, base)
                at = {m: np.flatnonzero(who == m) for m in np.unique(who[who >= 0])}
                more = {m: np.zeros(len(rows)) for m, rows in at.items()}
                steps.add(x, at, more)
                for m, rows in at.items():
                    out[rows] += more[m]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(out)], [*keep, "prediction"])

        schema = df.select(*keep, F.lit(0.0).alias("prediction")).schema
        return rows.mapInArrow(run, schema)

    def rounds(self) -> list[tuple[np.ndarray, list[Tree]]]:
        return [(self.settings.columns(len(self.edges), i), r) for i, r in enumerate(self.trees)]

    def sizes(self) -> np.ndarray:
        """Bins of every feature, the missing one included."""
        return np.array([len(e) + 2 for e in self.edges], np.int64)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.predict(df, df.columns)

    def losses(self, df: DataFrame, label: str) -> list[float]:
        """Mean squared (or absolute) error on ``df`` after each round of the first model, in one pass."""
        edges, trees, base, high = self.edges, [r[0] for r in self.trees], self.settings.base, self.settings.high
        rows = df.where(F.col(label).isNotNull()).select(
            F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(len(trees)), 0
            for b in batches:
                x = _bins([b.column(1 + i) for i in range(len(edges))], edges, b.num_rows, high)
                rest = base - b.column(0).to_numpy(zero_copy_only=False)
                n += b.num_rows
                for i, t in enumerate(trees):
                    rest = rest + t.predict(x)
                    total[i] += np.abs(rest).sum() if high else rest @ rest
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(trees))), pa.array(total), pa.array(np.full(len(trees), n))],
                                             ["i", "s", "n"])

        got = rows.mapInArrow(run, "i long, s double, n long").groupBy("i").agg(
            F.try_divide(F.sum("s"), F.sum("n")).alias("loss")).orderBy("i").collect()
        return [r["loss"] for r in got]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper ends of all bins but the last of every feature: approximate quantiles, one pass over the rows."""
    if not 2 <= bins <= 255:
        raise ValueError("bins must lie in 2..255")
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), cuts, F.lit(10_000)).alias(f"e{i}")
                   for i, c in enumerate(features)]).first()
    return [np.unique(np.array(v or [], float)) for v in row]


def _bins(columns: Sequence[pa.Array], edges: Sequence[np.ndarray], n: int, high: bool = False) -> np.ndarray:
    out = np.zeros((n, len(edges)), np.uint8)
    for i, (c, e) in enumerate(zip(columns, edges)):
        v = c.cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isnan(v) & (not high), 0, np.searchsorted(e, v, "left") + 1)
    return out


def _packed(a: np.ndarray) -> pa.Array:
    """Rows of a matrix as one binary value each."""
    width = a.shape[1] * a.itemsize
    offsets = np.arange(len(a) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(a))])


def _matrix(a: pa.Array, kind, width: int) -> np.ndarray:
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    raw = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(a) else np.zeros(0, np.uint8)
    return raw.view(kind).reshape(len(a), width)


def _binned(df: DataFrame, features, label, edges, **masks: Column) -> DataFrame:
    """(bins, y, masks) of the rows with a label."""
    rows = df.select(F.col(label).cast("double").alias("y"), *[m.cast("long").alias(k) for k, m in masks.items()],
                     *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]).where("y IS NOT NULL")
    names = ["bins", "y", *masks]
    k = len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_packed(_bins(b.columns[k:], edges, b.num_rows)), *b.columns[:k]], names)

    return rows.mapInArrow(run, ", ".join(["bins binary, y double", *(f"{m} long" for m in names[2:])]))


def _in_order(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows, those of equal bins side by side in one task."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    return rows.repartition(parts, "bins").sortWithinPartitions("bins")


def _summed(rows: DataFrame, width: int, models: int, base: float) -> tuple[DataFrame, str]:
    """Rows (bins, mask, number n and label sum s) as cells: per model the number and the gradient sum of its rows; the folder.

    Rows side by side are one cell; a bins value may have several.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, max(1, TASK_SUMS // models)):
            first = _runs(b.column(0), width)
            mask, n, s = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            ns, gs = np.empty((len(first), models)), np.empty((len(first), models))
            for m in range(models):
                on = mask >> m & 1
                ns[:, m] = np.add.reduceat(on * n, first)
                gs[:, m] = base * ns[:, m] - np.add.reduceat(on * s, first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), _packed(ns), _packed(gs)], ["bins", "ns", "gs"])

    return stored_at(rows.select("bins", "mask", "n", "s").mapInArrow(run, _TABLE))


def _rows(b: pa.RecordBatch, features: int, models: int):
    return _matrix(b.column(0), np.uint8, features), _matrix(b.column(1), np.float64, models), _matrix(b.column(2), np.float64, models)


def _refreshed(table: DataFrame, recent, sizes: np.ndarray, models: int) -> tuple[DataFrame, str]:
    """The table with the recent trees added to the gradients, and its folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(recent, sizes)
        for b in batches:
            x, n, g = _rows(b, len(sizes), models)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(g + n * steps.sums(x, models))], b.schema.names)

    return stored_at(table.mapInArrow(run, _TABLE))


def _units(batches: Iterator[pa.RecordBatch], chosen: Sequence[int], recent, sizes: np.ndarray, models: int):
    """(model, bins, gradient, rows) of the cells that train the chosen models."""
    steps = Steps(recent, sizes)
    for b in _blocks(batches, max(1, min(1 << 17, TASK_SUMS // models))):
        x, n, g = _rows(b, len(sizes), models)
        if recent:
            g = g + n * steps.sums(x, models)
        for m in chosen:
            rows = np.flatnonzero(n[:, m])
            if len(rows):
                yield m, x[rows] if len(rows) < len(x) else x, g[rows, m], n[rows, m]


def _cell_counts(table: DataFrame, models: int) -> dict[int, int]:
    """Cells that train each model, without models that have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum((np.count_nonzero(_matrix(b.column(0), np.float64, models), axis=0) for b in batches), np.zeros(models, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(models)), pa.array(n)], ["m", "n"])

    found = table.select("ns").mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n")).where("n > 0").collect()
    return {r["m"]: r["n"] for r in sorted(found)}


def _standing(units, growing: list[Tree], open_: list[list[int]]):
    """(model, slot of its open node, bins, gradient, weight) of the units that stand in an open node."""
    for m, x, g, n in units:
        slot = np.full(len(growing[m].value), -1)
        slot[open_[m]] = np.arange(len(open_[m]))
        slot = slot[growing[m].place(x)]
        live = slot >= 0
        if live.any():
            yield m, slot[live], x[live], g[live], None if n is None else n[live]


def _histograms(x: np.ndarray, g: np.ndarray, n: np.ndarray | None, slot: np.ndarray, slots: int, width: int) -> np.ndarray:
    """Gradient sums, rows and units per (slot, column, bin); a unit is a row, or equal rows with their number ``n``."""
    out = np.empty((slots, x.shape[1], width, 3))
    for j in range(x.shape[1]):
        code = slot * width + x[:, j]
        out[:, j, :, 0] = np.bincount(code, g, slots * width).reshape(-1, width)
        out[:, j, :, 2] = np.bincount(code, minlength=slots * width).reshape(-1, width)
        out[:, j, :, 1] = out[:, j, :, 2] if n is None else np.bincount(code, n, slots * width).reshape(-1, width)
    return out


def _cuts(h: np.ndarray, s: Settings) -> list[tuple]:
    """(gain, column, cut, missing to the left, left G, left H, left units, G, H, units) of the best cut of each node."""
    out = []
    for part in np.array_split(h, len(h) // 64 + 1):
        whole = part[:, 0].sum(axis=1)
        low = np.cumsum(part[:, :, 1:], axis=2)
        sides = low[:, None] if s.high else np.stack([low, low + part[:, :, :1]], axis=1)  # node, missing side, column, cut
        gl, hl = sides[..., 0], sides[..., 1]
        g, n = whole[:, 0].reshape(-1, 1, 1, 1), whole[:, 1].reshape(-1, 1, 1, 1)
        gain = s.gain(gl, hl, g, n)
        least = max(s.min_child, 1)
        gain[(hl < least) | (n - hl < least)] = -1.0
        top = gain.reshape(len(part), -1).argmax(axis=1)
        miss, column, cut = np.unravel_index(top, gain.shape[1:])
        rows = np.arange(len(part))
        out += zip(gain.reshape(len(part), -1)[rows, top].tolist(), column.tolist(), (cut + 1).tolist(), (miss == 1).tolist(),
                   *sides[rows, miss, column, cut].T.tolist(), *whole.T.tolist())
    return out


_SPLIT = "model int, node int, feature int, cut int, missing_left boolean, gain double, gl double, hl double, ul double, " \
    "g double, h double, u double"
_HISTOGRAM = "model int, node int, h binary"


def _split_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.float64()] * 7
    names = [c.split()[0] for c in _SPLIT.split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


def _level(table: DataFrame, units, growing: list[Tree], open_: list[list[int]], cols: np.ndarray, s: Settings) -> list:
    """Best cut of every open node of every model: one pass over the table, histograms merged per (model, node)."""
    width = s.bins + 1
    chosen = [m for m, nodes in enumerate(open_) if nodes]

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for m, slot, x, g, n in _standing(units(batches, chosen), growing, open_):
            h = _histograms(x[:, cols], g, n, slot, len(open_[m]), width)
            held[m] = held[m] + h if m in held else h
        for m, h in held.items():
            some = np.flatnonzero(h[:, 0, :, 1].any(axis=1))
            for part in np.array_split(some, len(some) // 256 + 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), m, np.int32)), pa.array(np.array(open_[m], np.int32)[part]),
                     _packed(h[part].reshape(len(part), -1))], ["model", "node", "h"])

    def best(t: pa.Table) -> pa.Table:
        total = np.zeros((1, len(cols), width, 3))
        for v in t.column("h"):
            total += np.frombuffer(v.as_buffer(), np.float64).reshape(total.shape)
        gain, j, *rest = _cuts(total, s)[0]
        cut, miss = rest[:2]
        return _split_table([(t.column("model")[0].as_py(), t.column("node")[0].as_py(), int(cols[j]), cut, miss, gain, *rest[2:])])

    return table.mapInArrow(histograms, _HISTOGRAM).groupBy("model", "node").applyInArrow(best, _SPLIT).collect()


def _grown(m: int, root: int, x: np.ndarray, g: np.ndarray, n: np.ndarray | None, cols: np.ndarray, s: Settings) -> list[tuple]:
    """All splits below a node from its units; ``x`` has the drawn columns only."""
    width = s.bins + 1
    nodes, slot, out = [root], np.zeros(len(g), np.int64), []
    for _ in range((root + 1).bit_length() - 1, s.depth):
        found = _cuts(_histograms(x, g, n, slot, len(nodes), width), s)
        split = [i for i, r in enumerate(found) if r[0] > s.min_gain or nodes[i] == root]
        out += [(m, nodes[i], int(cols[found[i][1]]), found[i][2], found[i][3], found[i][0], *found[i][4:]) for i in split]
        split = [i for i in split if found[i][0] > s.min_gain]
        if not split:
            break
        place = np.full(len(nodes), -1)
        place[split] = 2 * np.arange(len(split))
        live = place[slot] >= 0
        x, g, slot, n = x[live], g[live], slot[live], None if n is None else n[live]
        column, cut, miss = (np.array([r[i] for r in found]) for i in (1, 2, 3))
        b = x[np.arange(len(x)), column[slot]]
        left = np.where(b == 0, miss[slot], b <= cut[slot])
        slot = place[slot] + 1 - left
        nodes = [c for i in split for c in (2 * nodes[i] + 1, 2 * nodes[i] + 2)]
    return out


def _subtrees(table: DataFrame, units, growing: list[Tree], open_: list[list[int]], cols: np.ndarray, s: Settings) -> list:
    """All splits below the open nodes, each of which holds a bounded number of units: a node's units meet in one task."""
    chosen = [m for m, nodes in enumerate(open_) if nodes]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, slot, x, g, n in _standing(units(batches, chosen), growing, open_):
            order = np.argsort(slot, kind="stable")
            edge = np.flatnonzero(np.diff(slot[order], prepend=-1))
            x, g = np.ascontiguousarray(x[order][:, cols]), g[order]
            n = np.zeros(0) if n is None else n[order].astype(float)
            ends = np.append(edge[1:], len(order))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(edge), m, np.int32)), pa.array(np.array(open_[m], np.int32)[slot[order][edge]]),
                 *(pa.array([v[i:j].tobytes() for i, j in zip(edge, ends)], pa.binary()) for v in (x, g, n))],
                ["model", "node", "x", "g", "n"])

    def finish(t: pa.Table) -> pa.Table:
        x, g, n = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in (("x", np.uint8), ("g", float), ("n", float)))
        return _split_table(_grown(t.column("model")[0].as_py(), t.column("node")[0].as_py(), x.reshape(-1, len(cols)), g,
                                   n if len(n) else None, cols, s))

    return table.mapInArrow(rows, "model int, node int, x binary, g binary, n binary") \
        .groupBy("model", "node").applyInArrow(finish, _SPLIT).collect()


def _cube(table: DataFrame, units, chosen: Sequence[int], cols: np.ndarray, sizes: np.ndarray, s: Settings, parts: int,
          chunk: int = 1 << 13) -> list:
    """All splits of the chosen models in one pass: sums per cell of the drawn columns, merged, and a tree grown from them.

    Rows that agree in the drawn columns stand in the same node of every tree of the round, so their sums are enough.
    """
    dims = sizes[cols]
    cells = int(np.prod(dims))
    chunk = min(chunk, cells)
    padded = -(-cells // chunk) * chunk

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {m: np.zeros((2, padded)) for m in chosen}
        for m, x, g, n in units(batches, chosen):
            code = _codes(x, cols, sizes)
            if len(code) < padded // 8:
                np.add.at(held[m][0], code, g)
                np.add.at(held[m][1], code, n)
            else:
                held[m][0] += np.bincount(code, g, padded)
                held[m][1] += np.bincount(code, n, padded)
        for m, h in held.items():
            h = h.reshape(2, -1, chunk).transpose(1, 0, 2)
            some = np.flatnonzero(h[:, 1].any(axis=1))
            for part in np.array_split(some, len(some) // 64 + 1):
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), m, np.int32)), pa.array(part.astype(np.int32)),
                                                      _packed(h[part].reshape(len(part), -1))], ["model", "node", "h"])

    def merged(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in t.column("h"))
        return pa.table({"model": t.column("model")[:1], "node": t.column("node")[:1], "h": pa.array([total.tobytes()], pa.binary())})

    def tree(t: pa.Table) -> pa.Table:
        h = np.zeros((2, padded // chunk, chunk))
        for i, v in zip(t.column("node").to_pylist(), t.column("h")):
            h[:, i] += np.frombuffer(v.as_buffer(), np.float64).reshape(2, chunk)
        g, n = h.reshape(2, -1)
        some = np.flatnonzero(n)
        x = np.column_stack(np.unravel_index(some, dims)).astype(np.uint8)
        return _split_table(_grown(t.column("model")[0].as_py(), 0, x, g[some], n[some], cols, s))

    out = table.mapInArrow(sums, _HISTOGRAM)
    if padded * parts > 1 << 22:  # else the sums of one model fit one task before they are merged
        out = out.groupBy("model", "node").applyInArrow(merged, _HISTOGRAM)
    return out.groupBy("model").applyInArrow(tree, _SPLIT).collect()


def _round(table: DataFrame, units, count: dict[int, int], models: int, cols: np.ndarray, s: Settings, small: int,
           sizes: np.ndarray | None = None, parts: int = 1) -> list[Tree]:
    """One tree per model: in one pass by cells if ``sizes`` are given and the drawn columns have few, else levels of large
    nodes by histograms, then everything below small nodes in one job."""
    growing = [Tree(s.depth) for _ in range(models)]

    def apply(found: list) -> list[tuple[int, int, float]]:
        """Enter the splits; returns the children as (model, node, units)."""
        children = []
        for r in found:
            t, i = growing[r["model"]], r["node"]
            if i == 0:
                t.value[0] = s.leaf(r["g"], r["h"])
            if r["gain"] > s.min_gain:
                t.feature[i], t.cut[i], t.missing_left[i] = r["feature"], r["cut"], r["missing_left"]
                for child, g, h, u in ((2 * i + 1, r["gl"], r["hl"], r["ul"]),
                                       (2 * i + 2, r["g"] - r["gl"], r["h"] - r["hl"], r["u"] - r["ul"])):
                    t.value[child] = s.leaf(g, h)
                    children.append((r["model"], child, u))
        return children

    cells = CUBE + 1 if sizes is None else float(np.prod(sizes[cols].astype(float)))
    if cells <= CUBE:
        at_once = max(1, int(CUBE // cells))
        chosen = sorted(count)
        for i in range(0, len(chosen), at_once):
            apply(_cube(table, units, chosen[i:i + at_once], cols, sizes, s, parts))
        return growing
    large, rest = [[] for _ in range(models)], [[] for _ in range(models)]
    for m, n in count.items():
        (large if n > small else rest)[m].append(0)
    while any(large):
        children = apply(_level(table, units, growing, large, cols, s))
        large = [[] for _ in range(models)]
        for m, node, n in sorted(children):
            if 2 * node + 1 < len(growing[m].value):
                (large if n > small else rest)[m].append(node)
    if any(rest):
        apply(_subtrees(table, units, growing, [sorted(r) for r in rest], cols, s))
    return growing


def fit(df: DataFrame, features: Sequence[str], label: str, settings: Settings = Settings(), mask: Column | None = None,
        models: int = 1, small: int = SMALL, cube: bool = True) -> Booster:
    """Fit ``models`` models side by side; bit m of ``mask`` says whether a row trains model m (default: one model, all rows).

    A round whose drawn columns have few cells is one pass.  In other rounds (all, without ``cube``) nodes of at most
    ``small`` cells are finished in one task; the trees do not depend on either.
    """
    if not 1 <= models <= MAX_MODELS:
        raise ValueError(f"1 to {MAX_MODELS} models, not {models}")
    features = list(features)
    booster = Booster(features, bin_edges(df.where(F.col(label).isNotNull()), features, settings.bins), settings)
    rows = _binned(df, features, label, booster.edges, mask=F.lit(1) if mask is None else mask).where("mask <> 0")
    sums, path = stored_at(rows.groupBy("bins", "mask").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s")))
    _boosted(booster, _in_order(sums, sums.count()), models, small, cube)
    drop_stored(df.sparkSession, path)
    return booster


def _boosted(booster: Booster, rows: DataFrame, models: int, small: int = SMALL, cube: bool = True) -> None:
    """Grow the trees of ``booster`` on rows (bins, mask, n, s) as in ``_summed``."""
    s, sizes, spark = booster.settings, booster.sizes(), rows.sparkSession
    table, path = _summed(rows, len(sizes), models, s.base)
    count = _cell_counts(table, models)
    parts = table.rdd.getNumPartitions()
    recent: list = []
    for round_ in range(s.rounds):
        if len(recent) == REFRESH:
            (table, new), recent = _refreshed(table, recent, sizes, models), []
            drop_stored(spark, path)
            path = new
        cols = s.columns(len(sizes), round_)
        grown = _round(table, partial(_units, recent=recent, sizes=sizes, models=models), count, models, cols, s, small, sizes if cube else None, parts)
        booster.trees.append(grown)
        recent = [*recent, (cols, grown)]
    drop_stored(spark, path)


# --------------------------------------------------------------------------- absolute error
_CELLS = "bins binary, ys binary, margin double"
#: Rows up to which every value of a feature counts for its split points, quantiles taken beyond, and units of a node per task.
EXACT_ROWS, GRID, SMALL_CELLS = 10_000, 2048, 1 << 17


def split_points(df: DataFrame, features: Sequence[str], bins: int, n: int) -> list[np.ndarray]:
    """Cuts between values of each feature as Spark ML places them: all of few values, else about n / bins rows apart.

    Up to ``EXACT_ROWS`` rows they come from all values, beyond from ``GRID`` quantiles of all rows (one pass).
    """
    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    if n <= EXACT_ROWS:
        got = values.limit(EXACT_ROWS).toArrow()
        lists = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in got.columns]
    else:
        at = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
        none = F.lit(None).cast("double")
        row = values.agg(*[F.percentile_approx(F.nanvl(F.col(c), none), at, F.lit(10_000)).alias(c) for c in values.columns],
                         *[F.min(F.nanvl(F.col(c), none)).alias(f"{c}_a") for c in values.columns],
                         *[F.max(F.nanvl(F.col(c), none)).alias(f"{c}_b") for c in values.columns]).first()
        lists = [np.array([*(row[c] or []), *(v for v in (row[f"{c}_a"], row[f"{c}_b"]) if v is not None)], float) for c in values.columns]
    out = []
    for v in lists:
        value, count = np.unique(v + 0.0, return_counts=True)
        middle = (value[:-1] + value[1:]) / 2
        slots = min(bins, n) - 1
        if len(middle) > slots:
            stride = count.sum() / (slots + 1)
            target, keep, total = stride, [], np.cumsum(count)
            for i in range(1, len(value)):
                if abs(total[i - 1] - target) < abs(total[i] - target):
                    keep.append(i - 1)
                    target += stride
            middle = middle[keep]
        out.append(middle[~np.isnan(middle)])
    return out


def _runs(bins: pa.Array, width: int) -> np.ndarray:
    """First rows of the runs of equal bins."""
    x = _matrix(bins, np.uint8, width)
    return np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(axis=1))) if len(x) else np.zeros(0, int)


def binned_in_order(df: DataFrame, features, label, edges) -> tuple[DataFrame, str]:
    """(bins, y) of the rows, sorted and dealt by ranges of both (missing values are high), and the folder it is read from."""
    rows = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_packed(_bins(b.columns[1:], edges, b.num_rows, True)), b.column(0)], ["bins", "y"])

    table, path = stored_at(rows.mapInArrow(binned, "bins binary, y double"))
    return table.repartitionByRange("bins", "y").sortWithinPartitions("bins", "y"), path


def _cells(df: DataFrame, features, label, edges) -> tuple[DataFrame, str]:
    """Rows that agree in all bins as one cell with their sorted labels.

    Rows are dealt by (bins, label), so many equal ones spread over tasks; a cell holds at most the rows of one batch, and
    a bins value may have several cells.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = _runs(b.column(0), len(edges))
            offsets = np.append(first, b.num_rows).astype(np.int32) * 8
            y = np.ascontiguousarray(b.column(1).to_numpy(zero_copy_only=False))
            ys = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(y)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first)), ys, pa.array(np.zeros(len(first)))], ["bins", "ys", "margin"])

    rows, path = binned_in_order(df, features, label, edges)
    out = stored_at(rows.mapInArrow(joined, _CELLS))
    drop_stored(df.sparkSession, path)
    return out


def _scored(batches: Iterator[pa.RecordBatch], recent, sizes: np.ndarray):
    """(batch, bins, margins) of the cells with the recent trees added."""
    steps = Steps(recent, sizes)
    for b in batches:
        x = _matrix(b.column(0), np.uint8, len(sizes))
        out = {0: b.column(2).to_numpy(zero_copy_only=False)}
        steps.add(x, {0: np.arange(len(x))}, out)
        yield b, x, out[0]


def _signs(batches: Iterator[pa.RecordBatch], chosen, recent, sizes: np.ndarray, first: bool):
    """(model, bins, gradient, rows) of the cells: labels in the first round, then the rows below less those not below."""
    for b, x, margins in _scored(batches, recent, sizes):
        if not len(x):
            continue
        ends = np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset:b.column(1).offset + len(x) + 1].astype(np.int64)
        y = np.frombuffer(b.column(1).buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.float64)
        n = np.diff(ends) // 8
        at = (ends[:-1] - ends[0]) // 8
        g = -np.add.reduceat(y, at) if first else 2.0 * np.add.reduceat((y < np.repeat(margins, n)).astype(np.int64), at) - n
        yield 0, x, g, n.astype(float)


def _stored_units(batches: Iterator[pa.RecordBatch], chosen, width: int):
    for b in _blocks(batches):
        yield 0, _matrix(b.column(0), np.uint8, width), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)


def whole_rows(df: DataFrame, features: Sequence[str], label: str) -> int:
    """The number of training rows; none, or one without a label or a feature, is an error."""
    whole = F.lit(True)
    for c in (F.col(c).cast("double") for c in (label, *features)):
        whole = whole & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    n, good = df.agg(F.count(F.lit(1)), F.count_if(whole)).first()
    if not n or good < n:
        raise ValueError(f"{n} training rows, {n - good} of them without a label or a feature")
    return n


def fit_absolute(df: DataFrame, features: Sequence[str], label: str, settings: Settings, small: int = SMALL_CELLS) -> Booster:
    """Boosting on the absolute error as Spark ML's ``GBTRegressor`` does it.

    The first tree fits the label, the others the sign of what is left, each by loss of variance, and a leaf is a mean.
    Missing values are higher than all others.  All rows with the same bins have one margin, so a cell keeps their labels
    in order, a round counts those below the margin, and the tree grows on cells with their sums; its time follows the
    number of different cells (at most the rows).  Training rows without a label or a feature are an error, as there.
    """
    s, features = settings, list(features)
    spark = df.sparkSession
    n = whole_rows(df, features, label)
    booster = Booster(features, split_points(df, features, s.bins, n), s, label=label)
    sizes = booster.sizes()
    table, path = _cells(df, features, label, booster.edges)
    cells = table.count()
    recent: list = []
    for round_ in range(s.rounds):
        if len(recent) == REFRESH:
            def refreshed(batches: Iterator[pa.RecordBatch], recent=recent) -> Iterator[pa.RecordBatch]:
                for b, _, margins in _scored(batches, recent, sizes):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(margins)], b.schema.names)

            (table, new), recent = stored_at(table.mapInArrow(refreshed, _CELLS)), []
            drop_stored(spark, path)
            path = new
        units = partial(_signs, recent=recent, sizes=sizes, first=round_ == 0)
        now, of = table, None
        if cells > small:  # several passes: the sums are stored once
            def sums(batches: Iterator[pa.RecordBatch], units=units) -> Iterator[pa.RecordBatch]:
                for _, x, g, n in units(batches, [0]):
                    yield pa.RecordBatch.from_arrays([_packed(x), pa.array(g), pa.array(n)], ["bins", "g", "n"])

            now, of = stored_at(table.mapInArrow(sums, "bins binary, g double, n double"))
            units = partial(_stored_units, width=len(features))
        step = replace(s, rate=1.0) if round_ == 0 else s
        cols = s.columns(len(features), round_)
        grown = _round(now, units, {0: cells}, 1, cols, step, small)
        if of:
            drop_stored(spark, of)
        booster.trees.append(grown)
        recent = [*recent, (cols, grown)]
    drop_stored(spark, path)
    return booster


def fit_groups(df: DataFrame, group_col: str, features: Sequence[str], label: str, keep: Sequence[str],
               settings: Settings = Settings(), split_col: str = "train_val_split") -> DataFrame:
    """One model per value of ``group_col`` (NULL is a group), all in one run: predictions of the validation rows.

    More than ``MAX_MODELS`` groups are an error.  A group without training rows gets ``settings.base``.
    """
    groups = df.select(group_col).distinct().limit(MAX_MODELS + 1).collect()
    if len(groups) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} values of {group_col}")
    values = sorted((r[0] for r in groups), key=lambda v: (v is not None, v))
    kind = df.schema[group_col].dataType
    number = F.lit(None).cast("int")
    for i, v in enumerate(values):
        number = F.when(F.col(group_col).eqNullSafe(F.lit(v).cast(kind)), F.lit(i)).otherwise(number)
    train = df.where(F.col(split_col) == 0)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), number)
    model = fit(train, features, label, settings, mask, max(1, len(values)))
    names = list(dict.fromkeys([*keep, group_col]))
    return model.predict(df.where(F.col(split_col) == 1), names, number)


def learning_curve(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str],
                   sizes: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, settings: Settings = Settings(),
                   seed: int = 11, log_y: bool = False) -> DataFrame:
    """Train and test RMSLE per training size: mean and std (ddof 0) over folds; all sizes x folds models in one run.

    A row's fold and its place in the nested sizes come from stable hashes of its keys, so its models are one mask.  With
    ``log_y`` the label is log1p of the target.  Scores are partial sums of one pass; a fold without rows has none.
    """
    pairs = [(float(z), k) for z in sizes for k in range(folds)]
    fold = exprs.hash_bucket(keys, seed, folds)
    train, test = F.lit(0).cast("long"), F.lit(0).cast("long")
    inside = {float(z): exprs.in_share(keys, seed + 1, z) for z in sizes}
    for i, (z, k) in enumerate(pairs):
        bit = F.lit(1 << i).cast("long")
        train = train.bitwiseOR(F.when((fold != k) & inside[z], bit).otherwise(F.lit(0)))
        test = test.bitwiseOR(F.when(fold == k, bit).otherwise(F.lit(0)))
    features, n = list(features), len(pairs)
    data = stored_table(df.select(*features, F.col(label).alias("_y"), train.alias("_train"), test.alias("_test")))
    model = fit(data, features, "_y", settings, F.col("_train"), n)
    rows = _in_order(_binned(data, features, "_y", model.edges, train=F.col("_train"), test=F.col("_test")), data.count())
    base, trees, bins = settings.base, model.rounds(), model.sizes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, steps = np.zeros((n, 2, 2)), Steps(trees, bins)
        for b in _blocks(batches, max(1, TASK_SUMS // n)):
            first = _runs(b.column(0), len(bins))  # rows of equal bins are scored once
            x = _matrix(b.column(0).take(pa.array(first)), np.uint8, len(bins))
            cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, b.num_rows)))
            out = np.ascontiguousarray(np.maximum(base + steps.sums(x, n), 0.0).T)
            y, *masks = (c.to_numpy(zero_copy_only=False) for c in b.columns[1:])
            if not log_y:
                out, y = np.log1p(out), np.log1p(y)
            for side, mask in enumerate(masks):
                for m, at in _bits(mask, n).items():
                    d = out[m][cell[at]] - y[at]
                    total[m, side] += (d @ d, len(at))
        m = np.repeat(np.arange(n), 2)
        flat = total.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.array([p[0] for p in pairs])[m]), pa.array(m), pa.array(np.tile([0, 1], n)),
                                          pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["train_size", "m", "side", "s", "n"])

    sums = rows.mapInArrow(run, "train_size double, m long, side long, s double, n double").groupBy("train_size", "m", "side").agg(
        F.sqrt(F.try_divide(F.sum("s"), F.sum("n"))).alias("rmsle"))
    of = {name: F.when(F.col("side") == i, F.col("rmsle")) for i, name in enumerate(("train", "test"))}
    return sums.groupBy("train_size").agg(*[f(of[name]).alias(f"{name}_{what}") for name in of
                                            for what, f in (("mean", F.avg), ("std", F.stddev_pop))])
