"""Correlations from mergeable co-moment blocks, with native p-values (A15, A16).

Tasks add pairwise-complete counts, sums and products of all columns as matrix
products over Arrow batches, shifted by a typical value of each column, and
send one row (n, means, co-moments) per pair.  The rows of a pair (one per
task) are merged around their common mean, so large offsets cost no digits.  The
plan has the same size for 2 and for 200 columns, and the input is read once.

The p-value is the two-sided t test of Pearson's r.  With Fisher's w = atanh|r|
it is the tail of sech(w)^dof over its whole half line; both integrals are a
fixed-length quadrature (y = scale * exp(s - exp(-s)), equal steps in s) folded
inside the plan, for every dof from 1 to beyond 1e12, relative to the tail's
first value, so small p-values keep their digits.

NULL, NaN and infinite values count as missing.  A pair without variance has a NULL correlation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART = "i int, j int, n double, mx double, my double, cxx double, cyy double, cxy double"
_NAMES = [c.split()[0] for c in _PART.split(", ")]
#: Below this share of its own sum of squares a co-moment is rounding, not variance.
_NOISE = 1e-13
# Quadrature: equal steps from S0 on.
_S0, _STEP, _POINTS = -3.5, 1 / 16, 126


def co_moments(df: DataFrame, cols: Sequence[str], only_with: str | None = None) -> DataFrame:
    """(i, j, n, mx, my, cxx, cyy, cxy) of the pairs i <= j of columns (or the pairs of ``only_with``); no row for an empty table."""
    cols = list(cols)
    k = len(cols)
    left = np.arange(k) if only_with is None else np.array([cols.index(only_with)])
    pairs = np.array([(a, b) for a in range(len(left)) for b in range(k) if only_with is not None or left[a] <= b], int).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = np.full(k, np.nan), np.zeros((6, len(left), k))
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            there = np.isfinite(x)
            for c in np.flatnonzero(np.isnan(shift) & there.any(axis=0)):
                shift[c] = np.median(x[there[:, c], c])
            x = np.where(there, x - np.where(np.isnan(shift), 0.0, shift), 0.0)
            m = there.astype(float)
            xl, ml = x[:, left], m[:, left]
            total += [ml.T @ m, xl.T @ m, ml.T @ x, (xl * xl).T @ m, ml.T @ (x * x), xl.T @ x]
        n, sx, sy, sxx, syy, sxy = total[:, pairs[:, 0], pairs[:, 1]]
        some = n > 0
        n, sx, sy, sxx, syy, sxy = (v[some] for v in (n, sx, sy, sxx, syy, sxy))
        i, j = left[pairs[some, 0]], pairs[some, 1]

        cxx, cyy = (np.where(s - a * a / n <= _NOISE * s, 0.0, s - a * a / n) for s, a in ((sxx, sx), (syy, sy)))
        out = (i.astype(np.int32), j.astype(np.int32), n, shift[i] + sx / n, shift[j] + sy / n, cxx, cyy, sxy - sx * sy / n)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], _NAMES)

    def merge(t: pa.Table) -> pa.Table:
        n, mx, my, cxx, cyy, cxy = (t.column(c).to_numpy() for c in _NAMES[2:])
        whole = n.sum()
        cx, cy = mx[0] + (n @ (mx - mx[0])) / whole, my[0] + (n @ (my - my[0])) / whole
        dx, dy = mx - cx, my - cy
        one = [whole, cx, cy, cxx.sum() + n @ (dx * dx), cyy.sum() + n @ (dy * dy), cxy.sum() + n @ (dx * dy)]
        return pa.table({"i": t.column("i")[:1], "j": t.column("j")[:1], **{c: pa.array([float(v)]) for c, v in zip(_NAMES[2:], one)}})

    rows = df.select(*[F.col(c).cast("double").alias(f"c{a}") for a, c in enumerate(cols)])
    return rows.mapInArrow(run, _PART).groupBy("i", "j").applyInArrow(merge, _PART)


def corr_matrix(df: DataFrame, cols: Sequence[str], only_with: str | None = None) -> DataFrame:
    """(var1, var2, i, j, corr, n) of all ordered pairs; with ``only_with`` those that involve that column.

    Pairs without a common row have n = 0 and a NULL correlation.
    """
    cols = list(cols)
    got = co_moments(df, cols, only_with)
    t = cols.index(only_with) if only_with is not None else None
    # One row per wanted pair (bounded by the column list), so that pairs without rows are there too.
    ids = F.sequence(F.lit(0), F.lit(len(cols) - 1))
    all_i = ids if t is None else F.array(F.lit(t))
    want = df.sparkSession.range(1).select(F.explode(all_i).alias("i")).select("i", F.explode(ids).alias("j"))
    if t is None:
        want = want.where("i <= j")
    m = want.join(got, ["i", "j"], "left")
    r = F.try_divide("cxy", F.sqrt("cxx") * F.sqrt("cyy"))
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("cxx") > 0, F.lit(1.0))).otherwise(
        F.when(F.abs(r) > 1, F.signum(r)).otherwise(r))
    m = m.select("i", "j", r.alias("corr"), F.coalesce("n", F.lit(0.0)).cast("long").alias("n"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    m = m.select(F.explode(both).alias("p"), "corr", "n")
    names = F.array(*[F.lit(c) for c in cols])
    return m.select(names[F.col("p.i")].alias("var1"), names[F.col("p.j")].alias("var2"), F.col("p.i").alias("i"),
                    F.col("p.j").alias("j"), "corr", "n")


def _tail(r: Column, dof: Column) -> Column:
    """Integral of (cosh w0 / cosh(w0 + y))^dof over y > 0, tanh w0 = r."""
    scale = F.lit(1.0) / (F.sqrt(dof) + dof * r)

    def add(total: Column, i: Column) -> Column:
        s = F.lit(_S0) + i.cast("double") * F.lit(_STEP)
        e = F.exp(-s)
        y = scale * F.exp(s - e)
        half = F.sinh(y / F.lit(2.0))
        return total + y * (F.lit(1.0) + e) * F.exp(-dof * F.log1p(F.lit(2.0) * half * half + r * F.sinh(y)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_POINTS - 1)), F.lit(0.0), add) * F.lit(_STEP)


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson r from n pairs; NULL below three pairs, 0 for |r| = 1."""
    a, dof = F.abs(r), (n - F.lit(2)).cast("double")
    p = F.exp(dof / F.lit(2.0) * F.log1p(-a * a)) * _tail(a, dof) / _tail(F.lit(0.0), dof)
    return F.when(r.isNull() | F.isnan(r) | (n < 3), F.lit(None).cast("double")).when(a >= 1, F.lit(0.0)).otherwise(F.least(p, F.lit(1.0)))


def corr_significance(df: DataFrame, cols: Sequence[str], sig_level: float = 0.05) -> DataFrame:
    """Pearson r, n, t and two-sided p-value for every ordered pair of columns.

    ``significant`` marks p <= level and p != 0 (exact zeros such as the
    diagonal are skipped; NULL p: false).  ``share_significant`` is the share
    of such pairs among the k(k-1)/2 pairs of different columns.
    """
    k = len(list(cols))
    r, n = F.col("corr"), F.col("n")
    out = corr_matrix(df, cols).withColumn(
        "t_stat", r * F.sqrt(F.try_divide((F.greatest(n, F.lit(2)) - 2).cast("double"), F.lit(1.0) - r * r))).withColumn("p_value", p_value(r, n))
    out = out.withColumn("significant", F.coalesce((F.col("p_value") <= F.lit(sig_level)) & (F.col("p_value") != 0), F.lit(False)))
    # The window holds the k*k pairs, whose number the column list fixes.
    hits = F.count_if(F.col("significant") & (F.col("i") < F.col("j"))).over(Window.partitionBy())
    return out.withColumn("share_significant", hits / F.lit(max(1, k * (k - 1) // 2)))
