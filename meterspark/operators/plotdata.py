"""Aggregates behind charts (V-*): the data products, not the drawing.

All outputs are bounded by the chart resolution (bins, grid points,
categories), never by the number of input rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import groupstats as gs
from . import ordered
from .outliers import keep_normal


def histogram(df: DataFrame, col, bins: int = 20, label_col: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; empty bins reported with 0.

    ``col`` may be a column name or an expression.  NULLs are dropped; with
    ``label_col`` only rows labelled 'Normal' (or unlabelled) are counted.
    """
    x = F.col(col) if isinstance(col, str) else col
    src = df
    if label_col:
        src = keep_normal(src, label_col)
    src = src.select(x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    rng = src.agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    width = F.col("_mx") - F.col("_mn")
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_mn")) / width * F.lit(bins)), F.lit(bins - 1))).cast("int")
    counts = gs.attach(src, rng, []).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = rng.select("_mn", "_mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    return all_bins.join(counts, "bin", "left").select(
        "bin", (F.col("_mn") + F.col("bin") * w).alias("lo"), (F.col("_mn") + (F.col("bin") + 1) * w).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"))


#: Terms of the series; a point lies within half a bandwidth of its box's centre, so the rest is below 1e-11 of a point's kernel.
_TERMS = 16
#: A box adds to the grid points within this many bandwidths (the kernel is below 1e-17 beyond).
_REACH = 9.0


def _series(moments, t):
    """Sum of moment n times the Hermite function n at t, by the functions' recurrence."""
    first = F.struct(F.lit(0.0).alias("before"), F.exp(-t * t).alias("now"), F.lit(0.0).alias("n"), F.lit(0.0).alias("total"))

    def step(s, a):
        after = F.lit(2.0) * t * s["now"] - F.lit(2.0) * s["n"] * s["before"]
        return F.struct(s["now"].alias("before"), after.alias("now"), (s["n"] + 1.0).alias("n"), (s["total"] + a * s["now"]).alias("total"))

    return F.aggregate(moments, first, step, lambda s: s["total"])


def density_by_category(df: DataFrame, by: str, value: str, grid: int = 100, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per category on ``grid`` points.

    Bandwidth: Scott's rule ``std * n^(-1/5)``; grid from ``min - cut*h`` to
    ``max + cut*h``.  Kernels are summed by a truncated Hermite series: rows
    are reduced to 16 moments per (category, box of one bandwidth), partial
    sums before the only shuffle, and each box adds its series to the grid
    points it reaches; the error is below 1e-9 of a kernel's height.
    NULL, NaN and infinite values are left out, as are categories without variance.

    A table of at most ``gs.SMALL_ROWS`` categories (checked by a job when
    this is called) is broadcast, so the rows are not shuffled; more
    categories are joined by key.
    """
    v = F.col("_v")
    src = df.select(by, F.col(value).cast("double").alias("_v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    stats = src.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"),
                                F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    stats = stats.withColumn("_h", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))) \
        .where(F.col("_h") > 0) \
        .withColumn("_lo", F.col("_mn") - F.lit(cut) * F.col("_h")) \
        .withColumn("_step", (F.col("_mx") - F.col("_mn") + F.lit(2 * cut) * F.col("_h")) / F.lit(grid - 1))
    small = gs.materialize_small(stats)
    stats = stats if small is None else small
    h, centre = F.col("_h"), F.col("_mn") + (F.col("_box") + F.lit(0.5)) * F.col("_h")
    rows = gs.attach(src, stats.select(by, "_mn", "_h"), [by], bounded=small is not None, how="inner")
    rows = rows.withColumn("_box", F.floor((v - F.col("_mn")) / h)).withColumn("_u", (v - centre) / (h * F.lit(math.sqrt(2))))
    moments = rows.groupBy(by, "_box").agg(*[
        (F.sum(F.pow("_u", F.lit(float(i)))) / F.lit(float(math.factorial(i)))).alias(f"_a{i}") for i in range(_TERMS)])
    boxes = gs.attach(moments, stats, [by], bounded=small is not None, how="inner")
    reach = F.lit(_REACH) * h
    low = F.greatest(F.ceil((centre - reach - F.col("_lo")) / F.col("_step")), F.lit(0))
    high = F.least(F.floor((centre + reach - F.col("_lo")) / F.col("_step")), F.lit(grid - 1))
    near = F.when(low <= high, F.sequence(low, high))
    x = F.col("_lo") + F.col("g") * F.col("_step")
    parts = boxes.select("*", F.explode(near).alias("g")).select(
        by, F.col("g").cast("int").alias("g"),
        _series(F.array(*[F.col(f"_a{i}") for i in range(_TERMS)]), (x - centre) / (h * F.lit(math.sqrt(2)))).alias("_s"))
    summed = parts.groupBy(by, "g").agg(F.sum("_s").alias("_s"))
    points = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    norm = F.col("_n") * h * F.lit(math.sqrt(2 * math.pi))
    return gs.null_safe_join(points, summed, [by, "g"], "left").select(
        by, "g", x.alias("x"), (F.greatest(F.coalesce("_s", F.lit(0.0)), F.lit(0.0)) / norm).alias("density"))


def regr_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line y = slope * x + intercept (per group if ``by``)."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                               F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                               F.regr_count(F.col(y), F.col(x)).alias("n"))


def scatter_points(df: DataFrame, x: str, y: str, keys: Sequence[str], fraction: float = 1.0,
                   label_col: str | None = None, seed: int = 7) -> DataFrame:
    """Points for a scatter plot: complete rows, no 'Outlier' label, optionally a stable hash sample.

    ``fraction`` < 1 bounds the point cloud for very large tables; the diagonal
    bounds ``y_min`` / ``y_max`` are the range of the true values ``x`` over all complete rows.
    """
    src = df.dropna(subset=[x, y])
    if label_col:
        src = src.where(F.coalesce(F.col(label_col) != F.lit("Outlier"), F.lit(True)))
    bounds = src.agg(F.min(x).alias("y_min"), F.max(x).alias("y_max"))
    pts = src if fraction >= 1.0 else src.where(exprs.in_share(keys, seed, fraction))
    pts = pts.select(*keys, x, y)
    return gs.attach(pts, bounds, [])


def sorted_bar(df: DataFrame, by: str, value: str, agg: str = "avg") -> DataFrame:
    """Category measure with its descending rank (ties broken by category)."""
    data = df.groupBy(by).agg(F.expr(f"{agg}({value})").alias(f"{agg}_{value}"))
    order = [F.col(f"{agg}_{value}").desc_nulls_last(), F.col(by).asc()]
    return ordered.running_total(data, order, F.lit(1), "rank").withColumn("rank", F.col("rank").cast("bigint"))
