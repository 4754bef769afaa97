"""Profiling and descriptive aggregates.

Every profile is one or two passes of partial-aggregated ``groupBy``; the
per-column profiles scan all columns in a single ``agg`` and then unpivot the
one-row result (a bounded number of cells, one per column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import null_nan, rnd
from . import groupstats as gs
from .correlation import corr_matrix, corr_significance  # noqa: F401
from . import ordered

# Fixed value: normal-consistency scale of the median absolute deviation.
MAD_SCALE = 1.4826


def stats_by_value(df: DataFrame, by: str, value: str, digits: int = 2,
                   cells: int = gs.CELLS, mad_propagates_nulls: bool = False) -> DataFrame:
    """count / min / mean / std / median / scaled MAD / max per group.

    ``count`` counts rows (nulls included); missing statistics become 0;
    everything except ``count`` is rounded to ``digits``.  The MAD skips
    missing values; ``mad_propagates_nulls`` reproduces the source library's
    default instead (a group with any missing value gets MAD 0).
    """
    src = df.select(by, null_nan(value).alias("_y"))
    # Plain statistics ride along in the median's sketch pass (no extra scan).
    med = gs.median(src, [by], "_y", "median", cells, extra_aggs=[
        F.count(F.lit(1)).alias("count"), F.min("_y").alias("min"), F.avg("_y").alias("mean"),
        F.stddev_samp("_y").alias("std"), F.max("_y").alias("max"), F.count_if(F.col("_y").isNull()).alias("_nulls")])
    dev = gs.attach(src, med.select(by, "median"), [by], how="inner") \
        .select(by, F.abs(F.col("_y") - F.col("median")).alias("_d"))
    mad = gs.median(dev, [by], "_d", "_mad", cells)
    out = gs.null_safe_join(med, mad, [by], "left")

    def fin(c):
        return rnd(F.coalesce(c, F.lit(0.0)), digits)

    mad = F.lit(MAD_SCALE) * F.col("_mad")
    if mad_propagates_nulls:
        mad = F.when(F.col("_nulls") > 0, F.lit(None)).otherwise(mad)
    return out.select(
        by, F.col("count").alias("count"),
        fin(F.col("min")).alias("min"), fin(F.col("mean")).alias("mean"), fin(F.col("std")).alias("std"),
        fin(F.col("median")).alias("median"), fin(mad).alias("mad"),
        fin(F.col("max")).alias("max"))


def missing_table(df: DataFrame, cols: Sequence[str] | None = None, share_of_nulls: bool = False) -> DataFrame:
    """(column_name, volume, percent) of NULLs per column, one pass over the rows.

    With ``share_of_nulls`` also each column's share of all NULLs (0 when there are none).
    """
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    stack = "stack({n}, {pairs}) as (column_name, volume)".format(
        n=len(cols), pairs=", ".join(f"'{c}', _n{i}" for i, c in enumerate(cols)))
    extra = []
    if share_of_nulls:
        total = " + ".join(f"_n{i}" for i in range(len(cols)))
        one = one.withColumn("_all", F.expr(total))
        extra = ["_all"]
    out = one.selectExpr(stack, "_rows", *extra).select(
        "column_name", "volume", (F.col("volume") / F.col("_rows")).alias("percent"), *extra)
    if share_of_nulls:
        out = out.withColumn("perc_of_nulls", F.coalesce(F.try_divide(F.col("volume"), F.col("_all")), F.lit(0.0))) \
            .drop("_all")
    return out


def value_share(df: DataFrame, col: str) -> DataFrame:
    """Value counts with share of non-null rows and cumulative share.

    Order is (volume desc, label asc); ``rank`` is the 1-based position.
    The running sums use the distributed prefix sum, not a global window.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("volume"))
    total = counts.agg(F.sum("volume").alias("_total"))
    order = [F.col("volume").desc(), F.col("label").asc()]
    ranked = ordered.running_totals(counts, order, {"_cum": F.col("volume"), "rank": F.lit(1)})
    return gs.attach(ranked, total, []).select(
        "label", "volume", (F.col("volume") / F.col("_total")).alias("percent"),
        (F.col("_cum") / F.col("_total")).alias("cumulative_perc"), F.col("rank").cast("bigint").alias("rank"))


def table_lengths(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_cols) per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"))
        for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_variation(df: DataFrame, by: str, target: str, n: int = 1) -> DataFrame:
    """Top ``n`` groups by sample standard deviation of ``target`` (desc, NULL last, key asc)."""
    std = df.groupBy(by).agg(F.stddev_samp(target).alias("std_dev"))
    return std.orderBy(F.col("std_dev").desc_nulls_last(), F.col(by).asc()).limit(n)


def mean_abs_dev(df: DataFrame, keys: Sequence[str], value: str, name: str = "mad") -> DataFrame:
    """pandas ``mad``: mean of |x - mean| per group (two partial-aggregated passes)."""
    keys = list(keys)
    src = df.select(*keys, null_nan(value).alias("_y"))
    means = src.groupBy(*keys).agg(F.avg("_y").alias("_mu"))
    return gs.attach(src, means, keys, how="inner").groupBy(*keys).agg(
        F.avg(F.abs(F.col("_y") - F.col("_mu"))).alias(name))


def stats_by_column(df: DataFrame, cols: Sequence[str], digits: int = 3,
                    cells: int = gs.CELLS) -> DataFrame:
    """min / mean / std / median / mad (mean abs deviation) / max per column, rounded."""
    cols = list(cols)
    stack = "stack({n}, {pairs}) as (column_name, _y)".format(
        n=len(cols), pairs=", ".join(f"'{c}', cast({c} as double)" for c in cols))
    long = df.selectExpr(stack)
    med = gs.median(long, ["column_name"], "_y", "median", cells, extra_aggs=[
        F.min("_y").alias("min"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("std"),
        F.max("_y").alias("max")])
    dev = gs.attach(long, med.select("column_name", "mean"), ["column_name"], how="inner")
    mad = dev.groupBy("column_name").agg(F.avg(F.abs(F.col("_y") - F.col("mean"))).alias("mad"))
    out = med.join(mad, "column_name", "left")
    return out.select("column_name", *[rnd(F.col(c), digits).alias(c) for c in ["min", "mean", "std", "median", "mad", "max"]])


def group_mode(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, ties -> smallest value.

    Counts (group, value) first (partial aggregation), then keeps the
    (max count, min value) pair per group with a struct ``min``: no group's
    values are ever buffered together.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("nc"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(name))


def assess_by_category(df: DataFrame, by: str, value: str) -> DataFrame:
    """count / min / mean / std / mode / max per category; NULL stats -> 0, rounded to 2.

    count, min, mode and max are truncated to integers.
    """
    src = df.select(by, null_nan(value).alias("_y"))
    basic = src.groupBy(by).agg(
        F.count(F.lit(1)).alias("count"), F.min("_y").alias("min"), F.avg("_y").alias("mean"),
        F.stddev_samp("_y").alias("std"), F.max("_y").alias("max"))
    mode = group_mode(src, [by], "_y", "mode")
    out = gs.null_safe_join(basic, mode, [by], "left")

    def fin(c):
        return rnd(F.coalesce(c, F.lit(0.0)), 2)

    def whole(c):  # NULL where the value exceeds 64 bits
        return fin(F.col(c)).try_cast("bigint")

    return out.select(
        by, F.col("count").alias("count"), whole("min").alias("min"),
        fin(F.col("mean")).alias("mean"), fin(F.col("std")).alias("std"),
        whole("mode").alias("mode"), whole("max").alias("max"))


def missing_by_category(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per category: NULL count of ``value``, share of the category's rows, share of all NULLs."""
    per = df.groupBy(by).agg(F.count_if(F.col(value).isNull()).alias("volume"), F.count(F.lit(1)).alias("_rows"))
    total = per.agg(F.sum("volume").alias("_all"))
    return gs.attach(per, total, []).select(
        by, "volume", F.try_divide(F.col("volume"), F.col("_rows")).alias("perc_row_total"),
        F.coalesce(F.try_divide(F.col("volume"), F.col("_all")), F.lit(0.0)).alias("perc_col_total"))


def freq_by_category(df: DataFrame, by: Sequence[str], agg_col: str) -> DataFrame:
    return df.groupBy(*by, agg_col).agg(F.count(F.lit(1)).alias("freq"))


def avg_by_category(df: DataFrame, by: Sequence[str], agg_col: str, target: str) -> DataFrame:
    return df.groupBy(*by, agg_col).agg(F.avg(target).alias(f"avg_{target}"))


def naive_mode_accuracy(df: DataFrame, by: str, target: str, split_col: str = "train_val_split") -> DataFrame:
    """Mode of ``target`` per category on train rows, scored on all complete rows.

    The train-side mode follows ``assess_by_category`` (missing -> 0, integer).
    """
    train = df.where(F.col(split_col) == 0)
    modes = assess_by_category(train, by, target).select(by, F.col("mode").alias("_pred"))
    complete = df.dropna()
    scored = complete.join(modes, by, "left")
    hit = F.coalesce(F.col("_pred") == F.col(target), F.lit(False))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_correct")).select(
        "n", "n_correct", F.try_divide(F.col("n_correct"), F.col("n")).alias("accuracy"))


def interval_bucket(col, bounds: Sequence[float]):
    """Smallest bound >= value (upper-inclusive); above the last bound -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    bounds = sorted(bounds)
    expr = None
    for b in bounds:
        cond = c <= F.lit(b)
        expr = F.when(cond, F.lit(b)) if expr is None else expr.when(cond, F.lit(b))
    # NaN lands in the first bucket, as a bisection over NaN does.
    return F.when(F.isnan(c.cast("double")), F.lit(bounds[0])).otherwise(expr)


def count_intervals(df: DataFrame, col: str, bounds: Sequence[float]) -> DataFrame:
    """(bucket, count); NULL bucket counts values above the last bound."""
    return df.where(F.col(col).isNotNull()).groupBy(interval_bucket(col, bounds).alias("bucket")) \
        .agg(F.count(F.lit(1)).alias("count"))


def aggregate_by_field(df: DataFrame, by: Sequence[str], cols: Sequence[str], fns: Sequence[str]) -> DataFrame:
    """Group by keys; one ``<col>_<fn>`` column per column and function."""
    spark_fn = {"mean": "avg", "std": "stddev_samp", "var": "var_samp", "count": "count",
                "sum": "sum", "min": "min", "max": "max", "median": "median", "nunique": "count_distinct"}
    aggs = [F.expr(f"{spark_fn.get(fn, fn)}({c})").alias(f"{c}_{fn}") for c in cols for fn in fns]
    return df.groupBy(*by).agg(*aggs)


def zero_share_rollup(df: DataFrame, by: str, value: str) -> DataFrame:
    """Zero count and share per group plus an overall row (``by`` NULL, ``level`` 1)."""
    return df.rollup(by).agg(
        F.grouping(by).alias("level"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(value) == 0).alias("zeros")).select(
        by, F.col("level").cast("int").alias("level"), "n", "zeros", (F.col("zeros") / F.col("n")).alias("zero_share"))


def extremes_by_group(df: DataFrame, by: str, value: str, entity: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.max(value).alias("max_value"), F.stddev_samp(value).alias("std_value"),
        F.count_distinct(entity).alias("n_entities"))


def median_by_keys(df: DataFrame, keys: Sequence[str], value: str, name: str,
                   cells: int = gs.CELLS) -> DataFrame:
    return gs.median(df, keys, value, name, cells)


def date_coverage_diff(df1: DataFrame, col1: str, df2: DataFrame, col2: str) -> DataFrame:
    """Distinct dates of two tables: counts, dates missing from each side, equality."""
    d1 = df1.select(F.to_date(col1).alias("d")).distinct()
    d2 = df2.select(F.to_date(col2).alias("d")).distinct()
    a = d1.agg(F.count(F.lit(1)).alias("n_dates_1"))
    b = d2.agg(F.count(F.lit(1)).alias("n_dates_2"))
    m2 = d1.join(d2, "d", "left_anti").agg(F.count(F.lit(1)).alias("missing_in_2"))
    m1 = d2.join(d1, "d", "left_anti").agg(F.count(F.lit(1)).alias("missing_in_1"))
    out = gs.attach(gs.attach(gs.attach(a, b, []), m2, []), m1, [])
    return out.withColumn("equal", (F.col("missing_in_1") == 0) & (F.col("missing_in_2") == 0))


def corr_topk(df: DataFrame, target: str, features: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most positive and ``k`` most negative correlations with ``target``."""
    cols = [target] + [c for c in features if c != target]
    m = corr_matrix(df, cols, only_with=target).where((F.col("var2") == target) & (F.col("var1") != target)).select(
        F.col("var1").alias("feature"), "corr")
    # m has one row per feature (bounded by the column list), so these windows are tiny.
    up = Window.orderBy(F.col("corr").desc_nulls_last(), "feature")
    down = Window.orderBy(F.col("corr").asc_nulls_last(), "feature")
    ranked = m.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    top = ranked.where(F.col("_up") <= k).select("feature", "corr", F.lit("positive").alias("direction"))
    bottom = ranked.where(F.col("_down") <= k).select("feature", "corr", F.lit("negative").alias("direction"))
    return top.unionByName(bottom)
