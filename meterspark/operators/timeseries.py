"""Time-series operators: local-time shift, gap filling, hourly grids, pivots.

Positional interpolation is a segmented scan so that no series has to sit
in one task: rows are windowed per ``(series, chunk)`` (chunk = a time
bucket, a month by default), each chunk is summarised (row count, first and
last valid value with their positions), a small window over the chunk
summaries of a series carries values and row offsets across chunk borders,
and the summaries are joined back.  The work per task is bounded by the
chunk size, not by the series length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import groupstats as gs


def local_time_shift(df: DataFrame, offsets: DataFrame | None = None, site_col: str = "site_id", ts_col: str = "ts",
                     offset_col: str = "offset_h", out: str | None = None) -> DataFrame:
    """``ts + offset hours`` of the row's site; a site without an offset gets NULL.

    ``offsets`` is a lookup table (site -> hours); AQE broadcasts it by
    measured size.  Without it the fixed 16-site offset list is used.
    """
    if offsets is None:
        from .encode import site_offsets_frame
        offsets = site_offsets_frame(df.sparkSession).withColumnRenamed("site_id", site_col) \
            .withColumnRenamed("offset_h", offset_col)
    j = df.join(offsets.select(site_col, offset_col), site_col, "left")
    shifted = F.expr(f"timestampadd(HOUR, {offset_col}, {ts_col})")
    return j.withColumn(out or ts_col, shifted).drop(offset_col)


def _scan(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], chunk: Column | None,
          tiebreak: Sequence[str]) -> DataFrame:
    """Per row and column: previous / next valid value and their row positions in the series."""
    by = list(by)
    d = df.withColumn("_chunk", chunk if chunk is not None else F.date_trunc("month", F.col(order)))
    part = by + ["_chunk"]
    ow = Window.partitionBy(*part).orderBy(F.col(order), *[F.col(t) for t in tiebreak])
    back = ow.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The next valid value is the last one seen in the opposite order: a growing frame, linear in the chunk.
    fwd = Window.partitionBy(*part).orderBy(F.col(order).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tiebreak]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_rl", F.row_number().over(ow))
    for i, c in enumerate(cols):
        pos = F.when(F.col(c).isNotNull(), F.col("_rl"))
        d = d.withColumn(f"_pv{i}", F.last(c, True).over(back)).withColumn(f"_pp{i}", F.last(pos, True).over(back)) \
             .withColumn(f"_nv{i}", F.last(c, True).over(fwd)).withColumn(f"_np{i}", F.last(pos, True).over(fwd))

    # Chunk summaries: bounded by (series x chunks), carried across chunk borders.
    aggs = [F.count(F.lit(1)).alias("_cn")]
    for i, c in enumerate(cols):
        pos = F.when(F.col(c).isNotNull(), F.col("_rl"))
        aggs += [F.max_by(F.col(c), pos).alias(f"_lv{i}"), F.max(pos).alias(f"_lp{i}"),
                 F.min_by(F.col(c), pos).alias(f"_fv{i}"), F.min(pos).alias(f"_fp{i}")]
    summ = d.groupBy(*part).agg(*aggs)
    sw = Window.partitionBy(*by).orderBy("_chunk")
    before = sw.rowsBetween(Window.unboundedPreceding, -1)
    after = sw.rowsBetween(1, Window.unboundedFollowing)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_cn").over(before), F.lit(0)))
    carried = [*part, "_off"]
    for i, _ in enumerate(cols):
        summ = summ.withColumn(f"_glp{i}", F.col(f"_lp{i}") + F.col("_off")) \
                   .withColumn(f"_gfp{i}", F.col(f"_fp{i}") + F.col("_off"))
        summ = summ.withColumn(f"_cpv{i}", F.last(f"_lv{i}", True).over(before)) \
                   .withColumn(f"_cpp{i}", F.last(f"_glp{i}", True).over(before)) \
                   .withColumn(f"_cnv{i}", F.first(f"_fv{i}", True).over(after)) \
                   .withColumn(f"_cnp{i}", F.first(f"_gfp{i}", True).over(after))
        carried += [f"_cpv{i}", f"_cpp{i}", f"_cnv{i}", f"_cnp{i}"]
    j = gs.null_safe_join(d, summ.select(*carried), part, "inner")  # NULL series and NULL times keep their rows
    j = j.withColumn("_rn", F.col("_rl") + F.col("_off"))
    for i, _ in enumerate(cols):
        j = j.withColumn(f"_pv{i}", F.coalesce(F.col(f"_pv{i}"), F.col(f"_cpv{i}"))) \
             .withColumn(f"_pp{i}", F.coalesce(F.col(f"_pp{i}") + F.col("_off"), F.col(f"_cpp{i}"))) \
             .withColumn(f"_nv{i}", F.coalesce(F.col(f"_nv{i}"), F.col(f"_cnv{i}"))) \
             .withColumn(f"_np{i}", F.coalesce(F.col(f"_np{i}") + F.col("_off"), F.col(f"_cnp{i}")))
    return j


def _cleanup(df: DataFrame, n: int) -> DataFrame:
    drop = ["_chunk", "_rl", "_off", "_rn"]
    for i in range(n):
        drop += [f"_{p}{i}" for p in ("pv", "pp", "nv", "np", "cpv", "cpp", "cnv", "cnp")]
    return df.drop(*drop)


def interpolate_linear(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str],
                       fill_edges: bool = False, chunk: Column | None = None,
                       tiebreak: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation by row position within each series.

    ``order`` (plus ``tiebreak``) must be unique within a series: positions
    come from ``row_number`` and are reused by the chunk summaries, so ties
    would make them depend on evaluation order.

    Inner gaps: ``prev + (next - prev) * (rn - prev_rn) / (next_rn - prev_rn)``;
    trailing gaps take the last valid value; leading gaps stay NULL unless
    ``fill_edges`` (then they take the first valid value, i.e. a backfill).
    All-NULL series stay NULL.
    """
    cols = list(cols)
    j = _scan(df, by, order, cols, chunk, tiebreak)
    for i, c in enumerate(cols):
        pv, pp, nv, np_ = (F.col(f"_{p}{i}") for p in ("pv", "pp", "nv", "np"))
        inner = F.when(pv.isNotNull() & nv.isNotNull(), pv + (nv - pv) * (F.col("_rn") - pp) / (np_ - pp))
        parts = [F.col(c), inner, pv] + ([nv] if fill_edges else [])
        j = j.withColumn(c, F.coalesce(*parts))
    return _cleanup(j, len(cols))


def back_forward_fill(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str],
                      chunk: Column | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Fill a NULL with the next valid value of its series, else the previous one."""
    cols = list(cols)
    j = _scan(df, by, order, cols, chunk, tiebreak)
    for i, c in enumerate(cols):
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_nv{i}"), F.col(f"_pv{i}")))
    return _cleanup(j, len(cols))


def time_grid(df: DataFrame, by: Sequence[str], ts_col: str = "ts", step: str = "1 hour") -> DataFrame:
    """Every series x every step between the global min and max timestamp."""
    by = list(by)
    rng = df.agg(F.min(ts_col).alias("_mn"), F.max(ts_col).alias("_mx"))
    series = df.select(*by).distinct()
    spine = gs.attach(series, rng, [])
    return spine.select(*by, F.explode(F.sequence(F.col("_mn"), F.col("_mx"), F.expr(f"INTERVAL {step}"))).alias(ts_col))


def fill_time_grid(df: DataFrame, by: Sequence[str], ts_col: str = "ts", step: str = "1 hour") -> DataFrame:
    """Right join onto the full grid: off-grid rows vanish, missing steps appear with NULLs."""
    return time_grid(df, by, ts_col, step).join(df, list(by) + [ts_col], "left")


def fill_time_interpolate(df: DataFrame, by: Sequence[str], cols: Sequence[str], ts_col: str = "ts",
                          step: str = "1 hour") -> DataFrame:
    """Complete the hourly grid, then interpolate (with edge fill) again."""
    grid = fill_time_grid(df, by, ts_col, step)
    return interpolate_linear(grid, by, ts_col, cols, fill_edges=True)


def pivot_series(df: DataFrame, index: str, series: str, value: str, values: Sequence, prefix: str | None = None,
                 agg: str = "max") -> DataFrame:
    """Wide table: one column per series value, aggregated explicitly (duplicates never multiply)."""
    p = df.groupBy(index).pivot(series, list(values)).agg(F.expr(f"{agg}({value})"))
    pre = prefix if prefix is not None else f"{series}_"
    return p.select(index, *[F.col(f"`{v}`").alias(f"{pre}{v}") for v in values])
