"""Outlier labelling by modified z-score (MAD) or by quartile fences.

Four modes: over the whole column or per value of a grouping column.  All
statistics are aggregates joined back to the rows; no mode collects a group.

Semantics kept from the source analysis:
- MAD mode: outlier iff ``|0.6745 (y - median)| / mad > 3`` where ``mad`` is
  the *mean* absolute deviation about the *mean*.  Written without division
  (``|0.6745 (y - median)| > 3 mad``), which has the same truth table
  including zero spread (0/0 -> normal, x/0 -> outlier).  A missing value is
  normal.
- Quartile mode: normal iff ``q1 - 3 iqr < y < q3 + 3 iqr`` (strict) with
  linearly interpolated quartiles; a missing value is an outlier.
- Per-group labels read ``Outlier_<col>-<value>`` / ``Normal_<col>-<value>``;
  rows whose group is not in the requested list get NULL.
- Re-labelling into an existing column: MAD mode keeps old labels and only
  fills NULLs; quartile mode writes new labels and keeps old ones elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import null_nan
from . import groupstats as gs

# Modified z-score cutoff and the normal-consistency constant.
CUTOFF = 3.0
Z_CONST = 0.6745


def _restrict(df: DataFrame, by: str | None, by_vals) -> DataFrame:
    if by is None or by_vals is None:
        return df
    return df.where(F.col(by).isin(list(by_vals)))


def mad_stats(df: DataFrame, value: str, by: str | None = None, by_vals: Sequence | None = None,
              cells: int = gs.CELLS) -> DataFrame:
    """Per group: median, mean and mean absolute deviation about the mean."""
    keys = [by] if by else []
    bounded = by_vals is not None or not keys
    src = _restrict(df, by, by_vals).select(*keys, null_nan(value).alias("_y"))
    # The mean rides along in the median's sketch pass; the deviation needs a second pass.
    med = gs.median(src, keys, "_y", "_median", cells, extra_aggs=[F.avg("_y").alias("_mean")])
    dev = gs.attach(src, med.select(*keys, "_mean") if keys else med.select("_mean"), keys, bounded=bounded, how="inner") \
        .groupBy(*keys).agg(F.avg(F.abs(F.col("_y") - F.col("_mean"))).alias("_mad"))
    if not keys:
        return gs.attach(med, dev, [])
    return med.join(dev, keys, "left")


def quartile_stats(df: DataFrame, value: str, by: str | None = None, by_vals: Sequence | None = None,
                   cells: int = gs.CELLS) -> DataFrame:
    keys = [by] if by else []
    src = _restrict(df, by, by_vals).select(*keys, null_nan(value).alias("_y"))
    return gs.quantiles(src, keys, "_y", [0.25, 0.75], ["_q1", "_q3"], cells)


def _group_label(flag, by: str) -> F.Column:
    return F.concat(F.when(flag, F.lit("Outlier_")).otherwise(F.lit("Normal_")),
                    F.lit(f"{by}-"), F.col(by).cast("string"))


def detect_outliers(df: DataFrame, value: str, new_col: str, detect_type: str = "MAD",
                    by: str | None = None, by_vals: Sequence | None = None,
                    cells: int = gs.CELLS) -> DataFrame:
    """Add ``new_col`` with outlier labels (see module doc)."""
    mode = detect_type.upper()
    keys = [by] if by else []
    bounded = by_vals is not None or not keys
    y = null_nan(value)
    if mode == "MAD":
        stats = mad_stats(df, value, by, by_vals, cells)
        is_out = F.coalesce(F.abs(F.lit(Z_CONST) * (y - F.col("_median"))) > F.lit(CUTOFF) * F.col("_mad"), F.lit(False))
    elif mode == "QUARTILE":
        stats = quartile_stats(df, value, by, by_vals, cells)
        iqr = F.col("_q3") - F.col("_q1")
        normal = (y > F.col("_q1") - F.lit(CUTOFF) * iqr) & (y < F.col("_q3") + F.lit(CUTOFF) * iqr)
        is_out = ~F.coalesce(normal, F.lit(False))
    else:
        raise ValueError(f"unknown detect_type {detect_type!r}")

    # Labels usually feed several scans; a bounded statistics table is computed once.
    joined = gs.attach(df, stats, keys, bounded=bounded, materialize=bounded)
    if by is None:
        label = F.when(is_out, F.lit("Outlier")).otherwise(F.lit("Normal"))
    else:
        in_list = F.col(by).isin(list(by_vals)) if by_vals is not None else F.col(by).isNotNull()
        label = F.when(in_list, _group_label(is_out, by))
    if new_col in df.columns:
        label = F.coalesce(F.col(new_col), label) if mode == "MAD" else F.coalesce(label, F.col(new_col))
    out = joined.withColumn(new_col, label)
    return out.drop(*[c for c in stats.columns if c.startswith("_")])


def keep_normal(df: DataFrame, label_col: str) -> DataFrame:
    """Keep rows whose label contains 'Normal' or is NULL."""
    return df.where(F.coalesce(F.col(label_col).contains("Normal"), F.lit(True)))


def two_stage(df: DataFrame, value: str, by: str, by_vals: Sequence, entity: str, top: int = 2,
              first_label: str = "outliers_target_type", second_label: str = "outliers_target_user",
              cells: int = gs.CELLS) -> DataFrame:
    """Rows that pass MAD labels per ``by`` and then, among them, per entity for the ``top`` most variable entities.

    The second stage sees only what the first one kept; rows of other entities get a NULL second label and stay.
    Both label columns are returned.
    """
    from .profile import top_variation

    kept = keep_normal(detect_outliers(df, value, first_label, "MAD", by=by, by_vals=by_vals, cells=cells), first_label)
    most = top_variation(kept, entity, value, top).select(entity)
    # ``top`` rows at most (a proven bound), so they are broadcast.
    flagged = kept.join(F.broadcast(most.withColumn("_top", F.lit(True))), entity, "left")
    stats = mad_stats(flagged.where(F.col("_top")).drop("_top"), value, by=entity, by_vals=None, cells=cells)
    is_out = F.coalesce(F.abs(F.lit(Z_CONST) * (null_nan(value) - F.col("_median"))) > F.lit(CUTOFF) * F.col("_mad"), F.lit(False))
    labelled = gs.attach(flagged, stats, [entity], bounded=True) \
        .withColumn(second_label, F.when(F.col("_top"), _group_label(is_out, entity)))
    return keep_normal(labelled, second_label).drop("_top", *[c for c in stats.columns if c.startswith("_")])
