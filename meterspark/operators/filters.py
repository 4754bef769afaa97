"""Row filters with pandas-compatible NULL handling and one-pass removal reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(subset) if subset else None)


def _ne(col, value) -> Column:
    """pandas ``!=``: true when either side is missing."""
    return F.coalesce(F.col(col) != F.lit(value), F.lit(True))


def irregular_span_keep(site_col="site_id", reading_col="meter_reading", month_col="month",
                        site=0, first_good_month=6) -> Column:
    """Keep unless site == ``site`` and reading == 0 and month < ``first_good_month``."""
    return _ne(site_col, site) | _ne(reading_col, 0) | F.coalesce(F.col(month_col) >= F.lit(first_good_month), F.lit(False))


def zero_reading_keep(reading_col="meter_reading", meter_col="meter", meter=0) -> Column:
    """Drop zero readings of one meter category."""
    return _ne(reading_col, 0) | _ne(meter_col, meter)


def removal_report(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows removed by each successive keep-predicate, computed in one pass.

    Returns (step, position, rows_before, removed, removed_share).
    """
    kept = F.lit(True)
    aggs = [F.count(F.lit(1)).alias("_n0")]
    for i, (_, cond) in enumerate(steps, start=1):
        kept = kept & cond
        aggs.append(F.count_if(kept).alias(f"_n{i}"))
    one = df.agg(*aggs)
    rows = ", ".join(f"'{name}', {i}, _n{i - 1}, _n{i - 1} - _n{i}" for i, (name, _) in enumerate(steps, start=1))
    return one.selectExpr(f"stack({len(steps)}, {rows}) as (step, position, rows_before, removed)").select(
        "step", F.col("position").cast("int").alias("position"), "rows_before", "removed",
        F.try_divide(F.col("removed"), F.col("rows_before")).alias("removed_share"))
