"""Removal of runs of consecutive zero-sum days (gaps and islands).

Semantics of the source analysis:
- within the rows matching a rule's filter, readings are summed per
  (entity, day); a missing sum counts as 0;
- runs are over the *observed* days of an entity in sorted order (a missing
  calendar day does not break a run; with one season spanning a year end,
  February and December days are neighbours);
- zero days in runs of at least ``n_consec`` are removed, shorter runs stay;
- rows outside every rule's filter always stay.

Plan: pre-aggregate to one row per (rule, entity, day) before any window, so
a hot entity contributes at most one row per day; one window pass per
(rule, entity) numbers the runs (``lag`` change flag + running sum), a
second counts run lengths; the removed (rule, entity, day) keys are then
anti-joined back.  Several rules (for instance one per meter and season)
run in this single pass: the rule table is tiny and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rules_frame(spark: SparkSession, rules: Sequence[dict]) -> DataFrame:
    """Rules as a DataFrame: each dict maps filter columns to values plus ``n_consec``."""
    return spark.createDataFrame([dict(r) for r in rules])


def zero_day_runs(df: DataFrame, entity: str, day: str, value: str, filter_cols: Sequence[str],
                  rules: DataFrame) -> DataFrame:
    """(filter cols, entity, day, day_sum, run_id, run_len, n_consec, remove) per observed day."""
    keys = list(filter_cols)
    # The rule table is a handful of literal rows: broadcast is size-safe.
    scoped = df.join(F.broadcast(rules), keys, "inner")
    daily = scoped.groupBy(*keys, entity, day).agg(
        F.coalesce(F.sum(value), F.lit(0.0)).alias("day_sum"), F.first("n_consec").alias("n_consec"))
    w = Window.partitionBy(*keys, entity).orderBy(day)
    zero = F.col("day_sum") == 0
    daily = daily.withColumn("_z", zero) \
        .withColumn("_chg", F.when(F.lag("_z").over(w) == F.col("_z"), F.lit(0)).otherwise(F.lit(1))) \
        .withColumn("run_id", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rw = Window.partitionBy(*keys, entity, "run_id")
    daily = daily.withColumn("run_len", F.count(F.lit(1)).over(rw))
    return daily.withColumn("remove", F.col("_z") & (F.col("run_len") >= F.col("n_consec"))).drop("_z", "_chg")


def remove_consecutive_zero_days(df: DataFrame, entity: str, day: str, value: str, filter_cols: Sequence[str],
                                 rules: DataFrame) -> DataFrame:
    """Drop the rows of zero days in long zero runs, per rule; other rows untouched."""
    keys = list(filter_cols) + [entity, day]
    removed = zero_day_runs(df, entity, day, value, filter_cols, rules).where("remove").select(*keys)
    return df.join(removed, keys, "left_anti")
