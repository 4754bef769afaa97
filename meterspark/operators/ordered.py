"""Order-dependent aggregates without a single-task global window.

A ``Window`` without ``partitionBy`` moves every row into one task.  The
helpers here compute running totals and dense indexes in a global order the
way a distributed prefix sum works: range-partition on the order, run the
window inside each range partition, total each partition, and add the
running total of the preceding partitions (one row per partition, so the
offsets table is bounded by the partition count and safe to broadcast).

The partition totals and the per-row window read the same range-partitioned
rows, materialised once by a reliable checkpoint, so they always agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _parts(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def running_totals(df: DataFrame, order: Sequence[Column], values: dict[str, Column | str],
                   partitions: int | None = None) -> DataFrame:
    """Add one running-sum column per entry of ``values`` (output name -> value), all in one pass.

    ``order`` must be a total order (add a unique tiebreaker) for the result
    to be deterministic.
    """
    order = list(order)
    names = list(values)
    vals = {f"_val{i}": (F.col(v) if isinstance(v, str) else v) for i, v in enumerate(values.values())}
    # The per-row window and the per-partition totals must see the same range
    # partitions.  Two independent recomputations of a range exchange need not
    # agree on its bounds, so the partitioned rows are written once (reliable
    # checkpoint in the shared checkpoint folder) and both branches read them.
    ranged = cut_lineage(df.select("*", *[c.alias(n) for n, c in vals.items()])
                         .repartitionByRange(_parts(df, partitions), *order).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *[F.sum(f"_val{i}").over(w).alias(f"_local{i}") for i in range(len(names))])
    totals = ranged.groupBy("_pid").agg(*[F.sum(f"_val{i}").alias(f"_pt{i}") for i in range(len(names))])
    # One row per partition: the window below is bounded by the partition count.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_pt{i}").over(before), F.lit(0)).alias(f"_off{i}")
                                      for i in range(len(names))])
    out = local.join(F.broadcast(offsets), "_pid")
    for i, name in enumerate(names):
        out = out.withColumn(name, F.col(f"_local{i}") + F.col(f"_off{i}"))
    drop = ["_pid"] + [f"_{p}{i}" for i in range(len(names)) for p in ("val", "local", "off")]
    return out.drop(*drop)


def running_total(df: DataFrame, order: Sequence[Column], value: Column | str, out: str,
                  partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows up to this one in ``order``."""
    return running_totals(df, order, {out: value}, partitions)


def dense_index(df: DataFrame, col: str, out: str, partitions: int | None = None) -> DataFrame:
    """Dimension of the distinct non-null values of ``col`` with codes 0..n-1 in ascending order."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    ranked = running_total(distinct, [F.col(col).asc()], F.lit(1), "_rank", partitions)
    return ranked.select(col, (F.col("_rank") - 1).cast("bigint").alias(out))
