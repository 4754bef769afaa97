"""Group statistics that stay distributed when one group is huge.

``quantiles`` computes *exact* linear-interpolated quantiles (the pandas /
DuckDB ``quantile_cont`` definition) per group by narrowing value ranges:

1. one partial-aggregated pass gives ``n``, minimum and maximum of every group;
2. groups of at most ``cells`` rows are counted by (group, value) and ranked;
3. for larger groups (at most rows / ``cells`` of them) every wanted rank starts
   with the group's whole value range.  A pass cuts each range into ``cells``
   equal cells, counts the rows per cell (map-side partial sums, so what is
   shuffled are counters: at most groups x ranks x ``cells``), and keeps the cell
   that holds the rank, tightened to the smallest and largest value in it.  The
   two ends of a range are cells of their own, so every pass makes progress,
   whatever the values are.  When a range holds one value, or at most ``cells``
   rows, it is counted by value and the rank is read off.

A task holds at most ``cells`` counters of one range; no sketch, no band that
grows with the group, and the rows of large groups are never shuffled: the
ranges (a checked number of rows) are broadcast.  The number of passes is the
number of times the range can shrink by ``cells``: one to three for ordinary
data.  Passes are jobs that run when the function is called.

``attach`` joins one row of statistics per group back onto the rows.  When
the caller can prove the number of groups is small (a literal value list, a
fixed code domain) the statistics side is broadcast; otherwise the join is
left to AQE, which broadcasts at run time below its measured size threshold
and otherwise sort-merge joins with skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Counters per value range and rows up to which a group or range is counted value by value.
CELLS = 1 << 16
_GLOBAL_KEY = "__group"


def _keys_or_global(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    keys = list(keys)
    if keys:
        return df, keys
    return df.withColumn(_GLOBAL_KEY, F.lit(0)), [_GLOBAL_KEY]


SMALL_ROWS = 10_000


def materialize_small(stats: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """Compute a small statistics table once and return it as a local relation.

    The row count is checked (at most ``max_rows + 1`` rows reach the driver);
    above the bound ``None`` is returned and the caller keeps the lazy plan.
    Downstream scans then reuse the values instead of recomputing the
    aggregate that produced them.
    """
    rows = stats.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return None
    return stats.sparkSession.createDataFrame(rows, stats.schema)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   small_right: bool = False) -> DataFrame:
    """Equi-join on ``keys`` in which NULL keys match each other (a NULL group is a group)."""
    renamed = right.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_key_{i}"]) for i, k in enumerate(keys)])
    return left.join(F.broadcast(renamed) if small_right else renamed, on, how).drop(*[f"_key_{i}" for i in range(len(keys))])


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], bounded: bool = False,
           how: str = "left", materialize: bool = False) -> DataFrame:
    """Join per-group statistics onto rows.

    ``bounded=True`` asserts that ``stats`` has a small, known number of rows
    (one per literal value or per fixed code) and broadcasts it.  With no keys
    the statistics are a single row joined on a constant key.  With
    ``materialize`` a bounded table is computed once (size-checked) so that
    several consumers of the result do not recompute it.
    """
    keys = list(keys)
    if materialize and (bounded or not keys):
        small = materialize_small(stats)
        if small is not None:
            stats = small
    if not keys:
        return attach_scalar(df, stats)
    return null_safe_join(df, stats, keys, how, bounded)


def attach_scalar(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the columns of a one-row statistics table to every row.

    Uses one scalar subquery (a struct of all statistics) instead of a join:
    Spark evaluates it once and inlines the value, so there is no cross join
    and no shuffle.  An empty ``stats`` gives NULLs.
    """
    cols = [c for c in stats.columns if c != _GLOBAL_KEY]
    sub = stats.select(F.struct(*[F.col(c) for c in cols]).alias("_stats")).scalar()
    out = df.withColumn("_stats", sub)
    return out.select(*[c for c in df.columns if c not in cols],
                      *[F.col("_stats").getField(c).alias(c) for c in cols])


def _cell(v, lo, hi, cells: int):
    """Cell of ``v`` in the range: never falling in ``v``; the two ends are cells of their own.

    Halves keep the width finite; a width or a share that is not a number (infinite ends) counts as the first cell.
    """
    share = F.coalesce(F.nanvl(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(0.0)), F.lit(0.0))
    inner = F.least(F.floor(F.least(share, F.lit(1.0)) * cells), F.lit(cells - 1))
    return F.when(v <= lo, -1).when(v >= hi, cells).otherwise(inner).cast("int")


def _in_ranges(base: DataFrame, ranges: DataFrame, gk: Sequence[str], few: bool) -> DataFrame:
    """Rows whose value lies in a range of their group, with that range (ranges of one group do not overlap)."""
    per = ranges.groupBy(*gk).agg(F.collect_set(F.struct("_lo", "_hi")).alias("_ranges"))  # at most one per wanted rank
    rows = null_safe_join(base, per, gk, "inner", few)
    hit = F.filter("_ranges", lambda r: (F.col("_v") >= r["_lo"]) & (F.col("_v") <= r["_hi"]))
    return rows.withColumn("_range", F.get(hit, F.lit(0))).where(F.col("_range").isNotNull()).select(
        *gk, "_v", F.col("_range._lo").alias("_lo"), F.col("_range._hi").alias("_hi"))


def _narrowed(base: DataFrame, targets: DataFrame, gk: Sequence[str], cells: int, few: bool) -> DataFrame:
    """Every target (group, rank) with the cell of its range that holds the rank: new range, rows below it, rows in it."""
    rows = _in_ranges(base, targets, gk, few)
    counted = rows.groupBy(*gk, "_lo", "_hi", _cell(F.col("_v"), F.col("_lo"), F.col("_hi"), cells).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    before = Window.partitionBy(*gk, "_lo", "_hi").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    found = null_safe_join(counted, targets.select(*gk, "_lo", "_hi", "_n", "_rank", "_below"), [*gk, "_lo", "_hi"], "inner", few)
    at = F.col("_rank") - F.col("_below")
    return found.where((F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))).select(
        *gk, "_n", "_rank", F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"),
        F.col("_c").alias("_count"))


def _ranked(counted: DataFrame, part: Sequence[str], below) -> DataFrame:
    """(group, _n, _v, _start, _end): first and last rank of every counted value."""
    w = Window.partitionBy(*part).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = below + F.sum("_c").over(w) - 1
    return counted.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_c") + 1)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str] | None = None, cells: int = CELLS,
              extra_aggs: Sequence | None = None) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group (nulls and NaN skipped).

    Returns one row per group with one column per probability.  With empty
    ``keys`` the result is one row.  ``extra_aggs`` (aggregate columns over the
    *input* rows, e.g. counts including NULL values) ride along in the first
    pass, so plain statistics cost no extra scan; with them every group of the
    input is returned (quantile NULL when the group has no value).  NULL keys
    form a group of their own.
    """
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{i}" for i in range(len(probs))]
    user_keys = list(keys)
    extra_aggs = list(extra_aggs or [])
    v = F.col(value).cast("double")
    base = df.select(*user_keys, F.nanvl(v, F.lit(None).cast("double")).alias("_v"), *(
        [F.col(c) for c in df.columns if c not in user_keys and c != "_v"] if extra_aggs else []))
    base, gk = _keys_or_global(base, user_keys)

    first = base.groupBy(*gk).agg(F.count("_v").alias("_n"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"), *extra_aggs)
    extra_names = first.columns[len(gk) + 3:]
    first = materialize_small(first) or first
    base = base.where(F.col("_v").isNotNull()).select(*gk, (F.col("_v") + 0.0).alias("_v"))  # one zero
    large = first.where(F.col("_n") > cells).select(*gk, "_n", "_mn", "_mx")
    known = materialize_small(large)
    few = known is not None
    if not few:
        known = cut_lineage(large)  # more large groups than the driver should hold: their ranges stay distributed

    if known.isEmpty():
        small = base
    else:
        flag = known.select(*gk, F.lit(True).alias("_large"))
        small = null_safe_join(base, flag, gk, "left", few).where(F.col("_large").isNull()).drop("_large")
    small = _ranked(small.groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_c")), gk, F.lit(0))
    values = small.withColumn("_n", F.sum("_c").over(Window.partitionBy(*gk))).select(*gk, "_n", "_v", "_start", "_end")

    if not known.isEmpty():
        ranks = [r for p in probs for r in (F.floor(F.lit(p) * (F.col("_n") - 1)),
                                            F.least(F.floor(F.lit(p) * (F.col("_n") - 1)) + 1, F.col("_n") - 1))]
        targets = known.select(*gk, "_n", F.explode(F.array_distinct(F.array(*ranks))).alias("_rank"), F.col("_mn").alias("_lo"),
                               F.col("_mx").alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_count"))
        wide = (F.col("_lo") < F.col("_hi")) & (F.col("_count") > cells)
        done = []
        while True:
            done.append(targets.where(~wide))
            targets = targets.where(wide)
            if targets.isEmpty():
                break
            targets = _narrowed(base, targets, gk, cells, few)
            targets = materialize_small(targets, 2 * len(probs) * SMALL_ROWS) if few else cut_lineage(targets)
        ready = reduce(DataFrame.unionByName, done)
        span = ready.select(*gk, "_n", "_lo", "_hi", "_below", "_count").distinct()
        one = span.where(F.col("_lo") == F.col("_hi")).select(
            *gk, "_n", F.col("_lo").alias("_v"), F.col("_below").alias("_start"), (F.col("_below") + F.col("_count") - 1).alias("_end"))
        span = span.where(F.col("_lo") < F.col("_hi"))
        rows = _in_ranges(base, span, gk, few).groupBy(*gk, "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("_c"))
        rows = null_safe_join(rows, span.drop("_count"), [*gk, "_lo", "_hi"], "inner", few)
        many = _ranked(rows, [*gk, "_lo", "_hi"], F.col("_below")).select(*gk, "_n", "_v", "_start", "_end")
        values = values.unionByName(many).unionByName(one)

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank <= F.col("_end")), F.col("_v")))

    aggs = []
    for i, p in enumerate(probs):
        low = F.floor(F.lit(p) * (F.col("_n") - 1))
        aggs += [at(low).alias(f"_a{i}"), at(F.least(low + 1, F.col("_n") - 1)).alias(f"_b{i}")]
    picked = values.groupBy(*gk).agg(F.max("_n").alias("_n"), *aggs)

    def interp(i):
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        pos = F.lit(probs[i]) * (F.col("_n") - 1)
        return F.when(b == a, a).otherwise(a + (pos - F.floor(pos)) * (b - a))

    out = picked.select(*gk, *[interp(i).alias(names[i]) for i in range(len(probs))])
    if extra_names:
        # One row per input group: the first pass carries the extra statistics.
        if user_keys:
            out = null_safe_join(first.select(*gk, *extra_names), out, gk, "left")
        else:
            out = attach_scalar(first.select(*gk, *extra_names), out.drop(_GLOBAL_KEY))
    if not user_keys:
        out = out.drop(_GLOBAL_KEY)
    return out


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
           cells: int = CELLS, extra_aggs: Sequence | None = None) -> DataFrame:
    return quantiles(df, keys, value, [0.5], [name], cells, extra_aggs)
