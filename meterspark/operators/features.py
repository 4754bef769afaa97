"""Feature transforms: shared-shift log, min-max scaling, samples, splits (X-*, P14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs
from . import groupstats as gs

# Log features removed from the model and flags added to it.
REMOVED_FEATURES = ["log_wind_direction", "log_wind_speed", "log_sea_level_pressure",
                    "log_precip_depth_1_hr", "log_cloud_coverage"]
FLAG_FEATURES = ["is_workday", "is_holiday", "is_business_hr"]


def log_transform(df: DataFrame, cols: Sequence[str], prefix: bool = True) -> DataFrame:
    """``ln(c + |m| + 1)`` when the global minimum ``m`` over all ``cols`` is <= 0, else ``ln(c)``.

    One aggregate row gives ``m``; it is joined on a constant key (no driver
    round trip, no cross join).
    """
    cols = list(cols)
    gmin = df.agg(F.least(*[F.min(F.col(c).cast("double")) for c in cols]).alias("_gmin")) if len(cols) > 1 \
        else df.agg(F.min(F.col(cols[0]).cast("double")).alias("_gmin"))
    j = gs.attach(df, gmin, [])
    shift = F.when(F.col("_gmin") <= 0, F.abs(F.col("_gmin")) + F.lit(1.0)).otherwise(F.lit(0.0))
    for c in cols:
        j = j.withColumn(f"log_{c}" if prefix else c, F.ln(F.col(c).cast("double") + shift))
    return j.drop("_gmin")


def minmax_fit(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of per-column min and max from the training rows."""
    return train.agg(*[F.min(c).cast("double").alias(f"_min_{c}") for c in cols],
                     *[F.max(c).cast("double").alias(f"_max_{c}") for c in cols])


def minmax_apply(df: DataFrame, fitted: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """``(x - min) / (max - min)``; a constant training column keeps range 1."""
    j = gs.attach(df, fitted, [])
    for c in cols:
        rng = F.col(f"_max_{c}") - F.col(f"_min_{c}")
        rng = F.when(rng == 0, F.lit(1.0)).otherwise(rng)
        j = j.withColumn(c + suffix, (F.col(c) - F.col(f"_min_{c}")) / rng)
    return j.drop(*[c for c in fitted.columns])


#: Largest sample taken with a per-task top-n heap; beyond it a hash threshold is found first.
TOP_N_ROWS = 100_000


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 5, top_n_rows: int = TOP_N_ROWS) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the ``n`` smallest (stable key hash, keys).

    Up to ``top_n_rows`` this is one top-n.  A larger sample first counts rows
    per leading 16 bits of the hash (one job, at most 65,536 counts), keeps
    every row below the slice that holds the n-th one, and takes a top-n of
    that slice only.  Both ways give the same rows.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    hashed = df.withColumn("_h", h)
    if n <= top_n_rows:
        return hashed.orderBy("_h", *keys).limit(n).drop("_h")
    counts = hashed.groupBy(F.shiftright("_h", 16).alias("s")).agg(F.count(F.lit(1)).alias("c")).orderBy("s").collect()
    left = n
    for r in counts:
        if r["c"] >= left:
            cut = F.shiftright("_h", 16)
            edge = hashed.where(cut == r["s"]).orderBy("_h", *keys).limit(left)
            return hashed.where(cut < r["s"]).unionByName(edge).drop("_h")
        left -= r["c"]
    return df


def fraction_sample(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 5,
                    per_feature_rule: bool = False, n_features: int = 0) -> DataFrame:
    """Stable hash sample of about ``fraction`` of the rows.

    With ``per_feature_rule`` the fraction is ``10 * n_features / rows``
    (one scalar count).
    """
    if per_feature_rule and n_features:
        fraction = min(1.0, 10.0 * n_features / max(1, df.count()))
    return df.where(exprs.in_share(keys, seed, fraction))


def split_counts(df: DataFrame, by: Sequence[str], split_col: str, target: str, log_y: bool = False) -> DataFrame:
    """Rows and mean target per group and split; optional log1p target."""
    y = F.log1p(F.col(target)) if log_y else F.col(target)
    return df.groupBy(*by, split_col).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_target"))


def select_features(columns: Sequence[str], start: str = "log_square_feet",
                    removed: Sequence[str] = REMOVED_FEATURES, flags: Sequence[str] = FLAG_FEATURES) -> list[str]:
    """Columns from ``start`` on, minus ``removed``, plus the flag features (names only)."""
    cols = list(columns)
    keep = cols[cols.index(start):] if start in cols else []
    keep = [c for c in keep if c not in set(removed)]
    return keep + [f for f in flags if f not in keep]
