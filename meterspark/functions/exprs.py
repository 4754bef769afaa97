"""Scalar column expressions: mapping, hashing, formatting, conversions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# kBTU -> kWh factor, meter names, the label used for merged sparse labels,
# the GMT offset of each of the 16 sites (site_id 0..15), and the human-format suffixes.
KBTU_TO_KWH = 0.2931
METER_NAMES = {0: "electricity", 1: "chilledwater", 2: "steam", 3: "hotwater"}
SPARSE_LABEL = "NonTraditionalUsage"
SITE_GMT_OFFSETS = [-5, 0, -7, -5, -8, 0, -5, -5, -5, -6, -7, -5, 0, -6, -5, -5]
HUMAN_SUFFIXES = ["", "K", "M", "G", "T", "P"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def unit_convert(reading, meter, meter_code=0, factor: float = KBTU_TO_KWH) -> Column:
    """``reading * factor`` where ``meter == meter_code``, else unchanged."""
    return F.when(_c(meter) == F.lit(meter_code), _c(reading) * F.lit(factor)).otherwise(_c(reading))


def map_values(col, mapping: Mapping, reverse: bool = False) -> Column:
    """Literal dictionary lookup; unmapped values become NULL."""
    items = [(v, k) for k, v in mapping.items()] if reverse else list(mapping.items())
    flat = []
    for k, v in items:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)[_c(col)]


def hash_bucket(keys: Sequence[str], seed, buckets: int = 1000) -> Column:
    """Stable bucket in [0, buckets) from the md5 of the keys and a seed.

    Unlike ``rand(seed)`` the bucket does not depend on partitioning, so a
    split or a sample is reproducible after repartitioning or a retry.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))


def hash_bucket_sql(keys: Sequence[str], seed, buckets: int = 1000) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f", '{seed}')"
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) % {buckets})"


_SHARE_BITS = 52


def in_share(keys: Sequence[str], seed, fraction: float) -> Column:
    """Whether the row's stable 52-bit hash lies in the first ``fraction`` of its range (fractions down to 2^-52)."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    h = F.conv(F.substring(F.md5(text), 1, _SHARE_BITS // 4), 16, 10).cast("bigint")
    return h < F.lit(math.ceil(fraction * 2**_SHARE_BITS)).cast("bigint")


def in_share_sql(keys: Sequence[str], seed, fraction: float) -> str:
    text = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f", '{seed}')"
    return f"(CAST(('0x' || substr(md5({text}), 1, {_SHARE_BITS // 4})) AS BIGINT) < {math.ceil(fraction * 2**_SHARE_BITS)})"


def split_flag(keys: Sequence[str], seed=3, train_share: float = 0.8) -> Column:
    """0 = train, 1 = validation."""
    return F.when(hash_bucket(keys, seed) < F.lit(int(round(train_share * 1000))), F.lit(0)).otherwise(F.lit(1))


def split_flag_sql(keys: Sequence[str], seed=3, train_share: float = 0.8) -> str:
    return f"CASE WHEN {hash_bucket_sql(keys, seed)} < {int(round(train_share * 1000))} THEN 0 ELSE 1 END"


def human_format(col) -> Column:
    """1234 -> '1.23K', ... up to 'P'; two decimals, sign kept."""
    x = _c(col).cast("double")
    ax = F.abs(x)
    mag = F.lit(0)
    for i in range(1, len(HUMAN_SUFFIXES)):
        mag = F.when(ax >= F.lit(1000.0 ** i), F.lit(i)).otherwise(mag)
    scaled = x / F.pow(F.lit(1000.0), mag)
    rounded = F.floor(scaled * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)
    suffix = F.element_at(F.array(*[F.lit(s) for s in HUMAN_SUFFIXES]), mag + 1)
    return F.format_string("%.2f%s", rounded, suffix)


def human_format_sql(expr: str) -> str:
    ax = f"abs(CAST({expr} AS DOUBLE))"
    mag = "0"
    for i in range(1, len(HUMAN_SUFFIXES)):
        mag = f"CASE WHEN {ax} >= {1000.0 ** i}::DOUBLE THEN {i} ELSE {mag} END"
    arr = "[" + ", ".join(f"'{s}'" for s in HUMAN_SUFFIXES) + "]"
    rounded = f"(floor(CAST({expr} AS DOUBLE) / pow(1000.0::DOUBLE, {mag}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"
    return f"printf('%.2f%s', {rounded}, {arr}[{mag} + 1])"
