"""Numeric helper expressions shared by Spark plans and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_EXACT = 2.0 ** 52


def rnd(col, digits: int) -> Column:
    """Round half up on the binary value: ``floor(x * 10^d + 0.5) / 10^d``.

    Written as plain arithmetic so that Spark and the SQL oracle round the
    same double the same way (engine ``round`` functions differ on ties).
    """
    c = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    # Beyond 2^52 / scale a double has no digit left to round (and floor would leave the 64-bit range).
    return F.when(F.abs(c) >= F.lit(_EXACT / scale), c.cast("double")).otherwise(F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale))


def rnd_sql(expr: str, digits: int) -> str:
    scale = f"{float(10 ** digits)}::DOUBLE"
    return (f"(CASE WHEN abs({expr}) >= {_EXACT / 10 ** digits!r}::DOUBLE THEN CAST(({expr}) AS DOUBLE) "
            f"ELSE floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale} END)")


def null_nan(col) -> Column:
    """NaN becomes NULL (pandas treats NaN as missing, Spark as a large value)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
