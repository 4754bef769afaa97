"""Scans and sinks (S1-S7).

Reads take a declared schema where one exists (no inference pass over the
data); a sample is a stable hash-bucket filter on the row keys so it is
reproducible under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from ..operators.groupstats import attach


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None,
               timestamp_cols: Sequence[str] = (), sample: float = 0.0, sample_keys: Sequence[str] = (),
               seed: int = 3) -> DataFrame:
    """Read a table; optionally coerce timestamp columns and keep a seeded sample.

    CSV files are read with a header; without a schema, types are inferred
    (one extra pass, avoid at scale).
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    df = reader.format(fmt).load(path)
    df = parse_timestamps(df, timestamp_cols)
    if sample and sample > 0:
        df = hash_sample(df, sample_keys or df.columns, sample, seed)
    return df


def parse_timestamps(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """String -> timestamp_ntz; anything unparsable becomes NULL."""
    for c in cols:
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.expr(f"try_cast(`{c}` AS TIMESTAMP_NTZ)"))
    return df


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 3) -> DataFrame:
    """Keep about ``fraction`` of the rows, chosen by a stable hash of ``keys``."""
    return df.where(exprs.in_share(keys, seed, fraction))


def downcast_plan(df: DataFrame, allow_float: bool = True) -> DataFrame:
    """Narrowest type per numeric column from one min/max pass (strict bounds).

    Integers go to tinyint/smallint/int/bigint; doubles to float when both
    bounds lie strictly inside the float range and ``allow_float``.
    Returns (column_name, min, max, target_type).
    """
    num = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    one = df.agg(*[F.min(f.name).cast("double").alias(f"_mn{i}") for i, f in enumerate(num)],
                 *[F.max(f.name).cast("double").alias(f"_mx{i}") for i, f in enumerate(num)])
    rows = []
    for i, f in enumerate(num):
        is_int = isinstance(f.dataType, T.IntegralType)
        rows.append(f"'{f.name}', {'true' if is_int else 'false'}, _mn{i}, _mx{i}")
    long = one.selectExpr(f"stack({len(num)}, {', '.join(rows)}) as (column_name, is_int, min, max)")

    def inside(lo, hi):
        return (F.col("min") > F.lit(float(lo))) & (F.col("max") < F.lit(float(hi)))

    f32 = 3.4028234663852886e38
    int_type = (F.when(inside(-128, 127), "tinyint").when(inside(-32768, 32767), "smallint")
                .when(inside(-2147483648, 2147483647), "int").otherwise("bigint"))
    float_type = F.when(F.lit(allow_float) & inside(-f32, f32), "float").otherwise("double")
    return long.select("column_name", "min", "max",
                       F.when(F.col("is_int"), int_type).otherwise(float_type).alias("target_type"))


def apply_downcast(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Cast columns to the planned types (the plan is one row per column)."""
    types = {r["column_name"]: r["target_type"] for r in plan.collect()}
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header, no index; one directory of part files."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def submission(scored: DataFrame, id_col: str = "row_id", pred_col: str = "prediction",
               out_col: str = "meter_reading") -> DataFrame:
    """(row_id, meter_reading): ids travel with their rows, never zipped by position."""
    return scored.select(F.col(id_col).alias("row_id"), F.col(pred_col).alias(out_col))


def missing_predictions(ids: DataFrame, preds: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Expected vs predicted counts and the ids without a prediction (left-anti)."""
    expected = ids.agg(F.count(F.lit(1)).alias("expected"))
    got = preds.agg(F.count(F.lit(1)).alias("predicted"))
    missing = ids.join(preds.select(id_col), id_col, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    one = attach(attach(expected, got, []), missing, [])  # single-row aggregates on a constant key
    return one.withColumn("abs_diff", F.abs(F.col("expected") - F.col("predicted")))
