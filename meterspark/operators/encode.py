"""Encoding, label handling and column-set operators (P-*, F5-F7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs
from . import groupstats as gs
from . import ordered
from .profile import value_share

# Primary uses with light weekend usage (code 0); every other use seen in train is 1.
WEEKEND_LIGHT_USES = ["Technology/science", "Utility", "Retail"]


def map_labels(df: DataFrame, col: str, mapping: Mapping, reverse: bool = False, out: str | None = None) -> DataFrame:
    """Dictionary map (forward or reversed); unmapped values become NULL."""
    return df.withColumn(out or col, exprs.map_values(col, mapping, reverse))


def map_labels_table(df: DataFrame, col: str, mapping: DataFrame, key: str = "key", value: str = "value",
                     reverse: bool = False, out: str | None = None) -> DataFrame:
    """Dictionary map held as a DataFrame (for dictionaries too large for a literal map).

    A left join on the key (AQE broadcasts a small dictionary at run time);
    unmapped values become NULL, as with the literal map.
    """
    k, v = (value, key) if reverse else (key, value)
    dim = mapping.select(F.col(k).alias("_map_k"), F.col(v).alias("_map_v")).dropDuplicates(["_map_k"])
    j = df.join(dim, F.col(col) == F.col("_map_k"), "left")
    return j.withColumn(out or col, F.col("_map_v")).drop("_map_k", "_map_v")


def label_encode(df: DataFrame, col: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sorted distinct values -> 0..n-1.  Returns (encoded rows, code->label dimension).

    The dimension has one row per distinct label; it is joined without a
    broadcast hint so AQE can choose by its measured size.
    """
    code = out or f"{col}_code"
    dim = ordered.dense_index(df, col, code)
    return df.join(dim, col, "left"), dim.select(F.col(code), F.col(col).alias("label"))


def needs_encoding(df: DataFrame, col: str, encode_to_int: bool) -> bool:
    """Encode only when the current type asks for it (string->int or int->string)."""
    if col not in df.columns:
        return False
    is_text = isinstance(df.schema[col].dataType, T.StringType)
    return is_text if encode_to_int else not is_text


def change_encoding(df: DataFrame, mappers: Mapping[str, Mapping], cols: Sequence[str], encode_to_int: bool) -> DataFrame:
    """Apply a code<->label mapper per column when the type demands it; no mapper -> untouched."""
    for c in cols:
        if c in mappers and needs_encoding(df, c, encode_to_int):
            df = map_labels(df, c, mappers[c], reverse=encode_to_int)
    return df


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One pass: (column_name, null_count, row_count) per column."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)])
    stack = "stack({n}, {pairs}) as (column_name, null_count)".format(
        n=len(cols), pairs=", ".join(f"'{c}', _n{i}" for i, c in enumerate(cols)))
    return one.selectExpr(stack, "_rows as row_count")


def columns_with_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Names of columns holding any NULL (one tiny aggregate row to the driver)."""
    row = null_counts(df, cols).where("null_count > 0").select("column_name").collect()
    return [r[0] for r in row]


def drop_null_columns(dfs: Sequence[DataFrame], reference: DataFrame | None = None) -> list[DataFrame]:
    """Drop from every frame the columns that hold NULLs in ``reference`` (default: first frame)."""
    ref = reference if reference is not None else dfs[0]
    bad = columns_with_nulls(ref)
    return [d.drop(*[c for c in bad if c in d.columns]) for d in dfs]


def sparse_feature_report(df: DataFrame, thresh: float = 0.5, compat_rounding: bool = False) -> DataFrame:
    """(column_name, null_share, dropped): dropped when the null share exceeds ``thresh``."""
    share = F.try_divide(F.col("null_count"), F.col("row_count"))  # NULL for a table without rows: nothing is dropped
    if compat_rounding:
        share = F.round(share, 3)
    return null_counts(df).select("column_name", share.alias("null_share"), (share > F.lit(thresh)).alias("dropped"))


def drop_sparse_features(dfs: Sequence[DataFrame], thresh: float = 0.5, reference: DataFrame | None = None,
                         compat_rounding: bool = False) -> list[DataFrame]:
    """Drop from every frame the columns whose NULL share in ``reference`` (default: first frame) exceeds ``thresh``.

    The shares are one aggregate row; a reference without rows drops nothing.
    """
    report = sparse_feature_report(reference if reference is not None else dfs[0], thresh, compat_rounding)
    bad = [r["column_name"] for r in report.where("dropped").collect()]  # one row per column
    return [d.drop(*[c for c in bad if c in d.columns]) for d in dfs]


def match_columns(df1: DataFrame, df2: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep only the columns both frames have, in the first frame's order."""
    common = [c for c in df1.columns if c in set(df2.columns)]
    return df1.select(*common), df2.select(*common)


def one_hot(df: DataFrame, categories: Mapping[str, Sequence], drop_source: bool = False) -> DataFrame:
    """``<col>_<value>`` 0/1 columns for a fixed category list per column."""
    cols = []
    for col, values in categories.items():
        for v in values:
            cols.append(F.when(F.col(col) == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(f"{col}_{v}"))
    out = df.select("*", *cols)
    return out.drop(*categories.keys()) if drop_source else out


def use_category(df: DataFrame, train: DataFrame, col: str = "primary_use", out: str = "use_categ",
                 light: Sequence[str] = WEEKEND_LIGHT_USES) -> DataFrame:
    """0 for the light-weekend uses (seen or not), 1 for any other use seen in ``train``, NULL otherwise.

    The uses are found while planning; up to ``gs.SMALL_ROWS`` are broadcast, so rows with the same use do not meet in one task.
    """
    seen = train.select(col).where(F.col(col).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    small = gs.materialize_small(seen)
    j = df.join(seen if small is None else F.broadcast(small), col, "left")
    code = F.when(F.col(col).isin(list(light)), F.lit(0)).when(F.col("_seen"), F.lit(1))
    return j.withColumn(out, code).drop("_seen")


def fill_zero(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> DataFrame:
    """NULL and NaN become 0 in ``cols``; with ``where`` only on the rows it selects (one pass for train and test)."""
    if where is None:
        return df.fillna(0, subset=list(cols))
    types = {f.name: f.dataType for f in df.schema.fields}
    filled = {}
    for c in cols:
        missing = F.col(c).isNull() | F.isnan(c) if isinstance(types[c], T.FractionalType) else F.col(c).isNull()
        filled[c] = F.when(where & missing, F.lit(0).cast(types[c])).otherwise(F.col(c))
    return df.withColumns(filled)


def remove_sparse_labels(df: DataFrame, col: str, thresh: float = 0.995, ignore_col: str | None = None,
                         ignore_val=None, compat_rounding: bool = False) -> DataFrame:
    """Drop rows whose label sits at or beyond cumulative share ``thresh`` (volume desc order).

    Rows with ``ignore_col == ignore_val`` always stay.  The removed-label list
    is joined as a left-anti join (AQE picks broadcast by measured size).
    """
    shares = value_share(df, col)
    cum = F.round(F.col("cumulative_perc"), 3) if compat_rounding else F.col("cumulative_perc")
    drop = shares.where(cum >= F.lit(thresh)).select(F.col("label").alias(col))
    if ignore_col is None:
        return df.join(drop, col, "left_anti")
    flagged = df.join(drop.withColumn("_drop", F.lit(True)), col, "left")
    keep = F.coalesce(F.col(ignore_col) == F.lit(ignore_val), F.lit(False)) | F.col("_drop").isNull()
    return flagged.where(keep).drop("_drop")


def sparse_labels(df: DataFrame, col: str, thresh: float = 0.005, compat_rounding: bool = False) -> DataFrame:
    """Labels whose share of non-null rows is at most ``thresh``."""
    shares = value_share(df, col)
    pct = F.round(F.col("percent"), 3) if compat_rounding else F.col("percent")
    return shares.where(pct <= F.lit(thresh)).select("label", "volume", "percent")


def combine_sparse_labels(df: DataFrame, col: str, labels: DataFrame, new_label: str = exprs.SPARSE_LABEL,
                          out: str | None = None) -> DataFrame:
    """Rename every label listed in ``labels`` (column ``label``) to ``new_label``."""
    tagged = labels.select(F.col("label").cast("string").alias("_lab")).distinct().withColumn("_hit", F.lit(True))
    j = df.join(tagged, F.col(col).cast("string") == F.col("_lab"), "left")
    return j.withColumn(out or col, F.when(F.col("_hit"), F.lit(new_label)).otherwise(F.col(col).cast("string"))) \
        .drop("_lab", "_hit")


def site_offsets_frame(spark, offsets=exprs.SITE_GMT_OFFSETS) -> DataFrame:
    """(site_id, offset_h) lookup built from the fixed per-site GMT offsets (site = list position)."""
    return spark.createDataFrame([(i, int(h)) for i, h in enumerate(offsets)], "site_id int, offset_h int")


def primary_use_map(df: DataFrame, col: str = "primary_use", extra_code: int = 99,
                    extra_label: str = exprs.SPARSE_LABEL) -> DataFrame:
    """code -> label mapper: sorted distinct labels as 0..n-1 plus one extra code for merged sparse labels."""
    dim = ordered.dense_index(df, col, "code").select("code", F.col(col).alias("label"))
    extra = df.sparkSession.createDataFrame([(extra_code, extra_label)], "code int, label string")
    return dim.unionByName(extra)
