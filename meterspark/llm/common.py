"""Helpers shared by the training-data operators: shared scratch tables and column care.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``
(``session.ensure_checkpoint_dir``), which every executor can reach; a lost
executor therefore never loses a stage that was already written.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.session import ensure_checkpoint_dir

#: Bytes of text per reduce bucket when an operator deals rows out itself.
BUCKET_BYTES = 8 << 20
#: With it Spark drops the shuffle files of a query when the query ends, not when the driver collects its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str | None = None) -> None:
    """Write ``df`` as Parquet; the shuffle files that this took are dropped at its end."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one run that can be dropped again when no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, list[str]] = {}

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = shared_path(self.spark, what)
        written(df, path, "zstd")
        self.paths.setdefault(what, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Overwrite the tables of these names by empty ones and let Spark drop finished shuffles."""
        for path in (p for n in names for p in self.paths.pop(n, [])):
            self.spark.range(0).write.mode("overwrite").parquet(path)
        release(self.spark)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now (it does so when their handles are collected)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more...) with NULL text as the empty text; other columns are left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts (one partial-aggregated row)."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def bucket_count(total_bytes: int, per_bucket: int = BUCKET_BYTES, least: int = 64) -> int:
    """Reduce buckets so that one bucket's share stays the same at every input size."""
    return max(least, -(-total_bytes // per_bucket))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def crc_mod(col: Column, mod: int) -> Column:
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))
