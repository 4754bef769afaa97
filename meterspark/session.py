"""SparkSession construction and cluster-facing settings.

Library code never builds its own session; it takes the caller's.  These
helpers exist for tests, the benchmark and the command line: they pin the
settings that oracle parity depends on (UTC session zone) and the ones that
matter at scale (AQE with skew-join splitting, a shared checkpoint folder).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "meterspark") -> SparkSession:
    """Create (or reuse) a session with the settings the library expects."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_conf(shuffle_partitions: int = 20_000) -> dict[str, str]:
    """Settings for a large cluster (about 100 TB of input, about 1000 executors).

    - scans: 512 MB input splits keep the task count near input / 512 MB
      (about 200k tasks for 100 TB) with column pruning and pushed filters;
    - shuffles start wide and AQE coalesces them to about 256 MB per partition,
      so the operators' pre-aggregated shuffles shrink automatically;
    - skewed sort-merge partitions (5x the median and above 512 MB) are split;
    - run-time broadcast only below 64 MB of measured size.
    Pass these to ``SparkSession.builder.config(...)`` or spark-submit.
    """
    return {
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only on a local master (one machine) is a scratch folder
    created and registered when it is unset; on a cluster that is an error.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        sc = None
    if not current and sc is not None:
        current = sc.getConf().get(CHECKPOINT_CONF, None)
    if current:
        if sc is not None:
            sc.setCheckpointDir(current)
        return current
    master = sc.master if sc is not None else ""
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="meterspark-ckpt-", dir="/tmp")
    spark.conf.set(CHECKPOINT_CONF, local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_table(df):
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back (columnar, lineage cut)."""
    return stored_at(df)[0]


def stored_at(df):
    """``stored_table`` and the folder it lies in, for ``drop_stored``."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark, path: str) -> None:
    """Overwrite a stored table that no later step reads by an empty one."""
    spark.range(0).write.mode("overwrite").parquet(path)
