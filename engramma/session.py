"""Session factory and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

#: Bytes in a batch between Spark and Python; Spark's own default of 64 MB is many times that in a task's memory.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def build_session(app: str = "engramma", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, adaptive execution, skew-join handling.

    Cluster settings (master, memory, checkpoint directory) come from spark-submit; ``master`` is for local runs.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        _BATCH_SETTING: str(BATCH_BYTES),
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        defaults["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def _show_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if their machines have it there too."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def prepare(spark: SparkSession) -> None:
    """What a session that someone else built needs: workers that find this package, small batches unless a size was chosen."""
    _show_package(spark)
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables under ``sf_dir``, read by Spark so that any file system it knows will do."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
