"""The shared working folder: written tables that cut lineage, and files written by tasks.

Everything goes under ``spark.checkpoint.dir``, the one folder that the driver and all executors see. Where that
setting is absent in local mode (tests, a laptop) a local folder is chosen and made the checkpoint folder of the
session; on a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "engramma-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Folders made inside each open ``scratch``, the innermost last.
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/engramma/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end every folder that the library made inside: results read them lazily, so save what is to stay before.

    For one thread at a time; scopes may stand inside each other.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


#: Spark deletes what a finished query shuffled, not when its driver next collects garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession, free: bool = True) -> Iterator[None]:
    """What queries that finish inside have shuffled is deleted at the end of each."""
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true" if free else before)
    try:
        yield
    finally:
        spark.conf.set(_FREED, before)


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage is cut and lost executors cost nothing.

    ``free``: what was shuffled for it is deleted once it is written, so that steps of a long job do not add up on disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with freed(spark, free):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a ``written`` table that nothing reads any more."""
    remove(table.sparkSession, table._written)


def written_in_turn(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of ``parts``, of which there is one at least, written one after the other; what was shuffled for one is deleted before the next is made."""
    path = new_path(spark, name)
    with freed(spark):
        for part in parts:
            schema = part.schema
            part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
