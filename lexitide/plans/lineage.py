"""Cutting lineage safely: tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

#: Tables that this process has cut, by application.
_cuts: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """URI of the checkpoint folder of this session.

    ``spark.checkpoint.dir`` is honoured where the cluster names it. Only where it is unset and all runs in one process, as
    in tests, is a temporary folder made; a cluster without a shared folder is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexitide-checkpoint-"))
    return jsc.getCheckpointDir().get()


def one_process(master: str) -> bool:
    """Whether executors run in the driver's process."""
    return master == "local" or master.startswith("local[")


def _place(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of ``path``, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _place(spark, path)
    return files.exists(at)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no recomputation.

    It is a table rather than a checkpoint: the planner then knows its size, so a small one is joined without a shuffle. Tables
    go when the application ends, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    _cuts.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes all tables that were cut so far and gives their number; for when a query's result has been written."""
    paths = _cuts.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files, at = _place(spark, path)
        files.delete(at, True)
    return len(paths)


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The parquet table at ``path``; where there is none, or one whose writing was broken off, it is built and written first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
