"""Cutting lineage through the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, on one machine only (tests), a temporary one. On a cluster it must be
    set: executors would each write to a folder of their own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="arcloom-")
    return _own[app]


def written(df: DataFrame, partitions: int | None = None) -> str:
    """Write ``df`` as a Parquet table in the shared folder; returns its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    The written files survive a lost executor, so nothing upstream is computed a second time. They are deleted when the driver ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, partitions))
