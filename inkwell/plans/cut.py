"""Cutting a plan: the intermediate result becomes a table in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, an own one on a single machine (master
    local[...], as in tests); on a cluster that is an error, as executors share no local folder."""
    own = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def own_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder under this application's name; clear() removes it."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/inkwell-{app}/{kind}-{uuid.uuid4().hex}"
    _OWN.setdefault(app, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written once and read back: what uses it several times doesn't compute it again, lost
    executors cost no recomputation, and the planner knows its size."""
    spark = df.sparkSession
    path = own_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes what this application cut, and nothing of others; for the end of a job, when no result is still to be read."""
    for own in _OWN.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
