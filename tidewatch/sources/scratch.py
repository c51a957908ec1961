"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the stage tables that a session has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local-mode session without it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/tidewatch/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """``df`` written to the shared scratch folder and read again; a table that ``cut`` has just made is returned as it is.

    What several later steps read is computed once, plans stay small, and a lost executor
    costs a re-read, not the chain before it.
    """
    if getattr(df, "_stage_path", None):
        return df
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def sweep(spark: SparkSession) -> int:
    """Delete all stage tables that this session has written, once nothing reads them any more; how many there were."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
