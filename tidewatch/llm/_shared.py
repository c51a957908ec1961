"""Helpers that several operators share: shared-folder tables, skew-safe joins, tokens."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``, or the checkpoint folder set on the
    context.  Only a local-mode session without either gets a folder of its own; on a
    cluster a machine-local folder would lose data, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Workspace:
    """Tables in the shared folder that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidewatch/{tag}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        """Delete all tables, once nothing reads them any more."""
        self.drop("")


def salted_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = 16) -> DataFrame:
    """``left`` left-joined to ``right``, unique on ``keys``, with every key dealt to ``salts`` tasks.

    ``spread``: columns of ``left`` whose hash picks the salt.  ``right`` is repeated
    ``salts`` times, so pre-aggregate it.  No key, however frequent, stays in one task.
    The copies are never broadcast: their size isn't known.
    """
    salt = "__salt"
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge"), [*keys, salt], "left").drop(salt)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Sequence[str], most: int = 20_000) -> DataFrame:
    """Left join to a parameter table: broadcast while it has at most ``most`` rows, else salted."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), [*keys], "left")
    return salted_left_join(left, right, keys, spread)


def held_out(doc_id: Column, folds: int) -> Column:
    """True where crc32 of the id's decimal text is a multiple of ``folds`` (null id: crc32 of '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def texts_by_bytes(batches: Iterable[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``most`` bytes of column ``text``, or of one longer row."""
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(text)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield b.slice(at, stop - at)
            at = stop
