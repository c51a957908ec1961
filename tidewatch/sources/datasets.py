"""The given tables as entity time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_json_number

# Event types in the order of their modes.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as cycles: an engine for each user, a cycle for each event in time order."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce(F.timestamp_diff("MICROSECOND", F.lag("ts").over(w), F.col("ts")) / F.lit(1e6), F.lit(0.0))
    return ev.select(
        F.col("user_id").alias("engine"),
        F.row_number().over(w).alias("cycle"),
        (F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1).cast("int").alias("op_mode"),
        F.hour("ts").cast("double").alias("op1"),
        F.col("value").alias("s1"),
        from_json_number(F.col("props"), "$.k").alias("s2"),
        F.round(F.log(1 + gap), 6).alias("s3"),
    )


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their length as a score."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return docs.select("doc_id", F.col("n_chars").cast("double").alias("score")).join(labels, "doc_id")
