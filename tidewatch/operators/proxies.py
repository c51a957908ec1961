"""Late-life proxy labels: onset policies over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import POLICIES, Roles


def eligible(roles: Roles = Roles()) -> Column:
    """A window that ends in the healthy share of its entity's life."""
    return F.col("end_cycle") <= F.floor(F.col("max_cycle").cast("double") * F.lit(float(roles.healthy)))


def policy_table(spark: SparkSession, policies=POLICIES) -> DataFrame:
    """(policy_id, onset_fraction, policy_semantics, selection_policy, policy_rank): a few rows."""
    return spark.createDataFrame([(*p, k) for k, p in enumerate(policies)], "policy_id string, onset_fraction double, policy_semantics string, selection_policy boolean, policy_rank int")


def onset(max_cycle: Column, fraction: Column) -> Column:
    """First cycle after onset: floor(max_cycle * (1 - fraction)) + 1, in doubles."""
    return (F.floor(max_cycle.cast("double") * (F.lit(1.0) - fraction)) + 1).cast("int")


def label_state() -> Column:
    """healthy before onset; after it anomalous, or, for full windows that onset cuts, ambiguous."""
    cut = (F.col("policy_semantics") == "full_window") & (F.col("start_cycle") < F.col("onset_cycle"))
    return F.when(F.col("end_cycle") < F.col("onset_cycle"), "healthy").when(cut, "ambiguous").otherwise("anomalous")


def apply_policies(windows: DataFrame, policies: DataFrame) -> DataFrame:
    """Windows by policies with onset_cycle, label_state and proxy_label (null where ambiguous)."""
    both = windows.crossJoin(F.broadcast(policies))
    both = both.withColumn("onset_cycle", onset(F.col("max_cycle"), F.col("onset_fraction"))).withColumn("label_state", label_state())
    label = F.when(F.col("label_state") == "anomalous", 1).when(F.col("label_state") == "healthy", 0)
    return both.withColumn("proxy_label", label)


def policy_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("policy_id").agg(*[F.count_if(F.col("label_state") == s).alias(f"{s}_windows") for s in ("healthy", "ambiguous", "anomalous")])
