"""Thresholds of alert scores and the alert-candidate grid."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.order import running
from ..schema import DETECTOR_SETS, RULES, Grid, Rule, Roles
from .checks import assert_empty, guard_splits


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame([(k, r.rule_id, r.kind, r.value) for k, r in enumerate(rules)], "rule_rank int, rule_id string, kind string, value double")


def higher_quantiles(scores: DataFrame, groups: Sequence[str], quantiles: DataFrame, score: str = "alert_score") -> DataFrame:
    """(groups, rule_id, threshold, reference_count): the order statistic at ceil((n - 1) q), from a histogram of values."""
    groups = list(groups)
    at = running(scores, groups, score, {"__n": "1"})
    total = scores.where(F.col(score).isNotNull()).groupBy(*groups).agg(F.count("*").alias("reference_count"))
    place = F.ceil((F.col("reference_count") - 1).cast("double") * F.col("value"))
    joined = (at.join(total, groups) if groups else at.crossJoin(F.broadcast(total))).crossJoin(F.broadcast(quantiles))
    return joined.where(F.col("__n_upto") > place).groupBy(*groups, "rule_id").agg(F.min(score).alias("threshold"), F.first("reference_count").alias("reference_count"))


def fit_thresholds(scores: DataFrame, rules: Sequence[Rule] = RULES, contexts: Sequence[str] = ("global", "per_mode"), modes: Sequence[int] | None = None, least: int = 1, roles: Roles = Roles(), guard: bool = True) -> DataFrame:
    """(detector_id, context, rule_id, op_mode, threshold, reference_count) from training scores alone.

    A global threshold has a null mode.  With ``guard``, rows of other splits are an
    error.  ``modes`` that have fewer than ``least`` scores are an error too.
    """
    if guard:
        assert_empty(guard_splits(scores, ("train",), roles))
    table = rule_table(scores.sparkSession, rules)
    parts = []
    for context in contexts:
        groups = ["detector_id"] + ([roles.mode] if context == "per_mode" else [])
        if context == "per_mode" and modes is not None:
            few = scores.groupBy(*groups).count().where(F.col("count") >= least).groupBy("detector_id").agg(F.collect_set(roles.mode).alias("m"))
            wanted = F.array(*[F.lit(m) for m in modes])
            missing = few.where(F.size(F.array_except(wanted, "m")) > 0)
            assert_empty(missing.select(F.lit("mode_without_reference"), F.array_join(F.array_except(wanted, "m"), ",")))
        q = higher_quantiles(scores, groups, table.where("kind = 'quantile'").select("rule_id", "value"))
        stats = scores.groupBy(*groups).agg(F.avg("alert_score").alias("__m"), F.stddev_pop("alert_score").alias("__s"), F.count("*").alias("reference_count"))
        m = stats.crossJoin(F.broadcast(table.where("kind = 'mean_plus_std'").select("rule_id", "value"))).select(*groups, "rule_id", (F.col("__m") + F.col("value") * F.col("__s")).alias("threshold"), "reference_count")
        both = q.select(*groups, "rule_id", "threshold", "reference_count").unionByName(m)
        mode = F.col(roles.mode).cast("int") if context == "per_mode" else F.lit(None).cast("int")
        parts.append(both.select("detector_id", F.lit(context).alias("context"), "rule_id", mode.alias(roles.mode), "threshold", F.col("reference_count").cast("long").alias("reference_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def threshold_lookup(scores: DataFrame, thresholds: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Scores with every (context, rule_id, threshold) of their detector: two equi joins and a union.

    A per-mode context without the row's mode gives a null threshold, which callers
    treat as an error.  Thresholds are few: detectors, contexts, rules and modes.
    """
    whole = thresholds.where("context = 'global'").drop(roles.mode, "reference_count")
    per = thresholds.where("context = 'per_mode'")
    pairs = per.select("detector_id", "context", "rule_id").distinct()
    by_mode = scores.join(F.broadcast(pairs), "detector_id").join(F.broadcast(per.drop("reference_count")), ["detector_id", "context", "rule_id", roles.mode], "left")
    return scores.join(F.broadcast(whole), "detector_id").unionByName(by_mode)


def candidate_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """(candidate_id, candidate_rank, detector_id, context, rule_id, ewma_id, ewma_alpha, persistence) in grid order.

    The axes are parameters, so their product is made here and becomes one local table
    of known size in one partition: no plan multiplies partitions over it.
    """
    rules = [r.rule_id for r in grid.rules]
    axes = list(itertools.product(grid.detectors, grid.contexts, rules, grid.ewma, grid.persistence))
    smooth = ["off" if a is None else f"alpha_{a:.2f}" for *_, a, _ in axes]
    ids = [f"{d}__{c}__{r}__ewma_{e}__persistence_{m}" for (d, c, r, _, m), e in zip(axes, smooth, strict=True)]
    column = lambda i, kind: pa.array([x[i] for x in axes], kind)
    table = pa.table(
        {
            "candidate_id": pa.array(ids, pa.string()),
            "candidate_rank": pa.array(range(len(axes)), pa.int32()),
            "detector_id": column(0, pa.string()),
            "context": column(1, pa.string()),
            "rule_id": column(2, pa.string()),
            "ewma_id": pa.array(smooth, pa.string()),
            "ewma_alpha": column(3, pa.float64()),
            "persistence": column(4, pa.int32()),
        }
    )
    return spark.createDataFrame(table)


def detector_grid(spark: SparkSession) -> DataFrame:
    """(detector_id, parameter_set, params map): the registered sets, which a detector study runs."""
    rows = [(d, f"{d}_{k}", p) for d, sets in DETECTOR_SETS.items() for k, p in enumerate(sets)]
    return spark.createDataFrame(rows, "detector_id string, parameter_set string, params map<string,double>")
