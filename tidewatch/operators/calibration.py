"""Calibration against a training reference: empirical distribution functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import running


def ecdf(reference: DataFrame, queries: DataFrame, score: str = "raw_score", groups: Sequence[str] = ("detector_id",), out: str = "alert_score") -> DataFrame:
    """``queries`` with ``out``: the share of the group's reference scores that are at most the score.

    Distinct scores of both sides are counted once, ranked exactly without a window over
    all rows, and joined back by value.  Groups without a reference get null.
    """
    groups = list(groups)
    both = reference.select(*groups, score, F.lit(1).alias("__r")).unionByName(queries.select(*groups, score, F.lit(0).alias("__r")))
    at = running(both, groups, score, {"__n": "__r"})
    total = reference.groupBy(*groups).agg(F.count("*").alias("__all"))
    share = (at.join(total, groups, "left") if groups else at.crossJoin(F.broadcast(total))).select(*groups, score, (F.col("__n_upto") / F.col("__all")).alias(out))
    return queries.join(share, [*groups, score], "left")
