"""Profiles of sensors, settings and splits as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import quantiles
from ..functions.scalars import undefined
from ..schema import Roles


def unpivot(cycles: DataFrame, roles: Roles = Roles(), keep: Sequence[str] = ()) -> DataFrame:
    """Wide sensors to rows (keys, kept, sensor, value)."""
    return cycles.unpivot([*roles.keys, *keep], list(roles.sensors), "sensor", "value")


def sensor_quality(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(sensor, missing, not_finite, distinct_values, variance, constant, near_constant) in one pass."""
    long = unpivot(cycles, roles)
    out = long.groupBy("sensor").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count_if(F.col("value").isNotNull() & undefined(F.col("value"))).alias("not_finite"), F.count_distinct("value").alias("distinct_values"), F.var_pop("value").alias("variance"))
    return out.withColumns({"constant": F.col("distinct_values") <= 1, "near_constant": F.coalesce(F.col("variance") <= 1e-12, F.lit(True))})


def split_summary(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rows, entities and range of lives by split."""
    per = cycles.groupBy(roles.split, roles.entity).agg(F.count("*").alias("n"), F.max(roles.order).alias("m"))
    return per.groupBy(roles.split).agg(F.sum("n").alias("rows"), F.count("*").alias("engines"), F.min("m").alias("min_life"), F.percentile("m", F.lit(0.5)).alias("median_life"), F.max("m").alias("max_life"))


def range_coverage(cycles: DataFrame, cols: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Range, mean and sample deviation of each setting by split."""
    long = cycles.unpivot([roles.split], list(cols), "setting", "value")
    return long.groupBy(roles.split, "setting").agg(F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def correlations(cycles: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(sensor_a, sensor_b, correlation) for all pairs, in one pass."""
    pairs = [(a, b) for a in cols for b in cols]
    one = cycles.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("sensor_a"), F.lit(b).alias("sensor_b"), F.col(f"{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def histogram(cycles: DataFrame, bins: int = 20, by: Sequence[str] = (), roles: Roles = Roles()) -> DataFrame:
    """(by, sensor, bin, n) over equal bins of each sensor's range; the greatest value is in the last bin."""
    long = unpivot(cycles, roles, by).where("value is not null")
    span = long.groupBy("sensor").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    place = F.least(F.floor(F.coalesce(F.try_divide((F.col("value") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))) + 1, F.lit(bins))
    return long.join(F.broadcast(span), "sensor").groupBy(*by, "sensor", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def boxplot_stats(cycles: DataFrame, by: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Quartiles and range of each sensor by group."""
    long = unpivot(cycles, roles, by)
    ends = long.groupBy(*by, "sensor").agg(F.min("value").alias("least"), F.max("value").alias("greatest"))
    quarters = quantiles(long, [*by, "sensor"], "value", [0.25, 0.5, 0.75]).toDF(*by, "sensor", "q1", "median", "q3")
    return ends.join(quarters, [*by, "sensor"], "left")
