"""Sliding windows, their arrays and summary features, on one partitioning by entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import undefined, window_id
from ..schema import Roles
from .checks import _any


def _frame(roles: Roles):
    whole = Window.partitionBy(roles.entity).orderBy(roles.order)
    return whole, whole.rowsBetween(-(roles.window - 1), 0)


def window_metadata(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """A row for each window of consecutive cycles that ends at a cycle; short entities have none.

    Needs the columns of ``cycles`` and a split column; midpoints are at window // 2.
    """
    w = roles.window
    whole, _ = _frame(roles)
    at = lambda back: F.lag(roles.order, back).over(whole) if back else F.col(roles.order)
    rows = cycles.select("*", F.row_number().over(whole).alias("__n"), at(w - 1).alias("start_cycle"), F.col(roles.order).alias("end_cycle"), at(w - 1 - w // 2).alias("midpoint_cycle"), F.max(roles.order).over(Window.partitionBy(roles.entity)).alias("max_cycle")).where(F.col("__n") >= w)
    return rows.select(window_id(F.col(roles.split), F.col(roles.entity), F.col("start_cycle"), F.col("end_cycle")).alias("window_id"), roles.entity, roles.split, "start_cycle", "end_cycle", "midpoint_cycle", "max_cycle", (F.col("end_cycle").cast("double") / F.col("max_cycle")).alias("life_fraction"), F.lit("unlabeled").alias("label_state"))


def window_arrays(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(entity, end_cycle, sequence array of arrays): the window's rows in order; windows with a value that isn't finite are left out."""
    whole, frame = _frame(roles)
    bad = F.max(_any([undefined(F.col(s)) for s in roles.sensors]).cast("int")).over(frame)
    rows = cycles.select(roles.entity, F.col(roles.order).alias("end_cycle"), F.collect_list(F.array(*[F.col(s).cast("double") for s in roles.sensors])).over(frame).alias("sequence"), F.row_number().over(whole).alias("__n"), bad.alias("__bad"))
    return rows.where((F.col("__n") >= roles.window) & (F.col("__bad") == 0)).drop("__n", "__bad")


def summary_features(cycles: DataFrame, roles: Roles = Roles(), digits: int | None = 9) -> DataFrame:
    """Per window: mean, population deviation and last less first of each sensor, and the endpoint's mode.

    ``digits`` rounds the features, so that equal windows have equal features whatever
    the order of summation.
    """
    whole, frame = _frame(roles)
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    cols = []
    for s in roles.sensors:
        cols += [(f"mean_{s}", F.avg(s).over(frame)), (f"std_{s}", F.stddev_pop(s).over(frame)), (f"slope_{s}", F.col(s) - F.first(s).over(frame))]
    got = cycles.select(roles.entity, roles.split, roles.mode, F.col(roles.order).alias("end_cycle"), F.lag(roles.order, roles.window - 1).over(whole).alias("start_cycle"), F.max(roles.order).over(Window.partitionBy(roles.entity)).alias("max_cycle"), F.row_number().over(whole).alias("__n"), *[r(c).alias(n) for n, c in cols])
    got = got.where(F.col("__n") >= roles.window).drop("__n")
    return got.withColumn("window_id", window_id(F.col(roles.split), F.col(roles.entity), F.col("start_cycle"), F.col("end_cycle")))


def windows_to_cycles(windows: DataFrame, cycles: DataFrame, roles: Roles = Roles(), block: int = 64) -> DataFrame:
    """Each window with its cycles, by an equi join on entity and block of cycles, not by a range join."""
    left = windows.select("window_id", roles.entity, "start_cycle", "end_cycle", F.explode(F.sequence(F.floor(F.col("start_cycle") / block), F.floor(F.col("end_cycle") / block))).alias("__b"))
    right = cycles.withColumn("__b", F.floor(F.col(roles.order) / block))
    return left.join(right, [roles.entity, "__b"]).where(F.col(roles.order).between(F.col("start_cycle"), F.col("end_cycle"))).drop("__b")


def assign_endpoint_mode(windows: DataFrame, cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Windows with the mode of their last cycle; left join, one cycle for each window."""
    modes = cycles.select(F.col(roles.entity), F.col(roles.order).alias("end_cycle"), F.col(roles.mode).cast("int").alias(roles.mode))
    return windows.drop(roles.mode).join(modes, [roles.entity, "end_cycle"], "left")
