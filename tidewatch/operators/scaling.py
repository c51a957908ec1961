"""Scalers: global, of settings and per mode; population statistics over healthy training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Roles

EPS = 1e-12


def healthy_mask(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """``cycles`` with ``max_cycle`` of the entity and ``healthy``: cycle <= floor(max_cycle * fraction), in doubles."""
    last = F.max(roles.order).over(Window.partitionBy(roles.entity))
    out = cycles.withColumn("max_cycle", last)
    return out.withColumn("healthy", F.col(roles.order) <= F.floor(F.col("max_cycle").cast("double") * F.lit(float(roles.healthy))))


def _stats(cols: Sequence[str]) -> list[Column]:
    scale = lambda c: F.when(F.stddev_pop(c) > EPS, F.stddev_pop(c)).otherwise(F.lit(1.0))
    return [x for c in cols for x in (F.avg(c).alias(f"mean_{c}"), scale(c).alias(f"scale_{c}"))]


def fit_global_scaler(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column (1 where it doesn't vary), and fit_rows."""
    return rows.agg(F.count("*").alias("fit_rows"), *_stats(cols))


def fit_mode_scalers(rows: DataFrame, cols: Sequence[str], modes: int, least: int = 30, roles: Roles = Roles()) -> DataFrame:
    """A row for each mode; modes with fewer than ``least`` rows have the global parameters (``fallback``)."""
    every = rows.sparkSession.range(modes).select(F.col("id").cast("int").alias(roles.mode))
    own = rows.groupBy(roles.mode).agg(F.count("*").alias("fit_rows"), *_stats(cols))
    whole = fit_global_scaler(rows, cols).drop("fit_rows")
    whole = whole.select(*[F.col(c).alias(f"g_{c}") for c in whole.columns])
    few = F.coalesce(F.col("fit_rows"), F.lit(0)) < least
    joined = every.join(own, roles.mode, "left").crossJoin(F.broadcast(whole))
    names = [f"{k}_{c}" for c in cols for k in ("mean", "scale")]
    return joined.select(roles.mode, F.coalesce("fit_rows", F.lit(0)).alias("fit_rows"), few.alias("fallback"), *[F.when(few, F.col(f"g_{n}")).otherwise(F.col(n)).alias(n) for n in names])


def _scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    params = {f"{k}_{c}" for c in cols for k in ("mean", "scale")} | {"fit_rows", "fallback"}
    return df.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}") for c in cols}).drop(*params)


def transform_global(cycles: DataFrame, scaler: DataFrame, cols: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Columns scaled by one row of parameters; the mode becomes -1."""
    return _scaled(cycles.crossJoin(F.broadcast(scaler)), cols).withColumn(roles.mode, F.lit(-1))


def transform_modes(cycles: DataFrame, scalers: DataFrame, cols: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Columns scaled by the parameters of the row's mode (a row for each mode, so broadcast)."""
    return _scaled(cycles.join(F.broadcast(scalers), roles.mode), cols)


def fit_metadata(rows: DataFrame, scalers: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """One row about a fit: rows, healthy rows, rows by mode, fallback modes and a digest of the entities."""
    from .compare import id_digest

    ids = id_digest(rows, roles.entity).select(F.col("digest").alias("entity_digest"))
    head = rows.agg(F.count("*").alias("fit_rows"), F.count_if("healthy").alias("healthy_rows")).crossJoin(F.broadcast(ids))
    per = scalers.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(roles.mode).cast("string"), "fit_rows"))))).alias("rows_by_mode"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("fallback"), F.col(roles.mode).cast("string")))), ",").alias("fallback_modes"))
    return head.crossJoin(F.broadcast(per))
