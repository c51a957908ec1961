"""Entity summaries, life strata and leakage-free splits by whole entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import rank_by_hash, row_rank
from ..schema import Roles
from ..sources.scratch import cut


def summarize_entities(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(entity, cycle_count, max_cycle)."""
    return cycles.groupBy(roles.entity).agg(F.count("*").alias("cycle_count"), F.max(roles.order).alias("max_cycle"))


def life_strata(summary: DataFrame, k: int = 5, roles: Roles = Roles()) -> DataFrame:
    """``summary`` with ``stratum``: equal-frequency bins of the rank by last cycle (ties by entity).

    Bins are those of linear quantile edges over the ranks, closed on the right.
    """
    summary = cut(summary, "summary")
    ranked = row_rank(summary, "max_cycle", [roles.entity], "__r")
    total = summary.agg(F.count("*").alias("__t"))
    bin_ = F.greatest(F.ceil((F.col("__r") - 1) * k / F.greatest(F.col("__t") - 1, F.lit(1))) - 1, F.lit(0)).cast("int")
    return ranked.crossJoin(F.broadcast(total)).withColumn("stratum", bin_).drop("__r", "__t")


def _quota(n: Column, ratios: list[float]) -> list[Column]:
    """Largest-remainder quotas of ``n`` rows for each ratio; ties go to the earlier ratio."""
    exact = [F.round(n * r, 9) for r in ratios]
    whole = [F.floor(x) for x in exact]
    rest = [x - w for x, w in zip(exact, whole, strict=True)]
    left = n - sum(whole[1:], whole[0])
    out = []
    for i, r in enumerate(rest):
        ahead = sum(((o >= r) if j < i else (o > r)).cast("int") for j, o in enumerate(rest) if j != i)
        out.append((whole[i] + (F.lit(ahead) < left).cast("int") if isinstance(ahead, int) else whole[i] + (ahead < left).cast("int")).cast("int"))
    return out


def stratified_split(summary: DataFrame, names: tuple[str, ...] = ("train", "validation", "test"), ratios: tuple[float, ...] = (0.6, 0.2, 0.2), seed: int = 42, k: int = 5, roles: Roles = Roles()) -> DataFrame:
    """``summary`` with ``stratum`` and ``split``: whole entities, dealt within strata in the order of a seeded digest."""
    strata = cut(life_strata(summary, k, roles), "strata").withColumn("__d", F.md5(F.concat(F.col(roles.entity).cast("string"), F.lit(f":{seed}"))))
    ranked = rank_by_hash(strata, ["stratum"], "__d", [roles.entity], "__i")
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("__n"))
    quotas = sizes.select("stratum", *[q.alias(f"__q{i}") for i, q in enumerate(_quota(F.col("__n"), list(ratios)))])
    joined = ranked.join(F.broadcast(quotas), "stratum")  # k rows
    edge, split = F.lit(0), None
    for i, name in enumerate(names):
        edge = edge + F.col(f"__q{i}")
        test = F.col("__i") <= edge
        split = F.when(test, name) if split is None else split.when(test, name)
    return joined.withColumn(roles.split, split).select(*summary.columns, "stratum", roles.split)


def monitor_split(windows: DataFrame, fraction: float = 0.2, seed: int = 43, k: int = 5, roles: Roles = Roles()) -> DataFrame:
    """Eligible windows with ``role``: development or monitor, by whole entity, stratified by life."""
    summary = windows.groupBy(roles.entity).agg(F.count("*").alias("cycle_count"), F.max("max_cycle").alias("max_cycle"))
    roles_of = stratified_split(summary, ("development", "monitor"), (1 - fraction, fraction), seed, k, roles)
    return windows.join(roles_of.select(roles.entity, F.col(roles.split).alias("role")), roles.entity)


def sample_rows(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """``n`` rows, those of the least MD5 of seed and key."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])), *key).limit(n)
