"""Exact running counts and ranks without a window over all rows.

Rows are first summed by value; values are dealt to ranges by approximate cut points,
which decide only who works where; a range's running sums start from the sums of the
ranges before it.  No task holds more than a range of the distinct values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut


def running(df: DataFrame, groups: Sequence[str], value: str, sums: dict[str, str], ranges: int = 64, descending: bool = False) -> DataFrame:
    """(groups, value, each sum, each ``<sum>_upto``): sums of the rows up to and with each distinct value.

    ``sums``: name to SQL expression.  Null values are left out.  ``descending`` runs
    from the greatest value down.
    """
    groups = list(groups)
    by_value = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*[F.sum(F.expr(e)).alias(k) for k, e in sums.items()])
    cuts = by_value.groupBy(*groups).agg(F.percentile_approx(value, [k / ranges for k in range(1, ranges)], 2000).alias("__cuts"))
    joined = by_value.join(cuts, groups) if groups else by_value.crossJoin(F.broadcast(cuts))
    # Written: cut points drawn a second time are others, and then offsets are of other ranges than the rows.
    ranged = cut(joined.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts"), "ranged")
    order = (F.desc if descending else F.asc)
    whole = ranged.groupBy(*groups, "__range").agg(*[F.sum(k).alias(f"__{k}") for k in sums])
    before = Window.partitionBy(*groups).orderBy(order("__range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select(*groups, "__range", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inside = Window.partitionBy(*groups, "__range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.select(*groups, "__range", value, *sums, *[F.sum(k).over(inside).alias(f"__i_{k}") for k in sums])
    out = upto.join(offsets, [*groups, "__range"])
    return out.select(*groups, value, *sums, *[(F.col(f"__i_{k}") + F.col(f"__b_{k}")).alias(f"{k}_upto") for k in sums])


def quantiles(df: DataFrame, groups: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """(groups, q0, q1, ...): exact quantiles with linear interpolation, from running counts; no group's values in one buffer."""
    groups = list(groups)
    at = running(df, groups, value, {"__n": "1"})
    total = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count("*").alias("__all"))
    joined = at.join(total, groups) if groups else at.crossJoin(F.broadcast(total))
    place = lambda p: (F.col("__all") - 1) * F.lit(float(p))
    edges = [F.min(F.when(F.col("__n_upto") > f(place(p)), F.col(value))).alias(f"{n}{i}") for i, p in enumerate(points) for n, f in (("__low", F.floor), ("__high", F.ceil))]
    got = joined.groupBy(*groups).agg(F.first("__all").alias("__all"), *edges)
    part = lambda p: place(p) - F.floor(place(p))
    return got.select(*groups, *[((1 - part(p)) * F.col(f"__low{i}") + part(p) * F.col(f"__high{i}")).alias(f"q{i}") for i, p in enumerate(points)])


def rank_by_hash(df: DataFrame, groups: Sequence[str], digest: str, ties: Sequence[str], name: str) -> DataFrame:
    """With ``name``: the row's number from 1 in its group in the order of a hex digest column.

    The first two digits deal rows to 256 ranges, so that a group is never one task.
    """
    groups = list(groups)
    dealt = df.withColumn("__range", F.substring(digest, 1, 2))
    sizes = dealt.groupBy(*groups, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(digest, *ties))
    return dealt.withColumn("__in", place).join(offsets, [*groups, "__range"]).withColumn(name, (F.col("__in") + F.col("__before")).cast("int")).drop("__in", "__before", "__range")


def in_ranges(df: DataFrame, order: Sequence[str], ranges: int = 64) -> DataFrame:
    """``df`` written with ``__range``: rows of a lesser range come first in ``order``.

    Ranges are of all columns of the order together, so a value that most rows share is
    many ranges as long as its ties differ.  They are drawn from a sample, which decides
    only who works where, and are kept, since another draw would deal rows anew.
    """
    return cut(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def row_rank(df: DataFrame, value: str, ties: Sequence[str], name: str, ranges: int = 64) -> DataFrame:
    """With ``name``: the row's number from 1 among all rows by value and then ``ties``; rows without a value are left out."""
    dealt = in_ranges(df.where(F.col(value).isNotNull()), [value, *ties], ranges)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))  # a row for each range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(value, *ties))
    joined = dealt.withColumn("__in", place).join(F.broadcast(sizes.select("__range", before.alias("__before"))), "__range")
    return joined.withColumn(name, (F.col("__in") + F.col("__before")).cast("long")).drop("__in", "__before", "__range")
