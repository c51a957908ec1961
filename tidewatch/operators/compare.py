"""Comparison and fingerprints of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_frames(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str] = (), close: Sequence[str] = (), rtol: float = 1e-7, atol: float = 1e-9) -> DataFrame:
    """(column, rows, only_left, only_right, mismatches, max_abs_difference) for each compared column.

    Numbers are close if abs(l - r) <= atol + rtol * abs(r); two nulls are equal.
    """
    cols = [*exact, *close]
    a = left.select(*keys, *[F.col(c).alias(f"l_{c}") for c in cols]).withColumn("__l", F.lit(1))
    b = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in cols]).withColumn("__r", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    here = F.col("__l").isNotNull() & F.col("__r").isNotNull()

    def good(c: str) -> Column:
        l, r = F.col(f"l_{c}"), F.col(f"r_{c}")
        return l.eqNullSafe(r) if c in exact else F.coalesce(F.abs(l - r) <= atol + rtol * F.abs(r), l.isNull() & r.isNull())

    one = [F.struct(F.lit(c).alias("column"), F.count_if(here & ~good(c)).alias("mismatches"), (F.max(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}"))).cast("double") if c in close else F.lit(None).cast("double")).alias("max_abs_difference")) for c in cols]
    out = both.agg(F.count("*").alias("rows"), F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right"), F.array(*one).alias("c"))
    return out.select("rows", "only_left", "only_right", F.inline("c"))


def _sums(h: Column) -> Column:
    """A digest of a column of SHA-256 hex digests that no order of rows changes: of their count and the sums of their eight words."""
    half = lambda a: F.conv(F.substring(h, a, 8), 16, 10).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(half(1 + 8 * k)), F.lit(0)).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums), 256)


def frame_fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest): a digest of a table that no order of rows changes."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    return df.select(row.alias("h")).agg(F.count("*").alias("rows"), _sums(F.col("h")).alias("digest"))


def id_digest(df: DataFrame, column: str) -> DataFrame:
    """One row (ids, digest) of the distinct ids: sums with map-side combine, no list of all ids."""
    ids = df.where(F.col(column).isNotNull()).select(F.sha2(F.col(column).cast("string"), 256).alias("h")).distinct()
    return ids.agg(F.count("*").alias("ids"), _sums(F.col("h")).alias("digest"))
