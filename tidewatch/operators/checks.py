"""Integrity predicates.  Each returns a table of violations (check, detail); none is good."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import undefined
from ..schema import Roles
from ..sources.scratch import cut


class Violation(ValueError):
    """A table breaks an integrity rule."""


def assert_empty(violations: DataFrame) -> None:
    """Raise Violation with the first few rows, if there are any."""
    rows = violations.limit(5).collect()
    if rows:
        raise Violation("; ".join(f"{r[0]}: {r[1]}" for r in rows))


def _found(df: DataFrame, check: str, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def required_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise Violation(f"missing columns: {', '.join(missing)}")


def _key(names: Sequence[str]) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in names])


def check_cycles(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Null keys, repeated keys and gaps between an entity's cycles."""
    required_columns(cycles, roles.keys)
    nulls = cycles.where(F.col(roles.entity).isNull() | F.col(roles.order).isNull())
    twice = cycles.groupBy(*roles.keys).count().where("count > 1")
    step = F.col(roles.order) - F.lag(roles.order).over(Window.partitionBy(roles.entity).orderBy(roles.order))
    gaps = cycles.select(*roles.keys, step.alias("step")).where("step > 1")
    return _all([_found(nulls, "null_key", _key(roles.keys)), _found(twice, "duplicate_key", _key(roles.keys)), _found(gaps, "gap", _key(roles.keys))])


def check_inference_input(cycles: DataFrame, roles: Roles = Roles(), sequence: str | None = None) -> DataFrame:
    """What scoring needs: exact columns, finite values, whole numbers as keys, a window for each entity.

    Tables have no order; where a ``sequence`` column says which row came first, cycles
    must ascend along it.
    """
    names = [*roles.keys, *roles.settings, *roles.sensors, *([sequence] if sequence else [])]
    required_columns(cycles, names)
    extra = [c for c in cycles.columns if c not in names]
    if extra:
        raise Violation(f"unknown columns: {', '.join(extra)}")
    bad = cycles.where(_any([undefined(F.col(c).cast("double")) for c in (*roles.settings, *roles.sensors)]))
    parts = [_found(bad, "not_finite", _key(roles.keys))]
    fraction = _any([F.col(k).cast("double") != F.floor(F.col(k).cast("double")) for k in roles.keys])
    parts.append(_found(cycles.where(fraction), "not_integral", _key(roles.keys)))
    short = cycles.groupBy(roles.entity).count().where(F.col("count") < roles.window)
    parts.append(_found(short, "too_short", F.col(roles.entity)))
    if sequence:
        back = F.col(roles.order) <= F.lag(roles.order).over(Window.partitionBy(roles.entity).orderBy(sequence))
        parts.append(_found(cycles.withColumn("__b", back).where("__b"), "not_sorted", _key(roles.keys)))
    return _all(parts)


def check_physical_order(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(check, detail): rows of a file scan that don't ascend by ``keys``, of numbers, within their file, as they lie there.

    A task reads the rows of its block of a file in their order, and tells the first and
    last key and what doesn't ascend in between; blocks are then held against the one
    before them, so a step back across two blocks is found too.  Null keys come first.
    Detail: the file's name and the key of the row that is out of order.
    """
    names = list(keys)
    scan = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), *[F.col(k).cast("double").alias(f"k{i}") for i, k in enumerate(names)])
    cols = [f"k{i}" for i in range(len(names))]

    def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows of ``b`` stand after those of ``a``: greater at the first key that differs."""
        out, open_ = np.zeros(len(a), bool), np.ones(len(a), bool)
        for x, y in zip(a.T, b.T, strict=True):
            out |= open_ & (y > x)
            open_ &= x == y
        return out

    def run(batches):
        held, last = None, None
        for f in batches:
            place = list(zip(f["file"], f["block"], strict=True))
            x = np.where(np.isnan(v := f[cols].to_numpy(float)), -np.inf, v)
            edges = [0, *(i for i in range(1, len(f)) if place[i] != place[i - 1]), len(f)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                rows = x[lo:hi]
                if place[lo] != held:
                    if held is not None:
                        yield row(held, 1, last)
                    yield row(place[lo], 0, rows[0])
                    held = place[lo]
                else:
                    rows = np.concatenate((last[None], rows))
                back = np.flatnonzero(~after(rows[:-1], rows[1:])) + 1
                for i in back.tolist():
                    yield row(held, 2, rows[i])
                last = rows[-1]
        if held is not None:
            yield row(held, 1, last)

    def row(place, what, key):
        return pd.DataFrame([(place[0], int(place[1]), what, key.tolist())], columns=["file", "block", "what", "key"])

    seen = cut(scan.mapInPandas(run, "file string, block long, what int, key array<double>"), "blocks")
    ends = seen.where("what < 2").groupBy("file", "block").agg(F.max(F.when(F.col("what") == 0, F.col("key"))).alias("first"), F.max(F.when(F.col("what") == 1, F.col("key"))).alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.partitionBy("file").orderBy("block"))).where(F.col("first") <= F.col("before"))
    wrong = seen.where("what = 2").select("file", "key").unionByName(across.select("file", F.col("first").alias("key")))
    shown = F.concat_ws(":", F.element_at(F.split("file", "/"), -1), F.array_join(F.transform("key", lambda v: F.when(v == float("-inf"), "null").when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))), ":"))
    return wrong.select(F.lit("not_ascending").alias("check"), shown.alias("detail"))


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def check_preprocessing_input(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Null settings or sensors, counted by column in one pass, and repeated keys."""
    cols = [*roles.settings, *roles.sensors]
    required_columns(cycles, [*roles.keys, *cols])
    counts = cycles.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).unpivot([], cols, "name", "n")
    twice = cycles.groupBy(*roles.keys).count().where("count > 1")
    return _all([_found(counts.where("n > 0"), "null_values", F.concat_ws("=", "name", F.col("n").cast("string"))), _found(twice, "duplicate_key", _key(roles.keys))])


def check_assignments(assignments: DataFrame, expected: DataFrame, known: Sequence[str] = ("train", "validation", "test"), roles: Roles = Roles()) -> DataFrame:
    """Each expected entity in one known split, and no other entity."""
    e = roles.entity
    per = assignments.groupBy(e).agg(F.count("*").alias("n"), F.count_distinct(roles.split).alias("splits"))
    both = expected.select(e).distinct().withColumn("__x", F.lit(1)).join(per, e, "full_outer")
    return _all([
        _found(both.where("n is null"), "missing", F.col(e)),
        _found(both.where("__x is null"), "unknown_entity", F.col(e)),
        _found(both.where("n > 1"), "assigned_twice", F.col(e)),
        _found(assignments.where(~F.col(roles.split).isin(*known) | F.col(roles.split).isNull()), "unknown_split", F.col(e)),
    ])


def check_split_membership(df: DataFrame, assignments: DataFrame, split: str, roles: Roles = Roles()) -> DataFrame:
    """Entities of ``df`` and of a split must be the same, and no entity in two splits."""
    here, there = df.select(roles.entity).distinct(), assignments.where(F.col(roles.split) == split).select(roles.entity).distinct()
    other = assignments.where(F.col(roles.split) != split).select(roles.entity).distinct()
    return _all([_found(here.subtract(there), "not_in_split", F.col(roles.entity)), _found(there.subtract(here), "not_in_table", F.col(roles.entity)), _found(there.intersect(other), "in_two_splits", F.col(roles.entity))])


def check_window_metadata(windows: DataFrame, cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Window counts, unique ids, spans and last cycles against the cycles they come from."""
    e, w = roles.entity, roles.window
    want = cycles.groupBy(e).agg(F.greatest(F.count("*") - (w - 1), F.lit(0)).alias("want"), F.max(roles.order).alias("last"))
    got = windows.groupBy(e).agg(F.count("*").alias("got"), F.max("max_cycle").alias("max_cycle"), F.min("max_cycle").alias("min_max"))
    both = want.join(got, e, "full_outer")
    return _all([
        _found(both.where("coalesce(want, -1) <> coalesce(got, 0)"), "window_count", F.col(e)),
        _found(both.where("got > 0 and (max_cycle <> last or min_max <> last)"), "max_cycle", F.col(e)),
        _found(windows.groupBy("window_id").count().where("count > 1"), "duplicate_id", F.col("window_id")),
        _found(windows.where(F.col("end_cycle") - F.col("start_cycle") != w - 1), "span", F.col("window_id")),
        _found(windows.where("label_state <> 'unlabeled' or label_state is null"), "labelled", F.col("window_id")),
    ])


def check_modes(cycles: DataFrame, modes: int, roles: Roles = Roles()) -> DataFrame:
    """Modes are whole numbers from 0 to modes - 1; keys are unique."""
    as_number = F.expr(f"try_cast(`{roles.mode}` as double)")
    bad = cycles.where(as_number.isNull() | F.isnan(as_number) | (as_number != F.floor(as_number)) | ~as_number.between(0, modes - 1))
    twice = cycles.groupBy(*roles.keys).count().where("count > 1")
    return _all([_found(bad, "mode", _key(roles.keys)), _found(twice, "duplicate_key", _key(roles.keys))])


def mode_coverage(windows: DataFrame, modes: int, roles: Roles = Roles()) -> DataFrame:
    """(op_mode, train_windows, validation_windows, eligible_windows) for each mode, zeros kept."""
    spark = windows.sparkSession
    eligible = (F.col(roles.split) == "train") & (F.col("end_cycle") <= F.floor(F.col("max_cycle") * F.lit(roles.healthy)))
    counts = windows.groupBy(roles.mode).agg(F.count_if(F.col(roles.split) == "train").alias("train_windows"), F.count_if(F.col(roles.split) == "validation").alias("validation_windows"), F.count_if(eligible).alias("eligible_windows"))
    every = spark.range(modes).select(F.col("id").cast("int").alias(roles.mode))
    return every.join(counts, roles.mode, "left").fillna(0, ["train_windows", "validation_windows", "eligible_windows"])


def check_mode_coverage(windows: DataFrame, modes: int, least: int = 100, roles: Roles = Roles()) -> DataFrame:
    """Every mode in both splits, with at least ``least`` eligible training windows."""
    c = mode_coverage(windows, modes, roles)
    return _all([_found(c.where("train_windows = 0 or validation_windows = 0"), "mode_absent", F.col(roles.mode)), _found(c.where(F.col("eligible_windows") < least), "too_few_eligible", F.col(roles.mode))])


def check_scores(scores: DataFrame, score: str = "alert_score", key: Sequence[str] = ("detector_id", "window_id")) -> DataFrame:
    """Calibrated scores are finite and from 0 to 1; a key has one."""
    bad = scores.where(undefined(F.col(score)) | ~F.col(score).between(0.0, 1.0))
    return _all([_found(bad, "score", _key(key)), _found(scores.groupBy(*key).count().where("count > 1"), "duplicate_key", _key(key))])


def check_sequences(sequences: DataFrame, steps: int, width: int, column: str = "sequence") -> DataFrame:
    """Every sequence has ``steps`` rows of ``width`` finite numbers."""
    shape = (F.size(column) == steps) & F.forall(column, lambda r: F.size(r) == width)
    finite = F.forall(column, lambda r: F.forall(r, lambda x: ~undefined(x)))
    return _all([_found(sequences.where(~shape | F.col(column).isNull()), "shape", F.col("window_id")), _found(sequences.where(shape & ~finite), "not_finite", F.col("window_id"))])


def guard_splits(df: DataFrame, allowed: Sequence[str] = ("train",), roles: Roles = Roles()) -> DataFrame:
    """Rows of splits that must not enter a fit."""
    return _found(df.where(~F.coalesce(F.col(roles.split).isin(*allowed), F.lit(False))), "split_not_allowed", F.coalesce(F.col(roles.split), F.lit("null")))


def check_training_partition(df: DataFrame, assignments: DataFrame, rows: int | None = None, roles: Roles = Roles()) -> DataFrame:
    """A training partition: cycles in order, its split's entities alone, finite values, row count."""
    bad = df.where(_any([undefined(F.col(c).cast("double")) for c in roles.sensors]))
    parts = [check_cycles(df, roles), check_split_membership(df, assignments, "train", roles), _found(bad, "not_finite", _key(roles.keys))]
    if rows is not None:
        parts.append(_found(df.agg(F.count("*").alias("n")).where(F.col("n") != rows), "row_count", F.col("n")))
    return _all(parts)
