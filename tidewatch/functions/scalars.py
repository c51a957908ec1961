"""Scalar column functions: ids, digests, predicates and vector reductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_id(split: Column, entity: Column, start: Column, end: Column) -> Column:
    """Zero-padded id of a window."""
    return F.format_string("%s:e%03d:c%04d-%04d", split, entity.cast("long"), start.cast("long"), end.cast("long"))


def event_id(entity: Column, number: Column) -> Column:
    return F.format_string("engine_%d_event_%03d", entity.cast("long"), number.cast("long"))


def policy_id(semantics: Column, fraction: Column) -> Column:
    """Id of an onset policy from its rounded percentage."""
    return F.concat(F.lit("normalized_life_last_"), F.round(fraction * 100).cast("int").cast("string"), F.lit("pct_"), semantics)


def undefined(x: Column) -> Column:
    """Null, NaN or infinite."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def is_digest(x: Column) -> Column:
    return x.rlike("^[0-9a-f]{64}$")


def mean_square(values: list[Column]) -> Column:
    return sum((v * v for v in values[1:]), values[0] * values[0]) / F.lit(float(len(values)))


def array_mean_square(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + v.cast("double") * v.cast("double")) / F.size(x)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0).cast("double"), lambda a, v: a + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def from_json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("double")
