"""The alert state: smoothing, segments, persistence and events.

Rows of an entity are read in order as a stream with state of constant size, or by
window expressions; a segment ends at a gap between cycles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import event_id
from ..schema import Roles
from ..sources.scratch import cut
from .checks import Violation, assert_empty, check_scores


def segments(scores: DataFrame, keys: Sequence[str] = ("detector_id",), roles: Roles = Roles()) -> DataFrame:
    """With ``segment``: 0, 1, ... within the entity, one more after each gap between end cycles."""
    w = Window.partitionBy(*keys, roles.entity).orderBy("end_cycle")
    gap = (F.col("end_cycle") - F.lag("end_cycle").over(w) > 1).cast("int")
    return scores.withColumn("segment", F.sum(F.coalesce(gap, F.lit(0))).over(w).cast("int"))


def state_segment_id(with_segments: DataFrame, keys: Sequence[str] = ("detector_id",), roles: Roles = Roles()) -> DataFrame:
    """With ``state_segment_id`` over all entities in order, from 0: sums of segment counts, not a window over rows."""
    from ..functions.order import running

    per = with_segments.groupBy(*keys, roles.entity).agg((F.max("segment") + 1).alias("__s"))
    at = running(per, keys, roles.entity, {"__c": "__s"})
    first = at.select(*keys, roles.entity, (F.col("__c_upto") - F.col("__c")).alias("__first"))
    return with_segments.join(first, [*keys, roles.entity]).withColumn("state_segment_id", (F.col("__first") + F.col("segment")).cast("long")).drop("__first")


def smooth(x: np.ndarray, starts: np.ndarray, alphas: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """(rows, alphas): s = alpha x + (1 - alpha) s before, anew at every row that ``starts``.

    ``state``: what the first row follows, where it doesn't start.  Step by step within
    segments, all segments and alphas at a time.
    """
    at = np.flatnonzero(starts | (np.arange(len(x)) == 0))
    length = np.diff(np.append(at, len(x)))
    order = np.argsort(-length, kind="stable")
    first, length = at[order], length[order]
    out = np.empty((len(x), len(alphas)))
    now = np.repeat(x[first][:, None], len(alphas), axis=1)
    if state is not None and not starts[0]:
        now[first == 0] = alphas * x[0] + (1 - alphas) * state
    out[first] = now
    for t in range(1, int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, side="left"))
        rows = first[:live] + t
        now = alphas * x[rows][:, None] + (1 - alphas) * now[:live]
        out[rows] = now
    return out


def ewma(scores: DataFrame, alphas: Sequence[float | None], score: str = "alert_score", keys: Sequence[str] = ("detector_id",), roles: Roles = Roles()) -> DataFrame:
    """``scores`` by alphas with ewma_id, ewma_alpha and smoothed_score, s = alpha x + (1 - alpha) s before.

    s starts at the first score of an entity and again after a gap; a null alpha leaves
    scores as they are; after a null score s is null to the end of the segment.  One
    exchange by entity serves all alphas; each task reads its sorted rows as a stream,
    holding a batch and one smoothed value for each alpha, and adds one array to each row.
    """
    names = [*keys, roles.entity, "end_cycle"]
    rest = [c for c in scores.columns if c not in (*names, score)]
    out = scores.select(*names, score, *rest)
    factors = np.array([1.0 if x is None else x for x in alphas])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        mark = lambda b, i: tuple(b.column(c)[i].as_py() for c in range(len(names)))
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            same = np.diff(b.column(len(names) - 1).to_numpy(zero_copy_only=False)) == 1
            for c in range(len(names) - 1):
                same &= pc.fill_null(pc.equal(b.column(c).slice(1), b.column(c).slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            head = mark(b, 0)
            follows = last is not None and head[:-1] == last[:-1] and head[-1] == last[-1] + 1
            x = b.column(len(names)).to_numpy(zero_copy_only=False).astype(float)
            made = smooth(x, np.concatenate(([not follows], ~same)), factors, state)
            last, state = mark(b, n - 1), made[-1]
            flat = pa.array(made.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(factors), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "__s"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", __s array<double>"
    dealt = out.repartition(*keys, roles.entity).sortWithinPartitions(*names).mapInArrow(run, schema)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__k") + 1)
    every = dealt.select(*out.columns, F.posexplode("__s").alias("__k", "__v"))
    alpha = pick([None if a is None else float(a) for a in alphas]).cast("double")
    ids = pick(["off" if a is None else f"alpha_{a:.2f}" for a in alphas])
    every = every.withColumns({"ewma_id": ids, "ewma_alpha": alpha, "smoothed_score": F.when(alpha.isNull(), F.col(score)).otherwise(F.col("__v"))})
    return every.drop("__k", "__v")


def persistence(trace: DataFrame, keys: Sequence[str], m: Column, roles: Roles = Roles()) -> DataFrame:
    """With persistence_count and alert_active: violations in a row within the segment, and whether there are ``m``."""
    seg = Window.partitionBy(*keys, roles.entity, "segment").orderBy("end_cycle")
    island = F.sum((~F.col("threshold_violation")).cast("int")).over(seg)
    run = trace.withColumn("__i", island)
    place = F.sum(F.col("threshold_violation").cast("int")).over(Window.partitionBy(*keys, roles.entity, "segment", "__i").orderBy("end_cycle"))
    out = run.withColumn("persistence_count", place.cast("int")).drop("__i")
    return out.withColumn("alert_active", F.col("persistence_count") >= m)


def apply_policy(scores: DataFrame, thresholds: DataFrame, alpha: float | None, m: int, context: str, rule_id: str, roles: Roles = Roles()) -> DataFrame:
    """The alert trace of one policy: smoothing, strict violation, run length, activity and global segments.

    Violations look at the mode of the row for their threshold, and smoothing runs on
    over a change of mode.  Repeated windows, repeated end cycles of an entity and scores
    outside 0 to 1 raise Violation.
    """
    if m < 1 or alpha is not None and not 0 < alpha <= 1:
        raise Violation("persistence must be at least 1 and alpha in (0, 1]")
    # Each window once, each entity's end cycle once, and calibrated scores alone.
    cycles = scores.groupBy("detector_id", roles.entity, "end_cycle").count().where("count > 1")
    assert_empty(check_scores(scores).unionByName(cycles.select(F.lit("duplicate_cycle").alias("check"), F.concat_ws(":", "detector_id", F.col(roles.entity).cast("string"), F.col("end_cycle").cast("string")).alias("detail"))))
    # One context: one join, after which all else is partitioned by entity.
    wanted = thresholds.where((F.col("context") == context) & (F.col("rule_id") == rule_id)).drop("reference_count")
    by = ["detector_id", roles.mode] if context == "per_mode" else ["detector_id"]
    rows = ewma(scores, [alpha], roles=roles).join(F.broadcast(wanted if context == "per_mode" else wanted.drop(roles.mode)), by, "left")
    rows = rows.withColumns({"context": F.lit(context), "rule_id": F.lit(rule_id)})
    marked = segments(_violations(rows, roles), roles=roles)
    return state_segment_id(cut(persistence(marked, ["detector_id"], F.lit(m), roles), "persistence"), roles=roles)


def _violations(rows: DataFrame, roles: Roles) -> DataFrame:
    """``rows`` with threshold_violation; a row whose mode has no threshold is an error."""
    lacking = F.raise_error(F.concat(F.lit("no threshold for mode "), F.coalesce(F.col(roles.mode).cast("string"), F.lit("null"))))
    checked = rows.withColumn("threshold", F.when(F.col("threshold").isNull(), lacking).otherwise(F.col("threshold")))
    return checked.withColumn("threshold_violation", F.col("smoothed_score") > F.col("threshold"))


def trace_policies(scores: DataFrame, thresholds: DataFrame, policies: DataFrame, alphas: Sequence[float | None], roles: Roles = Roles()) -> DataFrame:
    """The alert traces of many policies in one pass: the rows of ``apply_policy`` for each, with ``candidate_id``.

    ``policies``: (candidate_id, detector_id, context, rule_id, ewma_id, persistence), a table
    of parameters; several may be of one detector.  Scores are smoothed once for every one of
    ``alphas`` that a policy may ask for, and meet their policies by (detector, smoothing)
    and their thresholds by (policy, mode).  Segments and runs are by policy and entity, so
    all policies share one exchange.  A mode without a threshold is an error.
    """
    wanted = policies.select("candidate_id", "detector_id", "context", "rule_id", "ewma_id", "persistence")
    limits = wanted.join(F.broadcast(thresholds.drop("reference_count")), ["detector_id", "context", "rule_id"])
    smooth = ewma(scores.join(F.broadcast(wanted.select("detector_id").distinct()), "detector_id"), alphas, roles=roles)
    rows = smooth.join(F.broadcast(wanted), ["detector_id", "ewma_id"])
    # A policy has a threshold of its own or one for each mode: two small joins, and no second pass.
    whole = limits.where("context = 'global'").select("candidate_id", F.col("threshold").alias("__whole"))
    per = limits.where("context = 'per_mode'").select("candidate_id", roles.mode, F.col("threshold").alias("__per"))
    seen = rows.join(F.broadcast(whole), "candidate_id", "left").join(F.broadcast(per), ["candidate_id", roles.mode], "left")
    seen = seen.withColumn("threshold", F.coalesce("__whole", "__per")).drop("__whole", "__per")
    keys = ["candidate_id", "detector_id"]
    marked = segments(_violations(seen, roles), keys, roles)
    return state_segment_id(cut(persistence(marked, keys, F.col("persistence"), roles), "traces"), keys, roles)


def alert_events(trace: DataFrame, keys: Sequence[str] = ("detector_id",), roles: Roles = Roles()) -> DataFrame:
    """(keys, entity, event_id, event_number, start, end, duration): runs of active rows with consecutive end cycles."""
    w = Window.partitionBy(*keys, roles.entity).orderBy("end_cycle")
    active = trace.where("alert_active").withColumn("__i", F.col("end_cycle") - F.row_number().over(w))
    runs = active.groupBy(*keys, roles.entity, "__i").agg(F.min("end_cycle").alias("event_start_cycle"), F.max("end_cycle").alias("event_end_cycle"), F.count("*").alias("event_duration_endpoints"))
    number = F.row_number().over(Window.partitionBy(*keys, roles.entity).orderBy("event_start_cycle"))
    out = runs.drop("__i").withColumn("event_number", number)
    return out.withColumn("event_id", event_id(F.col(roles.entity), F.col("event_number")))


def event_flags(trace: DataFrame, events: DataFrame, keys: Sequence[str] = ("detector_id",), roles: Roles = Roles()) -> DataFrame:
    """With event_start and event_status: the event's id where it starts, ``active`` within one, else ``none``."""
    starts = events.select(*keys, roles.entity, F.col("event_start_cycle").alias("end_cycle"), F.col("event_id").alias("__e"))
    joined = trace.join(starts, [*keys, roles.entity, "end_cycle"], "left")
    status = F.when(F.col("__e").isNotNull(), F.col("__e")).when(F.col("alert_active"), "active").otherwise("none")
    return joined.withColumn("event_start", F.col("__e").isNotNull()).withColumn("event_status", status).drop("__e")
