"""Streaming alerts: the batch inference chain as keyed state under an event-time watermark.

State of an entity: its last scaled rows (one less than a window), the last smoothed score,
the run of violations, the open event, and a reorder buffer of rows that came before their
turn.  A row is released when it follows the last one (or is the entity's first cycle, 1),
or once the watermark has passed its time: then what is missing before it counts as lost,
and the gap starts the window, smoothing and run anew.  Timers release what waits, and
close the open event of an entity that has been idle and forget it.

Every row that isn't scored is told: ``bad`` (no whole positive cycle, values that aren't
finite, a mode that the fit doesn't know) or ``late`` (a cycle that is over, or stands twice).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.order import running
from ..operators.alerts import smooth
from ..plans.study import InferenceState
from ..schema import Roles
from ..sources.scratch import scratch

OUTPUT = "kind string, engine long, end_cycle long, op_mode int, raw_score double, alert_score double, smoothed_score double, threshold double, persistence_count int, alert_active boolean, event_number int, event_start_cycle long, event_end_cycle long, reason string"
STATE = "last_cycle long, last_time long, smoothed double, run int, events int, active boolean, event_start long, waiting int, history array<double>"
#: What a session must use for map state and timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def reference_steps(reference: DataFrame, most: int) -> DataFrame:
    """(raw_score, share): the distinct scores at which the share of scores up to them passes a multiple of 1 / ``most``."""
    at = running(reference, [], "raw_score", {"__n": "1"}).crossJoin(F.broadcast(reference.agg(F.count("raw_score").alias("__all"))))
    step = lambda n: F.floor(n * F.lit(most) / F.col("__all"))
    return at.where(step(F.col("__n_upto")) > step(F.col("__n_upto") - F.col("__n"))).select("raw_score", (F.col("__n_upto") / F.col("__all")).alias("share"))


class Scorer:
    """Numbers of an InferenceState: scaled rows to scores and thresholds.

    The reference is kept as at most ``most`` of its distinct scores with their running
    shares, those at which the share passes a multiple of 1 / most: exact for up to
    ``most`` reference rows, and beyond them at most 1 / most too low.  It travels with the
    processor, which can't read broadcasts: more than about 60,000 scores need a session
    whose ``spark.broadcast.UDFCompressionThreshold`` is above their 16 bytes each.
    """

    def __init__(self, state: InferenceState, roles: Roles, most: int = 50_000):
        self.roles, self.alpha, self.m = roles, 1.0 if state.alpha is None else state.alpha, state.m
        wanted = state.thresholds.where((F.col("context") == state.context) & (F.col("rule_id") == state.rule_id)).collect()
        limits = {r[roles.mode]: r["threshold"] for r in wanted}
        scalers = {r[roles.mode]: r for r in state.scalers.collect() if limits.get(r[roles.mode], limits.get(None)) is not None}
        self.modes = np.array(sorted(scalers), np.int64)
        self.mean, self.scale = (np.array([[scalers[m][f"{c}_{s}"] for s in roles.sensors] for m in self.modes.tolist()], float).reshape(-1, len(roles.sensors)) for c in ("mean", "scale"))
        self.limits = np.array([limits.get(m, limits.get(None)) for m in self.modes.tolist()], float)
        f = state.feature_scaler.first()
        self.center, self.spread = np.array([f[f"mean_{c}"] for c in roles.features]), np.array([f[f"scale_{c}"] for c in roles.features])
        self.pca_mean, self.left = state.pca.mean, np.eye(len(roles.features)) - state.pca.components.T @ state.pca.components
        ref = reference_steps(state.reference, most).toPandas().sort_values("raw_score")
        self.values, self.share = ref["raw_score"].to_numpy(), np.append(0.0, ref["share"].to_numpy())

    def reasons(self, rows: pd.DataFrame) -> np.ndarray:
        """Why each row can't be scored, None where it can."""
        roles = self.roles
        cycle, mode = (pd.to_numeric(rows[c], errors="coerce").to_numpy(float) for c in (roles.order, roles.mode))
        sensors = rows[list(roles.sensors)].to_numpy(float)
        out = np.full(len(rows), None, object)
        out[~np.isin(mode, self.modes)] = "mode"
        out[~np.isfinite(sensors).all(axis=1)] = "values"
        out[~(np.isfinite(cycle) & (cycle >= 1) & (cycle == np.floor(cycle)))] = "cycle"
        return out

    def scale_rows(self, modes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled sensors, and the threshold, of each row."""
        at = np.searchsorted(self.modes, modes)
        return (x - self.mean[at]) / self.scale[at], self.limits[at]

    def scores(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw and calibrated scores of all windows of scaled rows that follow one another."""
        w = np.lib.stride_tricks.sliding_window_view(rows, self.roles.window, axis=0)
        features = np.round(np.concatenate((w.mean(axis=2), w.std(axis=2), w[:, :, -1] - w[:, :, 0]), axis=1), 9)
        z = ((features - self.center) / self.spread - self.pca_mean) @ self.left.T
        raw = np.round((z * z).mean(axis=1), 9)
        return raw, self.share[np.searchsorted(self.values, raw, side="right")]


@dataclass
class Entity:
    """An entity's state between rows."""

    last_cycle: int | None = None
    last_time: int | None = None
    smoothed: float | None = None
    run: int = 0
    events: int = 0
    active: bool = False
    event_start: int | None = None
    waiting: int = 0
    history: list[float] | None = None

    def row(self) -> tuple:
        return (self.last_cycle, self.last_time, self.smoothed, self.run, self.events, self.active, self.event_start, self.waiting, list(self.history or []))


def _closing(entity: int, state: Entity, reason: str) -> dict:
    return {"kind": "event", "engine": entity, "event_number": state.events, "event_start_cycle": state.event_start, "event_end_cycle": state.last_cycle, "reason": reason}


def advance(scorer: Scorer, entity: int, state: Entity, cycles: np.ndarray, modes: np.ndarray, x: np.ndarray) -> list[dict]:
    """Move an entity over usable rows in order of cycle, all after its last one; rows of every full window and closed event."""
    roles, out, w = scorer.roles, [], scorer.roles.window
    scaled, limits = scorer.scale_rows(modes, x)
    before = np.concatenate(([state.last_cycle if state.last_cycle is not None else cycles[0] - 1], cycles[:-1]))
    cuts = np.flatnonzero(cycles != before + 1)
    for lo, hi in zip([0, *cuts[cuts > 0]], [*cuts[cuts > 0], len(cycles)], strict=True):
        if cycles[lo] != before[lo] + 1 or state.last_cycle is None:
            if state.active:
                out.append(_closing(entity, state, "gap"))
            state.history, state.smoothed, state.run, state.active, state.event_start = [], None, 0, False, None
        rows = np.concatenate((np.array(state.history or [], float).reshape(-1, len(roles.sensors)), scaled[lo:hi]))
        state.history = rows[len(rows) - min(len(rows), w - 1) :].ravel().tolist()
        first = hi - (len(rows) - w + 1) if len(rows) >= w else hi  # the row that ends the first full window
        if first < hi:
            raw, alert = scorer.scores(rows)
            follows = state.smoothed is not None
            starts = np.zeros(len(alert), bool)
            starts[0] = not follows
            s = smooth(alert, starts, np.array([scorer.alpha]), np.array([state.smoothed]) if follows else None)[:, 0]
            over = s > limits[first:hi]
            for k in range(len(raw)):
                at = first + k
                state.run = state.run + 1 if over[k] else 0
                active = state.run >= scorer.m
                if state.active and not active:
                    state.last_cycle = int(cycles[at]) - 1
                    out.append(_closing(entity, state, "calm"))
                if active and not state.active:
                    state.events, state.event_start = state.events + 1, int(cycles[at])
                state.active = active
                out.append({"kind": "window", "engine": entity, "end_cycle": int(cycles[at]), "op_mode": int(modes[at]), "raw_score": raw[k], "alert_score": alert[k], "smoothed_score": s[k], "threshold": limits[at], "persistence_count": state.run, "alert_active": active, "event_number": state.events if active else None})
            state.smoothed = float(s[-1])
        state.last_cycle = int(cycles[hi - 1])
    return out


class Alerts(StatefulProcessor):
    """The state of one entity at a time; ``idle`` in milliseconds of event time, None: entities are never forgotten."""

    def __init__(self, scorer: Scorer, roles: Roles, idle: int | None):
        self.scorer, self.roles, self.idle = scorer, roles, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getMapState("waiting", "cycle long", "time long, mode int, x array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows), ignore_index=True)
        entity, roles, state = key[0], self.roles, self._load()
        reason, out = self.scorer.reasons(got), []
        bad = np.array([r is not None for r in reason])
        for cycle, why in zip(got[roles.order][bad], reason[bad], strict=True):
            out.append({"kind": "bad", "engine": entity, "end_cycle": None if pd.isna(cycle) else int(cycle), "reason": why})
        held = self._held(state)
        good = got[~bad].sort_values(roles.order, kind="stable")
        values = good[list(roles.sensors)].to_numpy(float).tolist()
        for cycle, time, mode, x in zip(*(good[c].astype("int64").tolist() for c in (roles.order, "event_millis", roles.mode)), values, strict=True):
            if cycle in held or state.last_cycle is not None and cycle <= state.last_cycle:
                out.append({"kind": "late", "engine": entity, "end_cycle": cycle, "reason": "repeated" if cycle in held else "over"})
            else:
                held[cycle] = (time, mode, x)
        yield self._frame(out + self._release(entity, state, held, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, now = self._load(), timerValues.getCurrentWatermarkInMs()
        out = self._release(key[0], state, self._held(state), now)
        if self.idle is not None and not state.waiting and state.last_time is not None and state.last_time + self.idle <= now:
            if state.active:
                out.append(_closing(key[0], state, "idle"))
            self.state.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _load(self) -> Entity:
        got = self.state.get() if self.state.exists() else None
        return Entity(*got) if got else Entity()

    def _held(self, state: Entity) -> dict[int, tuple]:
        return {int(k[0]): tuple(v) for k, v in self.waiting.iterator()} if state.waiting else {}

    def _release(self, entity: int, state: Entity, held: dict[int, tuple], now: int) -> list[dict]:
        """Score what has its turn, keep the rest in the buffer, and ask for a timer."""
        order = sorted(held)
        stored = {int(k[0]) for k in self.waiting.keys()} if state.waiting else set()
        due = max((c for c in order if held[c][0] <= now), default=0)
        last, ready = state.last_cycle if state.last_cycle is not None else 0, []
        for c in order:
            if c > due and c != last + 1:
                break
            ready.append(c)
            last = c
        out = []
        if ready:
            times, modes, x = zip(*(held.pop(c) for c in ready), strict=True)
            out = advance(self.scorer, entity, state, np.array(ready, np.int64), np.array(modes, np.int64), np.array(x, float))
            state.last_time = max(*times, state.last_time or 0) if state.last_time is not None or len(times) > 1 else times[0]
        for c in stored - set(held):
            self.waiting.removeKey((c,))
        for c in set(held) - stored:
            self.waiting.updateValue((c,), held[c])
        state.waiting = len(held)
        self.state.update(state.row())
        if held:
            self.handle.registerTimer(min(v[0] for v in held.values()))
        if self.idle is not None and state.last_time is not None:
            self.handle.registerTimer(state.last_time + self.idle)
        return out

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        names = [c.split(" ")[0] for c in OUTPUT.split(", ")]
        whole = dict.fromkeys(("end_cycle", "event_start_cycle", "event_end_cycle"), "Int64") | dict.fromkeys(("op_mode", "persistence_count", "event_number"), "Int32")
        return pd.DataFrame(rows, columns=names).astype(whole | {"alert_active": "boolean", "engine": "int64", "kind": object, "reason": object})


def stream_alerts(cycles: DataFrame, state: InferenceState, roles: Roles = Roles(), time: str = "time", delay: str = "10 seconds", idle: int | None = None, most: int = 50_000) -> DataFrame:
    """A streaming table of rows by ``kind``: ``window`` (scores and alert state), ``event`` (closed ones), ``late`` and ``bad``.

    ``cycles`` has a timestamp column ``time``, whose watermark lags by ``delay``: rows out
    of order by less give what rows in order give.  Rows behind the watermark reach the
    state too, so that none is dropped in silence.  ``idle``: milliseconds of event time
    after which an entity's open event is closed and its state forgotten.  ``most``: see ``Scorer``.  The session must
    use ``PROVIDER`` when the query starts.
    """
    # The time goes on as a plain number: rows aren't dropped by it before the state sees them.
    plain = F.unix_millis(time).alias("event_millis")
    rows = cycles.withWatermark(time, delay).where(F.col(roles.entity).isNotNull()).select(F.col(roles.entity).cast("long").alias(roles.entity), roles.order, roles.mode, *roles.sensors, plain)
    return rows.groupBy(roles.entity).transformWithStateInPandas(Alerts(Scorer(state, roles, most), roles, idle), OUTPUT, "append", "eventTime")


def stream_to_table(cycles: DataFrame, state: InferenceState, roles: Roles = Roles(), files: int = 4, arrival: Column | None = None, delay: str = "10 seconds", idle: int | None = None, base: str | None = None, steps: range | None = None) -> DataFrame:
    """Run the stream over ``cycles`` in micro-batches, and return its output table.

    A cycle's event time is its number in seconds.  ``arrival``: in which of ``files``
    batches, from 0, a row comes; by default ranges of cycles one after another, and rows
    without a positive cycle first.  ``base`` and ``steps`` let a later call go on with
    further batches of a stream that an earlier one has left.
    """
    spark, base = cycles.sparkSession, base or scratch(cycles.sparkSession, "stream")
    cols = [roles.entity, roles.order, roles.mode, *roles.sensors]
    order = F.col(roles.order)
    if arrival is None:
        last = cycles.agg(F.max(order)).first()[0] or 0
        arrival = F.greatest(F.lit(0), F.floor((order - 1) / F.lit(max(1, -(-int(last) // files)))))
    time = F.timestamp_seconds(F.greatest(F.coalesce(order, F.lit(0)), F.lit(0)).cast("long")).alias("time")
    rows = cycles.select(*cols, time, F.coalesce(arrival, F.lit(0)).cast("int").alias("__arrival"))
    rows.limit(0).drop("__arrival").write.mode("append").parquet(f"{base}/in")
    # Files are taken by age: a batch after another, and an entity's rows of a batch in one file.
    for k in steps or range(files):
        part = rows.where(F.col("__arrival") == k) if k < files - 1 else rows.where(F.col("__arrival") >= k)
        part.drop("__arrival").repartition(roles.entity).write.mode("append").parquet(f"{base}/in")
    source = spark.readStream.schema(rows.drop("__arrival").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    held = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        made = stream_alerts(source, state, roles, "time", delay, idle)
        run = made.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER[0]) if held is None else spark.conf.set(PROVIDER[0], held)
    return spark.read.schema(OUTPUT).parquet(f"{base}/out")
