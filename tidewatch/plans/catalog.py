"""Registered queries over the given tables and, where SQL can express them, their SQL.

Names start with the identifier of the operator that the query shows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import alerts, calibration, checks, compare, detectors, metrics, profile, proxies, regimes, scaling, selection, splits, thresholds, windows
from ..schema import EWMA, RULES, Grid, Roles
from ..sources import datasets, tables
from ..sources.scratch import cut, scratch, sweep
from ..sources.store import Store, table_key
from . import study
from .sqltext import chain

R = Roles()
MODES = 5
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, on_chain: bool = True, sources: tuple[str, ...] = ("energy", "peak")):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = chain(sql, sources) if on_chain else sql
        return f

    return add


#: Stage tables that queries of one session share, by application, input and stage.
_STAGES: dict[tuple[str, str, str], DataFrame] = {}


def stage(f):
    """Write a stage's table once for each session and input; later queries read it."""

    def shared(s: SparkSession, d: str) -> DataFrame:
        key = (s.sparkContext.applicationId, d, f.__name__)
        if key not in _STAGES:
            _STAGES[key] = cut(f(s, d), f.__name__.strip("_"))
        return _STAGES[key]

    return shared


def forget(s: SparkSession | None = None) -> None:
    """Drop the shared stage tables, so that the next query computes its own; of session ``s`` their files too."""
    _STAGES.clear()
    _PREPROCESSING.clear()
    _WHOLE_STUDY.clear()
    if s is not None:
        sweep(s)


def r9(*names: str):
    return [F.round(n, 9).alias(n) for n in names]


@stage
def _cycles(s, d):
    return datasets.event_cycles(s, d)


@stage
def _split(s, d):
    return study.split_cycles(_cycles(s, d))


@stage
def _assigned(s, d):
    return splits.stratified_split(splits.summarize_entities(_cycles(s, d)))


@stage
def _scaled(s, d):
    return study.transformed(_split(s, d), MODES)


@stage
def _features(s, d):
    return windows.summary_features(_scaled(s, d), R)


@stage
def _scores(s, d):
    return study.score_frame(_split(s, d), MODES)


@stage
def _trace(s, d):
    return study.alert_trace(_scores(s, d))


@stage
def _meta(s, d):
    return windows.window_metadata(_split(s, d), R)


@stage
def _labelled(s, d):
    return proxies.apply_policies(_meta(s, d), proxies.policy_table(s))


# ---- flagship ------------------------------------------------------------------------


@query("select detector_id, engine, event_number, event_start_cycle, event_end_cycle, event_duration_endpoints from events3")
def flagship_alerts(s, d):
    return alerts.alert_events(_trace(s, d)).select("detector_id", "engine", "event_number", "event_start_cycle", "event_end_cycle", "event_duration_endpoints")


# ---- sources and sinks ---------------------------------------------------------------


@query("select engine, cycle, op1, s1, s2, s3 from cyc")
def src1_read_cycles_text(s, d):
    path, cols = scratch(s, "text"), ["engine", "cycle", "op1", "s1", "s2", "s3"]
    c = _cycles(s, d).select(*cols)
    c.select(F.concat_ws("  ", *cols).alias("value")).write.text(path)
    return tables.read_cycles_text(s, path, c.schema)


@query("select engine, cycle, op1, s1, s2, s3 from cyc")
def src2_read_cycles_csv(s, d):
    path = scratch(s, "csv")
    c = _cycles(s, d).select("engine", "cycle", "op1", "s1", "s2", "s3")
    c.write.option("header", True).csv(path)
    return tables.read_cycles_csv(s, path, c.schema)


@query("select engine, cycle, s1 from cs where split = 'train'")
def src3_read_partition_filtered(s, d):
    c, a = _cycles(s, d), _assigned(s, d)
    return tables.read_partition_filtered(c, a.where("split = 'train'"), a).select("engine", "cycle", "s1")


@query("select split, count(*) as rows from cs group by 1")
def src4_write_splits(s, d):
    return tables.write_splits(_cycles(s, d), _assigned(s, d), scratch(s, "splits"))


@query("select engine, split, cycle_count, max_cycle, stratum from spl")
def src5_manifest(s, d):
    return tables.manifest_memberships(tables.manifest_json(_assigned(s, d), 42, (0.6, 0.2, 0.2)))


@query("select window_id, engine, split, start_cycle, end_cycle, midpoint_cycle, max_cycle, round(life_fraction, 9) as life_fraction from meta")
def src6_write_window_metadata(s, d):
    out = tables.write_window_metadata(_split(s, d), _assigned(s, d), scratch(s, "meta"))
    return out.select("window_id", "engine", "split", "start_cycle", "end_cycle", "midpoint_cycle", "max_cycle", *r9("life_fraction"))


@query("select engine, cycle, op_mode, round(s1, 9) as s1, round(s2, 9) as s2, round(s3, 9) as s3 from tr")
def src7_write_transformed(s, d):
    out = tables.write_transformed(_scaled(s, d), _split(s, d), scratch(s, "scaled"), ["engine", "cycle", "op_mode", "op1"])
    return out.select("engine", "cycle", "op_mode", *r9("s1", "s2", "s3"))


@query("select engine, end_cycle, 10 as steps, round(total, 6) as total from (select engine, cycle as end_cycle, sum(s1 + s2 + s3) over (partition by engine order by cycle rows between 9 preceding and current row) as total from cyc) where end_cycle >= 10")
def src8_sequences(s, d):
    path = scratch(s, "sequences")
    windows.window_arrays(_cycles(s, d), R).write.parquet(path)
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0).cast("double"), lambda a, x: a + x)
    return s.read.parquet(path).select("engine", "end_cycle", F.size("sequence").alias("steps"), F.round(total, 6).alias("total"))


@query("select count(*) as rows, true as same from meta")
def src9_materialize_endpoint_context(s, d):
    made = tables.materialize_endpoint_context(_meta(s, d), _cycles(s, d), scratch(s, "context"))
    return made.join(compare.frame_fingerprint(windows.assign_endpoint_mode(_meta(s, d), _cycles(s, d))).withColumnsRenamed({"rows": "__n", "digest": "__d"})).select("rows", (F.col("digest") == F.col("__d")).alias("same"))


@query("select policy_id, count(*) filter (label_state = 'healthy') as healthy_windows, count(*) filter (label_state = 'ambiguous') as ambiguous_windows, count(*) filter (label_state = 'anomalous') as anomalous_windows from lab group by 1")
def src10_write_report_tables(s, d):
    path, t = scratch(s, "reports"), {"engines": splits.summarize_entities(_cycles(s, d)), "policy_counts": proxies.policy_counts(_labelled(s, d))}
    tables.write_tables(t, path)
    return s.read.parquet(f"{path}/policy_counts")


@query("select engine, count(*) as windows, min(end_cycle)::bigint as first_cycle, max(end_cycle)::bigint as last_cycle, true as in_range from meta where split = 'validation' group by 1")
def src11_write_timeline(s, d):
    c, path = _split(s, d), scratch(s, "timeline")
    timeline, _ = study.infer(_new_cycles(s, d), study.fit_inference(c, MODES, m=3, rule_id="quantile_0.950"))
    tables.write_timeline(timeline.select("window_id", "engine", "end_cycle", "alert_score", "alert_active", "event_status", "top_three"), path)
    back = s.read.json(path)
    return back.groupBy("engine").agg(F.count("*").alias("windows"), F.min("end_cycle").alias("first_cycle"), F.max("end_cycle").alias("last_cycle"), F.min(F.col("alert_score").between(0, 1)).alias("in_range"))


@query("select distinct 'user' || user_id as run_id, event_type as model from events")
def src12_run_ledger(s, d):
    path = scratch(s, "ledger")
    runs = s.read.parquet(f"{d}/events.parquet").groupBy(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("model")).count()
    maps = ("parameters", "evidence_boundary", "provenance")
    rest = [F.create_map(F.lit("n"), F.col("count").cast("string")).alias(f) if f in maps else F.lit("x").alias(f) for f in tables.LEDGER_FIELDS if f not in ("run_id", "model")]
    one = runs.withColumn("run_id", F.concat_ws("/", "run_id", "model")).select("run_id", "model", *rest)
    one.write.json(path)
    return tables.read_ledger(s, path).select(F.split("run_id", "/")[0].alias("run_id"), "model")


@query("select op_mode, fit_rows, fallback, round(m1, 9) as mean_s1, round(d1, 9) as scale_s1 from mscal")
def src13_fitted_state(s, d):
    path, marked = scratch(s, "state"), scaling.healthy_mask(_split(s, d), R)
    scalers = scaling.fit_mode_scalers(marked.where("split = 'train' and healthy"), R.sensors, MODES)
    tables.save_state({"scalers": scalers}, path, split_manifest_id="seed42")
    return tables.load_state(s, path, ["scalers"], split_manifest_id="seed42")["scalers"].select("op_mode", "fit_rows", "fallback", *r9("mean_s1", "scale_s1"))


@query("select event_type as run_id, (count(*))::varchar as notes from events group by 1", on_chain=False)
def src12_append_ledger(s, d):
    path = scratch(s, "ledger")
    nested = {"parameters", "evidence_boundary", "provenance"}
    for r in s.read.parquet(f"{d}/events.parquet").groupBy("event_type").count().collect():  # a run for each of a few types
        record = {f: {"n": "1"} if f in nested else "x" for f in tables.LEDGER_FIELDS} | {"run_id": r["event_type"], "notes": str(r["count"])}
        tables.append_ledger(s, path, record)
        try:
            tables.append_ledger(s, path, record | {"notes": "again"})
        except checks.Violation:
            continue
        raise checks.Violation("a run was appended twice")
    return tables.read_ledger(s, path).select("run_id", "notes")


@query("""select event_type, sum(strlen(line) + 1)::bigint as size, sha256(string_agg(line || chr(10), '' order by event_id)) as sha256, null::varchar as problem
from (select event_type, event_id, event_id || ':' || user_id as line from events) group by 1""", on_chain=False)
def src14_artifact_manifest(s, d):
    path = scratch(s, "artifacts")
    lines = s.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", F.concat_ws(":", "event_id", "user_id").alias("value"))
    lines.repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").text(path)
    found = tables.artifact_manifest(s, path, "part-*")
    kind = F.regexp_extract("path", "event_type=([^/]*)", 1).alias("event_type")
    return found.join(tables.verify_artifacts(found, found), "path", "left").select(kind, "size", "sha256", "problem")


# ---- integrity -----------------------------------------------------------------------


@query("select 'gap' as \"check\", c.engine || ':' || c.cycle as detail from cyc c join (select engine, cycle from cyc where cycle % 7 <> 0 or cycle = 1) k using (engine, cycle) where c.cycle % 7 = 1 and c.cycle > 1")
def val1_check_cycles(s, d):
    return checks.check_cycles(_cycles(s, d).where("cycle % 7 <> 0 or cycle = 1"))


@query("select 'too_short' as \"check\", engine::varchar as detail from cyc group by engine having count(*) < 60")
def val2_check_inference_input(s, d):
    roles = Roles(window=60)
    return checks.check_inference_input(_cycles(s, d).drop("op_mode"), roles)


@query("select 'null_values' as \"check\", 's2=' || count(*) as detail from cyc where s1 > 100 having count(*) > 0")
def val3_check_preprocessing_input(s, d):
    return checks.check_preprocessing_input(_cycles(s, d).withColumn("s2", F.when(F.col("s1") <= 100, F.col("s2"))))


@query("select 'missing' as \"check\", engine::varchar as detail from spl where split = 'test' union all select 'assigned_twice', engine::varchar from spl where split = 'train'")
def val4_check_assignments(s, d):
    a = _assigned(s, d).select("engine", "split")
    return checks.check_assignments(a.where("split <> 'test'").unionByName(a.where("split = 'train'")), _cycles(s, d))


@query("select 'not_in_split' as \"check\", engine::varchar as detail from spl where split = 'validation'")
def val5_check_split_membership(s, d):
    return checks.check_split_membership(_split(s, d).where("split <> 'test'"), _assigned(s, d), "train")


@query("select 'window_count' as \"check\", engine::varchar as detail from spl where split = 'test'")
def val6_check_window_metadata(s, d):
    return checks.check_window_metadata(_meta(s, d).where("split <> 'test' or end_cycle > start_cycle + 9 or end_cycle < max_cycle"), _cycles(s, d))


@query("select 'mode' as \"check\", engine || ':' || cycle as detail from cyc where op_mode = 4")
def val7_check_modes(s, d):
    return checks.check_modes(_cycles(s, d), 4)


@query("select op_mode, count(*) filter (split = 'train') as train_windows, count(*) filter (split = 'validation') as validation_windows, count(*) filter (split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double)) as eligible_windows from meta group by 1")
def val8_mode_coverage(s, d):
    return checks.mode_coverage(windows.assign_endpoint_mode(_meta(s, d), _cycles(s, d)), MODES)


@query("""select 'too_few_eligible' as "check", op_mode::varchar as detail from (select op_mode, count(*) filter (split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double)) as n from meta group by 1) where n < 300
union all select 'mode_absent', op_mode::varchar from meta group by op_mode having count(*) filter (split = 'train') = 0 or count(*) filter (split = 'validation') = 0""")
def val8_check_mode_coverage(s, d):
    return checks.check_mode_coverage(windows.assign_endpoint_mode(_meta(s, d), _cycles(s, d)), MODES, 300)


@query("select 'score' as \"check\", detector_id || ':' || window_id as detail from sc where alert_score > 0.95")
def val9_check_scores(s, d):
    return checks.check_scores(_scores(s, d).withColumn("alert_score", F.when(F.col("alert_score") > 0.95, F.lit(2.0)).otherwise(F.col("alert_score"))))


@query("select 'shape' as \"check\", window_id as detail from meta where end_cycle = max_cycle")
def val10_check_sequences(s, d):
    seq = windows.window_arrays(_split(s, d).withColumn("m", F.max("cycle").over(Window.partitionBy("engine"))), R).join(_meta(s, d).select("engine", "end_cycle", "window_id", "max_cycle"), ["engine", "end_cycle"])
    return checks.check_sequences(seq.withColumn("sequence", F.when(F.col("end_cycle") == F.col("max_cycle"), F.slice("sequence", 1, 5)).otherwise(F.col("sequence"))), 10, 3)


@query("select 'split_not_allowed' as \"check\", split as detail from spl where split <> 'train'")
def val11_guard_splits(s, d):
    return checks.guard_splits(_assigned(s, d))


@query("select 'row_count' as \"check\", count(*)::varchar as detail from cs where split = 'train'")
def val12_check_training_partition(s, d):
    return checks.check_training_partition(_split(s, d).where("split = 'train'"), _assigned(s, d), rows=1)


# ---- projections and parameter tables ------------------------------------------------


@query("select engine, cycle, max_cycle, healthy from cs")
def prj1_healthy_mask(s, d):
    return scaling.healthy_mask(_cycles(s, d), R).select("engine", "cycle", "max_cycle", "healthy")


@query("select window_id from meta where end_cycle <= floor(max_cycle::double * 0.3::double)")
def prj2_eligible_windows(s, d):
    return _meta(s, d).where(proxies.eligible()).select("window_id")


@query("select engine, cycle, round(cycle::double / max_cycle, 9) as life_fraction from cs")
def prj3_life_fraction(s, d):
    return scaling.healthy_mask(_cycles(s, d), R).select("engine", "cycle", F.round(F.col("cycle") / F.col("max_cycle"), 9).alias("life_fraction"))


@query("select engine, cycle from cs where split = 'validation'")
def prj4_filter_entities(s, d):
    return _cycles(s, d).join(_assigned(s, d).where("split = 'validation'"), "engine", "left_semi").select("engine", "cycle")


@query("select window_id, onset_cycle, label_state, proxy_label from lab where policy_id = 'normalized_life_last_30pct_full_window'")
def prj5_apply_onset_policy(s, d):
    return _labelled(s, d).where("policy_id = 'normalized_life_last_30pct_full_window'").select("window_id", "onset_cycle", "label_state", "proxy_label")


@query("select window_id, policy_id, onset_cycle, label_state, proxy_label from lab")
def prj6_registered_policies(s, d):
    return _labelled(s, d).select("window_id", "policy_id", "onset_cycle", "label_state", "proxy_label")


@query("select window_id, engine, start_cycle, end_cycle, max_cycle, op_mode, detector_id, split, 'regime' as pipeline_id, round(raw_score, 6) as raw_score, round(alert_score, 6) as alert_score from sc")
def prj7_score_frame(s, d):
    return _scores(s, d).select("window_id", "engine", "start_cycle", "end_cycle", "max_cycle", "op_mode", "detector_id", "split", F.lit("regime").alias("pipeline_id"), F.round("raw_score", 6).alias("raw_score"), F.round("alert_score", 6).alias("alert_score"))


@query("select u.user_id, r.rule_id, r.kind, r.value from (select distinct user_id from events) u cross join rules r")
def prj8_threshold_rules(s, d):
    users = s.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return users.crossJoin(F.broadcast(thresholds.rule_table(s).drop("rule_rank")))


GRID = Grid(detectors=("energy", "peak"))


@query("""select c.detector_id || '__' || c.context || '__' || r.rule_id || '__ewma_' || e.ewma_id || '__persistence_' || m.m as candidate_id, n.windows
from (select distinct detector_id, context from lists) c cross join rules r cross join (values ('off'), ('alpha_0.20'), ('alpha_0.50'), ('alpha_0.80')) e(ewma_id) cross join (values (1), (3), (5), (8)) m(m) join (select detector_id, count(*) as windows from sc group by 1) n using (detector_id)""")
def prj9_alert_candidate_grid(s, d):
    n = _scores(s, d).groupBy("detector_id").agg(F.count("*").alias("windows"))
    return thresholds.candidate_grid(s, GRID).join(F.broadcast(n), "detector_id").select("candidate_id", "windows")


@query("""select detector_id, parameter_set, parameter, value, engines from (values ('pca', 'n_components', 0.9::double, 0), ('pca', 'n_components', 0.95, 1), ('pca', 'n_components', 0.99, 2), ('one_class_svm', 'nu', 0.01, 0), ('one_class_svm', 'nu', 0.05, 1), ('one_class_svm', 'nu', 0.1, 2),
('isolation_forest', 'max_samples', 256, 0), ('isolation_forest', 'max_samples', 1024, 1), ('isolation_forest', 'max_samples', 5000, 2), ('isolation_forest', 'n_estimators', 300, 0), ('isolation_forest', 'n_estimators', 300, 1), ('isolation_forest', 'n_estimators', 300, 2),
('lof', 'n_neighbors', 20, 0), ('lof', 'n_neighbors', 35, 1), ('lof', 'n_neighbors', 50, 2)) v(detector_id, parameter, value, k), lateral (select detector_id || '_' || k as parameter_set), (select count(*) as engines from life)""")
def prj10_detector_candidate_grid(s, d):
    n = splits.summarize_entities(_cycles(s, d)).agg(F.count("*").alias("engines"))
    return thresholds.detector_grid(s).crossJoin(F.broadcast(n)).select("detector_id", "parameter_set", F.explode("params").alias("parameter", "value"), "engines")


@query("select engine, cycle, sensor, value from (unpivot (select engine, cycle, s1, s2, s3 from cyc) on s1, s2, s3 into name sensor value value)")
def prj11_unpivot_sensors(s, d):
    return profile.unpivot(_cycles(s, d))


def _evaluated(s, d):
    return study.evaluate_policy(_trace(s, d), proxies.policy_table(s))


METRICS = """, pm as (select o.detector_id, o.policy_id, count(*) as engine_count, count(first_detection) as detected_engines, count(*) filter (false_events > 0) as false_alert_engines, sum(false_events)::bigint as false_events, sum(crossing_events)::bigint as crossing_events, sum(detection_events)::bigint as detection_events,
 quantile_cont(first_detection - onset_cycle, 0.5)::double as median_delay, quantile_cont(first_detection - onset_cycle, 0.25)::double as q1_delay, quantile_cont(max_cycle - first_detection, 0.5)::double as median_lead, quantile_cont(max_cycle - first_detection, 0.75)::double as q3_lead from outc o group by 1, 2),
 pmc as (select pm.*, tp, fp, tn, fn, round(100 * detected_engines::double / engine_count, 9) as coverage_percent, round(1000 * fp::double / nullif(fp + tn, 0), 9) as fp_per_1000_healthy, round(1000 * false_events::double / nullif(fp + tn, 0), 9) as false_events_per_1000_healthy, round(100 * false_alert_engines::double / engine_count, 9) as false_alert_engine_percent, round(detection_events::double / nullif(detected_engines, 0), 9) as fragmentation from pm join conf using (detector_id, policy_id))"""


@query(METRICS + " select detector_id, policy_id, round(fp_per_1000_healthy / 10, 6) as far_percent, fp_per_1000_healthy <= 60 as meets_fp_limit, coalesce(median_delay <= 12, false) as meets_delay, fp_per_1000_healthy / 10 < 6 as far_below_6 from pmc")
def prj12_target_attainment(s, d):
    return metrics.target_attainment(_evaluated(s, d)["metrics"]).select("detector_id", "policy_id", F.round("far_percent", 6).alias("far_percent"), "meets_fp_limit", "meets_delay", "far_below_6")


@query(METRICS + " select detector_id, policy_id, round(fp_per_1000_healthy / 10, 6) as far_percent from pmc")
def prj13_far_percent(s, d):
    return metrics.target_attainment(_evaluated(s, d)["metrics"]).select("detector_id", "policy_id", F.round("far_percent", 6).alias("far_percent"))


# ---- joins ---------------------------------------------------------------------------


@query("select window_id, op_mode from meta")
def j1_assign_endpoint_mode(s, d):
    return windows.assign_endpoint_mode(_meta(s, d), _cycles(s, d)).select("window_id", "op_mode")


@query("select detector_id, window_id, policy_id, alert_active, label_state from act join lab using (window_id)")
def j2_align_policy(s, d):
    return metrics.align_policy(_trace(s, d), _labelled(s, d)).select("detector_id", "window_id", "policy_id", "alert_active", "label_state")


@query("select window_id, c.cycle from meta m join cyc c on c.engine = m.engine and c.cycle between m.start_cycle and m.end_cycle")
def j3_windows_to_cycles(s, d):
    return windows.windows_to_cycles(_meta(s, d), _cycles(s, d)).select("window_id", "cycle")


@query("select window_id, 2::bigint as members, round(avg(alert_score), 6) as alert_score from sc group by 1")
def j4_ensemble_scores(s, d):
    sc = _scores(s, d)
    return detectors.ensemble([sc.where(F.col("detector_id") == x) for x in ("energy", "peak")]).withColumn("alert_score", F.round("alert_score", 6))


@query("select s.detector_id, s.window_id, t.context, t.rule_id, round(t.threshold, 6) as threshold from sc s join thr t on t.detector_id = s.detector_id and (t.op_mode is null or t.op_mode = s.op_mode) where s.split = 'validation'")
def j5_threshold_lookup(s, d):
    sc = _scores(s, d)
    fitted = thresholds.fit_thresholds(study.eligible_training(sc))
    return thresholds.threshold_lookup(sc.where("split = 'validation'"), fitted).select("detector_id", "window_id", "context", "rule_id", F.round("threshold", 6).alias("threshold"))


@query("select policy_id, count(*) filter (a.first_detection is not null and b.first_detection is not null) as detected_both, count(*) filter (a.first_detection is not null and b.first_detection is null) as detected_only_a, count(*) filter (a.first_detection is null and b.first_detection is not null) as detected_only_b, count(*) filter (a.false_events > 0 and b.false_events > 0) as false_alert_both from outc a join outc b using (policy_id, engine) where a.detector_id = 'energy' and b.detector_id = 'peak' group by 1")
def j6_detector_complementarity(s, d):
    return metrics.complementarity(_evaluated(s, d)["outcomes"], "energy", "peak").select("policy_id", "detected_both", "detected_only_a", "detected_only_b", "false_alert_both")


@query("select 's1' as \"column\", count(*) as rows, 0::bigint as only_left, count(*) filter (split = 'test') as only_right, count(*) filter (split <> 'test' and cycle % 5 = 0) as mismatches, 0.001 as max_abs_difference from cs")
def j7_compare_frames(s, d):
    c = _split(s, d)
    left = c.where("split <> 'test'").withColumn("s1", F.when(F.col("cycle") % 5 == 0, F.col("s1") + 0.001).otherwise(F.col("s1")))
    out = compare.compare_frames(left, c, ["engine", "cycle"], close=["s1"], rtol=0, atol=1e-4)
    return out.withColumn("max_abs_difference", F.round("max_abs_difference", 6)).select("column", "rows", "only_left", "only_right", "mismatches", "max_abs_difference")


@query("select (4 - op_mode)::int as raw_mode, op_mode, count(*) as n, null::varchar as problem from cyc group by 1, 2")
def j8_canonical_mode_map(s, d):
    return regimes.canonical_mapping(_cycles(s, d).withColumn("raw_mode", (4 - F.col("op_mode")).cast("int")), "raw_mode", "op_mode")


@query("select engine, 'semi' as side, count(*) as rows from cs where split = 'train' group by 1 union all select engine, 'anti', count(*) from cs where split <> 'train' group by 1")
def j9_semi_anti(s, d):
    c, a = _cycles(s, d), _assigned(s, d).where("split = 'train'")
    part = lambda how, name: c.join(a, "engine", how).groupBy("engine").agg(F.lit(name).alias("side"), F.count("*").alias("rows"))
    return part("left_semi", "semi").unionByName(part("left_anti", "anti"))


@query("select detector_id, l.window_id, policy_id, round(alert_score, 6) as alert_score, proxy_label from lab l join sc using (window_id) where proxy_label is not null")
def j10_policy_score_lookup(s, d):
    return _labelled(s, d).where("proxy_label is not null").join(_scores(s, d).select("window_id", "detector_id", "alert_score"), "window_id").select("detector_id", "window_id", "policy_id", F.round("alert_score", 6).alias("alert_score"), "proxy_label")


# ---- aggregations --------------------------------------------------------------------


@query("select * from life")
def a1_summarize_engines(s, d):
    return splits.summarize_entities(_cycles(s, d))


@query("select n as fit_rows, round(m1, 9) as mean_s1, round(d1, 9) as scale_s1, round(m2, 9) as mean_s2, round(d2, 9) as scale_s2 from gscal")
def a2_fit_global_scaler(s, d):
    marked = scaling.healthy_mask(_split(s, d), R)
    return scaling.fit_global_scaler(marked.where("split = 'train' and healthy"), R.sensors).select("fit_rows", *r9("mean_s1", "scale_s1", "mean_s2", "scale_s2"))


@query("select op_mode, fit_rows, fallback, round(m1, 9) as mean_s1, round(d1, 9) as scale_s1, round(m3, 9) as mean_s3, round(d3, 9) as scale_s3 from mscal")
def a3_fit_regime_scalers(s, d):
    marked = scaling.healthy_mask(_split(s, d), R)
    return scaling.fit_mode_scalers(marked.where("split = 'train' and healthy"), R.sensors, MODES).select("op_mode", "fit_rows", "fallback", *r9("mean_s1", "scale_s1", "mean_s3", "scale_s3"))


@query("select count(*) as fit_rows, round(avg(op1), 9) as mean_op1, round(stddev_pop(op1), 9) as scale_op1 from cs where split = 'train'")
def a4_fit_setting_scaler(s, d):
    return scaling.fit_global_scaler(_split(s, d).where("split = 'train'"), R.settings).select("fit_rows", *r9("mean_op1", "scale_op1"))


@query("select detector_id, context, t.rule_id, op_mode, round(threshold, 9) as threshold, reference_count from thr t join rules using (rule_id) where kind = 'quantile'")
def a5_quantile_thresholds(s, d):
    fitted = thresholds.fit_thresholds(study.eligible_training(_scores(s, d)), [r for r in RULES if r.kind == "quantile"])
    return fitted.withColumn("threshold", F.round("threshold", 9))


@query("select detector_id, context, t.rule_id, op_mode, round(threshold, 9) as threshold, reference_count from thr t join rules using (rule_id) where kind = 'mean_plus_std'")
def a6_mean_std_thresholds(s, d):
    fitted = thresholds.fit_thresholds(study.eligible_training(_scores(s, d)), [r for r in RULES if r.kind == "mean_plus_std"])
    return fitted.withColumn("threshold", F.round("threshold", 9))


@query("select q.l_orderkey, q.l_linenumber, round((select count(*) from (select l_quantity * l_discount as x from lineitem where l_returnflag = 'N') r where r.x <= q.l_quantity * q.l_discount)::double / (select count(*) from lineitem where l_returnflag = 'N'), 9) as share from lineitem q where l_returnflag = 'R'", on_chain=False)
def a7_ecdf(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").withColumn("x", F.col("l_quantity") * F.col("l_discount"))
    return calibration.ecdf(li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'"), "x", [], "share").select("l_orderkey", "l_linenumber", *r9("share"))


@query("select policy_id, count(*) filter (label_state = 'healthy') as healthy_windows, count(*) filter (label_state = 'ambiguous') as ambiguous_windows, count(*) filter (label_state = 'anomalous') as anomalous_windows from lab group by 1")
def a8_policy_counts(s, d):
    return proxies.policy_counts(_labelled(s, d))


@query("select detector_id, policy_id, tp, fp, tn, fn, round(tp::double / nullif(tp + fp, 0), 9) as precision, round(tp::double / nullif(tp + fn, 0), 9) as recall, round(tn::double / nullif(tn + fp, 0), 9) as specificity, round(1000 * fp::double / nullif(fp + tn, 0), 9) as fp_per_1000_healthy from conf")
def a9_endpoint_confusion(s, d):
    both = proxies.apply_policies(_trace(s, d), proxies.policy_table(s))
    return metrics.endpoint_confusion(both, ["detector_id", "policy_id"]).select("detector_id", "policy_id", "tp", "fp", "tn", "fn", *r9("precision", "recall", "specificity", "fp_per_1000_healthy"))


@query("select detector_id, policy_id, engine, onset_cycle, max_cycle, first_detection, false_events, crossing_events, detection_events, first_detection - onset_cycle as detection_delay, max_cycle - first_detection as lead_time from outc")
def a10_engine_outcomes(s, d):
    return _evaluated(s, d)["outcomes"].drop("detected")


COLS = ["engine_count", "detected_engines", "false_alert_engines", "false_events", "crossing_events", "detection_events", "median_delay", "q1_delay", "median_lead", "q3_lead", "tp", "fp", "tn", "fn"]
RATES = ["coverage_percent", "fp_per_1000_healthy", "false_events_per_1000_healthy", "false_alert_engine_percent", "fragmentation"]


@query(METRICS + f" select detector_id, policy_id, {', '.join(COLS + RATES)} from pmc")
def a11_policy_metrics(s, d):
    return _evaluated(s, d)["metrics"].select("detector_id", "policy_id", *COLS, *r9(*RATES))


@query(METRICS + """ select detector_id, round(min(coverage_percent), 9) as min_coverage, round(avg(coverage_percent), 6) as mean_coverage, round(max(fp_per_1000_healthy), 9) as worst_fp_per_1000, case when count(median_delay) = 3 then median(median_delay) end as median_delay, max(fp_per_1000_healthy) <= 60 as feasible
from pmc join pol using (policy_id) where selection_policy group by 1""")
def a12_aggregate_candidates(s, d):
    m = _evaluated(s, d)["metrics"].join(F.broadcast(proxies.policy_table(s).select("policy_id", "selection_policy")), "policy_id")
    return metrics.aggregate_candidates(m, ["detector_id"]).select("detector_id", *r9("min_coverage"), F.round("mean_coverage", 6).alias("mean_coverage"), *r9("worst_fp_per_1000"), "median_delay", "feasible")


@query("select op_mode, count(*) as rows, round(count(*)::double / (select count(*) from cyc), 9) as row_share, count(distinct engine) as engines, round(count(distinct engine)::double / (select count(*) from life), 9) as engine_share from cyc group by 1")
def a13_mode_occupancy(s, d):
    return regimes.mode_occupancy(_cycles(s, d), MODES).select("op_mode", "rows", *r9("row_share"), "engines", *r9("engine_share"))


@query("select op_mode, round(avg(op1), 9) as center_op1, round(stddev_pop(op1), 9) as spread_op1 from cyc group by 1")
def a14_mode_centroids(s, d):
    return regimes.mode_centroids(_cycles(s, d), R.settings).select("op_mode", *r9("center_op1", "spread_op1"))


@query("select op_mode, count(s1) as runs, round(quantile_cont(s1, 0.5), 9) as median, round(avg(s1), 9) as mean, round(stddev_samp(s1), 9) as std, min(s1) as least, max(s1) as greatest from cyc group by 1")
def a15_run_robustness(s, d):
    return metrics.run_robustness(_cycles(s, d), "op_mode", "s1").select("op_mode", "runs", *r9("median", "mean", "std"), "least", "greatest")


@query("select detector_id, op_mode, count(*) as reference_count, round(avg(alert_score), 9) as mean, round(stddev_pop(alert_score), 9) as std, round(min(alert_score), 9) as least, case when grouping(op_mode) = 1 then 'global' else 'per_mode' end as context from scref group by grouping sets ((detector_id), (detector_id, op_mode))")
def a16_score_reference_summary(s, d):
    return metrics.score_reference_summary(study.eligible_training(_scores(s, d))).select("detector_id", "op_mode", "reference_count", *r9("mean", "std", "least"), "context")


AP_SQL = """
with x as (select n_chars::double as score, quality as y from documents join labels using (doc_id) where n_chars is not null and quality is not null),
g as (select score, sum(y) as p, sum(1 - y) as n from x group by 1),
c as (select score, p, n, sum(p) over (order by score desc) as cp, sum(n) over (order by score desc) as cn, sum(p) over () as tp, sum(n) over () as tn from g)
select tp::bigint as positives, tn::bigint as negatives, {0} from c group by tp, tn"""


@query(AP_SQL.format("round(sum(p::double / tp * cp / (cp + cn)), 9) as average_precision"), on_chain=False)
def a17_average_precision(s, d):
    return metrics.average_precision(datasets.document_scores(s, d), [], "score", "quality").select("positives", "negatives", *r9("average_precision"))


@query(AP_SQL.format("round(sum(n * (cp - p / 2.0))::double / (tp * tn), 9) as roc_auc"), on_chain=False)
def a18_roc_auc(s, d):
    return metrics.average_precision(datasets.document_scores(s, d), [], "score", "quality").select("positives", "negatives", *r9("roc_auc"))


RANK_SQL = """, j as (select detector_id, policy_id, alert_score as score, proxy_label as y from sc join lab using (window_id) where proxy_label is not null),
g as (select detector_id, policy_id, score, sum(y) as p, sum(1 - y) as n from j group by 1, 2, 3),
c as (select *, sum(p) over w as cp, sum(n) over w as cn, sum(p) over (partition by detector_id, policy_id) as tp, sum(n) over (partition by detector_id, policy_id) as tn from g window w as (partition by detector_id, policy_id order by score desc)),
rk as (select detector_id, policy_id, tp::bigint as positives, tn::bigint as negatives, sum(p::double / tp * cp / (cp + cn)) as average_precision, sum(n * (cp - p / 2.0))::double / (tp * tn) as roc_auc from c group by detector_id, policy_id, tp, tn)"""


@query(RANK_SQL + " select detector_id, policy_id, positives, negatives, round(average_precision, 6) as average_precision, round(roc_auc, 6) as roc_auc from rk")
def a19_proxy_ranking_metrics(s, d):
    both = proxies.apply_policies(_scores(s, d), proxies.policy_table(s))
    return metrics.ranking_metrics(both).select("detector_id", "policy_id", "positives", "negatives", F.round("average_precision", 6).alias("average_precision"), F.round("roc_auc", 6).alias("roc_auc"))


@query(RANK_SQL + " select detector_id, round(avg(average_precision), 6) as mean_pr_auc, round(avg(roc_auc), 6) as mean_roc_auc from rk join pol using (policy_id) where selection_policy group by 1")
def a19_mean_ranking(s, d):
    both = proxies.apply_policies(_scores(s, d), proxies.policy_table(s))
    return metrics.mean_ranking(metrics.ranking_metrics(both)).select("detector_id", F.round("mean_pr_auc", 6).alias("mean_pr_auc"), F.round("mean_roc_auc", 6).alias("mean_roc_auc"))


def _embedding(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


SIL_SQL = """
with e as (select vec_id, label, embedding from embeddings where label is not null order by md5('42:' || vec_id::varchar), vec_id limit 5000),
p as (select a.vec_id, a.label as la, b.label as lb, count(*) as n, sum(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ^ 2)))) as s from e a cross join e b group by 1, 2, 3),
q as (select vec_id, la, max(case when la = lb then n end) as size, max(case when la = lb then s / nullif(n - 1, 0) end) as a, min(case when la <> lb then s / n end) as b from p group by 1, 2)
select count(*) as rows, round(avg(case when size = 1 then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from q"""


@query(SIL_SQL, on_chain=False)
def a20_silhouette(s, d):
    cols = [f"e{i}" for i in range(64)]
    return regimes.silhouette(_embedding(s, d), cols, "label", "vec_id").withColumn("silhouette", F.round("silhouette", 6))


@query("""with t as (select op_mode as a, (cycle % 3)::int as b, count(*)::double as n from (select (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::int as op_mode, row_number() over (partition by user_id order by ts, event_id) as cycle from events) group by 1, 2),
v as (select (select sum(n * (n - 1) / 2) from t) as ij, (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by a)) as sa, (select sum(m * (m - 1) / 2) from (select sum(n) as m from t group by b)) as sb, (select sum(n) from t) as n)
select n::bigint as n, round((ij - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 9) as adjusted_rand from v""", on_chain=False)
def a21_adjusted_rand(s, d):
    c = _cycles(s, d).withColumn("third", (F.col("cycle") % 3).cast("int"))
    return regimes.adjusted_rand(c, "op_mode", "third").select("n", *r9("adjusted_rand"))


CENTERS = np.array([[2.0], [7.0], [12.0], [17.0], [22.0]])
NEAREST = "least((op1 - 2) ^ 2, (op1 - 7) ^ 2, (op1 - 12) ^ 2, (op1 - 17) ^ 2, (op1 - 22) ^ 2)"


@query(f"select round(avg({NEAREST}), 9) as inertia_per_row, 5::double as min_centroid_distance, (select round(min(n)::double / sum(n), 9) from (select count(*) as n from cyc group by op_mode)) as min_row_share from cyc")
def a22_cluster_quality(s, d):
    return regimes.cluster_quality(_cycles(s, d), R.settings, CENTERS).select(*r9("inertia_per_row", "min_centroid_distance", "min_row_share"))


@query("select sensor, 0::bigint as missing, 0::bigint as not_finite, count(distinct value) as distinct_values, round(var_pop(value), 6) as variance, false as constant from (unpivot (select s1, s2, s3 from cyc) on s1, s2, s3 into name sensor value value) group by 1")
def a23_sensor_quality(s, d):
    return profile.sensor_quality(_cycles(s, d)).select("sensor", "missing", "not_finite", "distinct_values", F.round("variance", 6).alias("variance"), "constant")


WORDS = " || ',' || ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::bigint)::varchar" for k in range(8))


@query(f"select count(*) as ids, sha256(count(*)::varchar || ',' || {WORDS}) as digest from (select sha256(engine::varchar) as h from life)")
def a24_engine_set_digest(s, d):
    return compare.id_digest(_cycles(s, d), "engine")


@query()
def a24_frame_fingerprint(s, d):
    return compare.frame_fingerprint(_cycles(s, d))


@query("select split, sum(n)::bigint as rows, count(*) as engines, min(m) as min_life, quantile_cont(m, 0.5)::double as median_life, max(m) as max_life from (select split, engine, count(*) as n, max(cycle) as m from cs group by 1, 2) group by 1")
def a25_split_summary(s, d):
    return profile.split_summary(_split(s, d))


@query("select split, 'op1' as setting, min(op1) as least, max(op1) as greatest, round(avg(op1), 9) as mean, round(stddev_samp(op1), 9) as std from cs group by 1")
def a25_range_coverage(s, d):
    return profile.range_coverage(_split(s, d), R.settings).select("split", "setting", "least", "greatest", *r9("mean", "std"))


@query("select 's1' as sensor_a, 's2' as sensor_b, round(corr(s1, s2), 9) as correlation from cyc union all select 's1', 's3', round(corr(s1, s3), 9) from cyc union all select 's2', 's3', round(corr(s2, s3), 9) from cyc")
def a26_sensor_correlation(s, d):
    return profile.correlations(_cycles(s, d), R.sensors).where("sensor_a < sensor_b").select("sensor_a", "sensor_b", *r9("correlation"))


@query("select l.op_mode, l.sensor, least(floor((value - lo) * 20 / (hi - lo)) + 1, 20)::int as bin, count(*) as n from (unpivot (select op_mode, s1, s2, s3 from cyc) on s1, s2, s3 into name sensor value value) l join (select sensor, min(value) as lo, max(value) as hi from (unpivot (select s1, s2, s3 from cyc) on s1, s2, s3 into name sensor value value) group by 1) r using (sensor) group by 1, 2, 3")
def a27_sensor_histogram(s, d):
    return profile.histogram(_cycles(s, d), 20, ["op_mode"])


@query("select op_mode, sensor, min(value) as least, round(quantile_cont(value, 0.25), 4) as q1, round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.75), 4) as q3, max(value) as greatest from (unpivot (select op_mode, s1, s2, s3 from cyc) on s1, s2, s3 into name sensor value value) group by 1, 2")
def a27_regime_boxplot_stats(s, d):
    return profile.boxplot_stats(_cycles(s, d), ["op_mode"]).select("op_mode", "sensor", "least", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "greatest")


@query("select count(*) as fit_rows, count(*) filter (healthy) as healthy_rows from cs where split = 'train'")
def a28_scaler_fit_metadata(s, d):
    marked = scaling.healthy_mask(_split(s, d), R).where("split = 'train'")
    return scaling.fit_metadata(marked, scaling.fit_mode_scalers(marked.where("healthy"), R.sensors, MODES)).select("fit_rows", "healthy_rows")


# ---- windows and sequences -----------------------------------------------------------


@query("select window_id, engine, split, start_cycle, end_cycle, midpoint_cycle, max_cycle, round(life_fraction, 9) as life_fraction, label_state from meta")
def w1_window_metadata(s, d):
    return _meta(s, d).withColumn("life_fraction", F.round("life_fraction", 9))


@query("select engine, end_cycle, round(first_s1, 9) as first_s1, round(last_s3, 9) as last_s3 from (select engine, cycle as end_cycle, first(s1) over w as first_s1, s3 as last_s3 from cyc window w as (partition by engine order by cycle rows between 9 preceding and current row)) where end_cycle >= 10")
def w2_window_arrays(s, d):
    return windows.window_arrays(_cycles(s, d), R).select("engine", "end_cycle", F.round(F.col("sequence")[0][0], 9).alias("first_s1"), F.round(F.col("sequence")[9][2], 9).alias("last_s3"))


FEATS = R.features


W3 = ", ".join([f"round(avg(s{i}) over w, 6) as mean_s{i}, round(stddev_pop(s{i}) over w, 6) as std_s{i}, round(s{i} - first(s{i}) over w, 6) as slope_s{i}" for i in (1, 2, 3)])


@query(f"select printf('%s:e%03d:c%04d-%04d', split, engine, end_cycle - 9, end_cycle) as window_id, {', '.join(FEATS)} from (select engine, split, cycle as end_cycle, {W3} from tr window w as (partition by engine order by cycle rows between 9 preceding and current row)) where end_cycle >= 10")
def w3_summary_features(s, d):
    return windows.summary_features(_scaled(s, d), R, digits=6).select("window_id", *FEATS)


@query("select engine, cycle, max_cycle from cs")
def w4_entity_broadcast_aggregate(s, d):
    return scaling.healthy_mask(_cycles(s, d), R).select("engine", "cycle", "max_cycle")


@query("select detector_id, window_id, ewma_id, round(smoothed_score, 6) as smoothed_score from sm")
def w5_ewma(s, d):
    return alerts.ewma(_scores(s, d), EWMA).select("detector_id", "window_id", "ewma_id", F.round("smoothed_score", 6).alias("smoothed_score"))


@query("""select engine, cycle, segment, sum(start) over (order by engine, cycle)::bigint - 1 as state_segment_id from (select engine, cycle, sum(gap) over (partition by engine order by cycle)::int as segment, case when gap = 1 or row_number() over (partition by engine order by cycle) = 1 then 1 else 0 end as start
from (select engine, cycle, case when cycle - lag(cycle) over (partition by engine order by cycle) > 1 then 1 else 0 end as gap from cyc where cycle % 11 <> 0))""")
def w6_segments(s, d):
    c = _cycles(s, d).where("cycle % 11 <> 0").withColumnRenamed("cycle", "end_cycle")
    out = alerts.state_segment_id(alerts.segments(c, []), [])
    return out.select("engine", F.col("end_cycle").alias("cycle"), "segment", "state_segment_id")


@query("select detector_id, window_id, v as threshold_violation, persistence_count, alert_active from act")
def w7_persistence(s, d):
    return _trace(s, d).select("detector_id", "window_id", "threshold_violation", "persistence_count", "alert_active")


@query("select detector_id, window_id, round(smoothed_score, 6) as smoothed_score, round(threshold, 6) as threshold, alert_active, dense_rank() over (partition by detector_id order by engine) - 1 as state_segment_id from act")
def w8_apply_alert_policy(s, d):
    return _trace(s, d).select("detector_id", "window_id", F.round("smoothed_score", 6).alias("smoothed_score"), F.round("threshold", 6).alias("threshold"), "alert_active", "state_segment_id")


@query("select detector_id, engine, printf('engine_%d_event_%03d', engine, event_number) as event_id, event_start_cycle, event_end_cycle, event_duration_endpoints from events3")
def w9_alert_events(s, d):
    return alerts.alert_events(_trace(s, d)).select("detector_id", "engine", "event_id", "event_start_cycle", "event_end_cycle", "event_duration_endpoints")


@query("select a.detector_id, a.window_id, e.event_number is not null as event_start, case when e.event_number is not null then printf('engine_%d_event_%03d', a.engine, e.event_number) when alert_active then 'active' else 'none' end as event_status from act a left join events3 e on e.detector_id = a.detector_id and e.engine = a.engine and e.event_start_cycle = a.end_cycle")
def w10_event_flags(s, d):
    t = _trace(s, d)
    return alerts.event_flags(t, alerts.alert_events(t)).select("detector_id", "window_id", "event_start", "event_status")


@query("select engine, stratum from strat")
def w11_life_strata(s, d):
    return splits.life_strata(splits.summarize_entities(_cycles(s, d))).select("engine", "stratum")


# Fixed components, so that attribution has SQL: the first three unit vectors.
FIXED_PCA = detectors.PCA(np.zeros(9), np.eye(9)[:3])
CONTRIB = """, con as (select window_id, (0 + std_s1 * std_s1 + slope_s1 * slope_s1) / 9 as c1, (0 + std_s2 * std_s2 + slope_s2 * slope_s2) / 9 as c2, (0 + std_s3 * std_s3 + slope_s3 * slope_s3) / 9 as c3 from zf),
lc as (select window_id, c1 + c2 + c3 as raw, unnest(['s1', 's2', 's3']) as sensor, unnest([c1, c2, c3]) as c, unnest([0, 1, 2]) as place from con)"""


def _attributed(s, d):
    z = study.standardized_features(_features(s, d))
    return detectors.attribute_pca(z, R.features, R.sensors, FIXED_PCA)


@query(CONTRIB + " select window_id, sensor, row_number() over (partition by window_id order by c desc, place)::int as rank from lc")
def w12_rank_contributions(s, d):
    return _attributed(s, d).select("window_id", F.inline("contributions")).select("window_id", "sensor", "rank")


# ---- selection -----------------------------------------------------------------------


@query("select engine, cycle, s1 from (select *, row_number() over (partition by engine order by s1 desc, cycle) as r from cyc) where r = 1")
def top1_select_best(s, d):
    return selection.select_best(_cycles(s, d), ["engine"], [F.desc("s1"), F.asc("cycle")]).select("engine", "cycle", "s1")


def _study(s, d):
    return study.alert_policy_study(_scores(s, d), GRID)


GRID_SQL = """, vsc as (select * from sm where split = 'validation'),
gv as (select s.detector_id, s.ewma_id, t.context, t.rule_id, s.engine, s.window_id, s.start_cycle, s.end_cycle, s.smoothed_score > t.threshold as v from vsc s join thr t on t.detector_id = s.detector_id and (t.op_mode is null or t.op_mode = s.op_mode)),
gt as (select *, case when v then row_number() over (partition by detector_id, ewma_id, context, rule_id, engine, isl, v order by end_cycle) else 0 end as pc from (select *, sum((not v)::int) over (partition by detector_id, ewma_id, context, rule_id, engine order by end_cycle) as isl from gv)),
ga as (select g.*, m.m as persistence, pc >= m.m as act from gt g cross join (values (1), (3), (5), (8)) m(m)),
gc as (select detector_id, ewma_id, context, rule_id, persistence, policy_id, count(*) filter (act and proxy_label = 1) as tp, count(*) filter (act and proxy_label = 0) as fp, count(*) filter (not act and proxy_label = 0) as tn, count(*) filter (not act and proxy_label = 1) as fn from ga join lab using (window_id) where proxy_label is not null group by 1, 2, 3, 4, 5, 6),
ge as (select detector_id, ewma_id, context, rule_id, persistence, engine, min(end_cycle) as es, max(end_cycle) as ee from (select *, end_cycle - row_number() over (partition by detector_id, ewma_id, context, rule_id, persistence, engine order by end_cycle) as k from ga where act) group by 1, 2, 3, 4, 5, engine, k),
gk as (select distinct detector_id, ewma_id, context, rule_id, persistence from ga),
go as (select k.*, o.policy_id, o.engine, any_value(o.onset_cycle) as onset_cycle, any_value(o.max_cycle) as max_cycle, min(case when es >= o.onset_cycle then es end) as first_detection, count(*) filter (es < o.onset_cycle) as false_events
  from gk k cross join (select ons.* from ons join spl using (engine) where split = 'validation') o left join ge e on e.detector_id = k.detector_id and e.ewma_id = k.ewma_id and e.context = k.context and e.rule_id = k.rule_id and e.persistence = k.persistence and e.engine = o.engine group by k.detector_id, k.ewma_id, k.context, k.rule_id, k.persistence, o.policy_id, o.engine),
gm as (select detector_id || '__' || context || '__' || rule_id || '__ewma_' || ewma_id || '__persistence_' || persistence as candidate_id, detector_id, policy_id, engine_count, detected_engines, false_events, false_alert_engines, median_delay, median_lead, tp, fp, tn, fn,
  100 * detected_engines::double / engine_count as coverage_percent, 1000 * fp::double / nullif(fp + tn, 0) as fp_per_1000_healthy, 1000 * false_events::double / nullif(fp + tn, 0) as false_events_per_1000_healthy, 100 * false_alert_engines::double / engine_count as false_alert_engine_percent
  from gc join (select detector_id, ewma_id, context, rule_id, persistence, policy_id, count(*) as engine_count, count(first_detection) as detected_engines, sum(false_events)::bigint as false_events, count(*) filter (false_events > 0) as false_alert_engines, quantile_cont(first_detection - onset_cycle, 0.5)::double as median_delay, quantile_cont(max_cycle - first_detection, 0.5)::double as median_lead from go group by 1, 2, 3, 4, 5, 6) using (detector_id, ewma_id, context, rule_id, persistence, policy_id)),
gg as (select candidate_id, any_value(detector_id) as detector_id, min(coverage_percent) as min_coverage, avg(coverage_percent) as mean_coverage, max(fp_per_1000_healthy) as worst_fp, max(false_events_per_1000_healthy) as worst_fe, max(false_alert_engine_percent) as worst_en, case when count(median_delay) = 3 then median(median_delay) end as delay, case when count(median_lead) = 3 then median(median_lead) end as lead
  from gm join pol using (policy_id) where selection_policy group by 1),
gb as (select *, row_number() over (partition by detector_id order by min_coverage desc, round(mean_coverage, 9) desc, worst_fe, worst_en, delay nulls last, lead desc nulls last, candidate_id) as r from gg where worst_fp <= 60)"""


@query(GRID_SQL + " select detector_id, candidate_id, round(min_coverage, 6) as min_coverage, round(worst_fp, 6) as worst_fp_per_1000 from gb where r = 1")
def top2_select_best_candidates(s, d):
    return _study(s, d).best_per_detector.select("detector_id", "candidate_id", F.round("min_coverage", 6).alias("min_coverage"), F.round("worst_fp_per_1000", 6).alias("worst_fp_per_1000"))


@query(CONTRIB + " select window_id, sensor, round(c, 6) as contribution, rank from (select *, row_number() over (partition by window_id order by c desc, place)::int as rank from lc) where rank <= 2")
def top3_top_sensors(s, d):
    out = _attributed(s, d).select("window_id", F.inline(F.slice("contributions", 1, 2)))
    return out.select("window_id", "sensor", F.round("contribution", 6).alias("contribution"), "rank")


@query("""select engine, max_cycle, min(rank) as rank from (select rank, engine, max_cycle, row_number() over (partition by rank order by abs(max_cycle - target), engine) as r from life cross join (select unnest([0, 1, 2, 3, 4]) as rank, unnest([quantile_cont(max_cycle, 0), quantile_cont(max_cycle, 0.25), quantile_cont(max_cycle, 0.5), quantile_cont(max_cycle, 0.75), quantile_cont(max_cycle, 1)]) as target from life)) where r = 1 group by 1, 2""")
def top4_representative_entities(s, d):
    return selection.representative_entities(splits.summarize_entities(_cycles(s, d)), [0.0, 0.25, 0.5, 0.75, 1.0])


@query("select engine, cycle, (row_number() over (partition by engine order by cycle))::int as place from cyc")
def top5_chronological_order(s, d):
    return _cycles(s, d).select("engine", "cycle", F.row_number().over(Window.partitionBy("engine").orderBy("cycle")).alias("place"))


# ---- sets ----------------------------------------------------------------------------


@query("select split, engine, cycle from cs where split = 'train' union all select split, engine, cycle from cs where split = 'test'")
def set1_union_all(s, d):
    c = _split(s, d).select("split", "engine", "cycle")
    return c.where("split = 'train'").unionByName(c.where("split = 'test'"))


@query("select distinct user_id as engine from events where event_type = 'click' intersect select user_id from events where event_type = 'purchase'")
def set2_intersect(s, d):
    c = _cycles(s, d)
    return c.where("op_mode = 0").select("engine").intersect(c.where("op_mode = 2").select("engine"))


@query("select engine, cycle from cyc except select engine, cycle from cyc where op_mode = 1")
def set3_except(s, d):
    c = _cycles(s, d)
    return c.select("engine", "cycle").subtract(c.where("op_mode = 1").select("engine", "cycle"))


# ---- scalars -------------------------------------------------------------------------


@query("select window_id from meta")
def sc1_window_ids(s, d):
    m = _meta(s, d)
    return m.select(scalars.window_id(F.col("split"), F.col("engine"), F.col("start_cycle"), F.col("end_cycle")).alias("window_id"))


@query("select engine, 'normalized_life_last_' || round(onset_fraction * 100)::int || 'pct_' || policy_semantics as policy_id from life cross join pol")
def sc2_policy_ids(s, d):
    p = proxies.policy_table(s)
    return splits.summarize_entities(_cycles(s, d)).crossJoin(F.broadcast(p)).select("engine", scalars.policy_id(F.col("policy_semantics"), F.col("onset_fraction")).alias("policy_id"))


@query("select engine, cycle, floor(s1)::bigint as floor_s1, round(sqrt(s1 * s1 + s2 * s2 + s3 * s3), 9) as norm from cyc")
def sc3_numbers(s, d):
    v = F.array("s1", "s2", "s3")
    return _cycles(s, d).select("engine", "cycle", F.floor("s1").alias("floor_s1"), F.round(scalars.norm(v), 9).alias("norm"))


@query("select event_id, sha256(event_type || ':' || event_id) as digest from events", on_chain=False)
def sc4_sha256(s, d):
    ev = s.read.parquet(f"{d}/events.parquet")
    return ev.select("event_id", F.sha2(F.concat_ws(":", "event_type", F.col("event_id").cast("string")), 256).alias("digest"))


@query("select event_id, json_extract_string(props, '$.k')::double as k, '{\"k\":' || json_extract_string(props, '$.k') || '}' as encoded from events", on_chain=False)
def sc5_json(s, d):
    ev = s.read.parquet(f"{d}/events.parquet").withColumn("p", F.from_json("props", "k long"))
    return ev.select("event_id", F.col("p.k").cast("double").alias("k"), F.to_json("p").alias("encoded"))


@query("select event_id, regexp_matches(sha256(event_type), '^[0-9a-f]{64}$') as digest_ok, regexp_matches(event_type, '^p') as starts_p from events", on_chain=False)
def sc6_regex(s, d):
    ev = s.read.parquet(f"{d}/events.parquet")
    return ev.select("event_id", scalars.is_digest(F.sha2("event_type", 256)).alias("digest_ok"), F.col("event_type").rlike("^p").alias("starts_p"))


@query("select event_id, value > 50 as undefined from events", on_chain=False)
def sc7_undefined(s, d):
    ev = s.read.parquet(f"{d}/events.parquet")
    x = F.when(F.col("value") > 100, F.lit(float("nan"))).when(F.col("value") > 75, F.lit(float("inf"))).when(F.col("value") <= 50, F.col("value"))
    return ev.select("event_id", scalars.undefined(x).alias("undefined"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / 64, 9) as mean_square from embeddings", on_chain=False)
def sc8_array_reductions(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.round(scalars.array_mean_square(F.col("embedding")), 9).alias("mean_square"))


# ---- regimes, detectors, studies -----------------------------------------------------


@query("select engine, cycle_count, max_cycle, stratum, split from spl")
def ml1_stratified_entity_split(s, d):
    return _assigned(s, d)


MONITOR = """, ms as (select engine, any_value(max_cycle) as max_cycle from meta where split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double) group by 1),
mst as (select engine, greatest(ceil(((r - 1) * 5)::double / greatest(t - 1, 1)) - 1, 0)::int as stratum from (select *, row_number() over (order by max_cycle, engine) as r, count(*) over () as t from ms)),
mq as (select stratum, floor(e1) as f1, e1 - floor(e1) as r1, e2 - floor(e2) as r2, n - floor(e1) - floor(e2) as rest from (select stratum, count(*) as n, round(count(*) * 0.8::double, 9) as e1, round(count(*) * 0.2::double, 9) as e2 from mst group by 1)),
mr as (select engine, case when i <= f1 + ((r2 > r1)::int < rest)::int then 'development' else 'monitor' end as role from (select *, row_number() over (partition by stratum order by md5(engine::varchar || ':43'), engine) as i from mst) join mq using (stratum))
select window_id, role from meta join mr using (engine) where split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double)"""


@query(MONITOR)
def ml2_monitor_split(s, d):
    m = _meta(s, d)
    return splits.monitor_split(m.where((F.col("split") == "train") & proxies.eligible())).select("window_id", "role")


@query()
def ml3_fit_regimes(s, d):
    c = _split(s, d)
    return regimes.assign_regime(c.drop("op_mode"), R.settings, regimes.fit_regimes(c.where("split = 'train'"), R.settings, 4)).select("engine", "cycle", "op_mode")


@query(f"select engine, cycle, (list_position([(op1 - 2) ^ 2, (op1 - 7) ^ 2, (op1 - 12) ^ 2, (op1 - 17) ^ 2, (op1 - 22) ^ 2], {NEAREST}) - 1)::int as op_mode from cyc")
def ml4_assign_regime(s, d):
    return regimes.assign_regime(_cycles(s, d), R.settings, CENTERS).select("engine", "cycle", "op_mode")


@query("select engine, cycle, -1 as op_mode, round((s1 - m1) / d1, 9) as s1, round((s2 - m2) / d2, 9) as s2, round((s3 - m3) / d3, 9) as s3 from cs cross join gscal")
def ml5_transform_global(s, d):
    c = _split(s, d)
    marked = scaling.healthy_mask(c, R)
    scaler = scaling.fit_global_scaler(marked.where("split = 'train' and healthy"), R.sensors)
    return scaling.transform_global(c, scaler, R.sensors).select("engine", "cycle", "op_mode", *r9("s1", "s2", "s3"))


@query("select engine, cycle, op_mode, round(s1, 9) as s1, round(s2, 9) as s2, round(s3, 9) as s3 from tr")
def ml6_transform_regime(s, d):
    return _scaled(s, d).select("engine", "cycle", "op_mode", *r9("s1", "s2", "s3"))


@query()
def ml7_regime_stability(s, d):
    c = _split(s, d)
    return regimes.regime_stability(c.where("split = 'train'"), c.where("split = 'validation'"), R.settings, 4)


_PREPROCESSING: dict[tuple[str, str], study.PreprocessingStudy] = {}


def _preprocessing(s, d):
    key = (s.sparkContext.applicationId, d)
    if key not in _PREPROCESSING:
        _PREPROCESSING[key] = study.preprocessing_study(_split(s, d).drop("op_mode"), (4, 6, 8))
    return _PREPROCESSING[key]


@query()
def ml8_preprocessing_study(s, d):
    return _preprocessing(s, d).selection


@query()
def ml8_mode_occupancy(s, d):
    return _preprocessing(s, d).occupancy


@query()
def ml8_mode_centroids(s, d):
    return _preprocessing(s, d).centroids


@query("select window_id, round(mean_s1, 6) as mean_s1, round(std_s2, 6) as std_s2, round(slope_s3, 6) as slope_s3 from zf")
def ml9_feature_scaler(s, d):
    return study.standardized_features(_features(s, d)).select("window_id", *[F.round(c, 6).alias(c) for c in ("mean_s1", "std_s2", "slope_s3")])


WINDOW_COLUMNS = ["window_id", "engine", "split", "start_cycle", "end_cycle", "max_cycle", "op_mode"]


def _detector(s, d, name, **params):
    f = _features(s, d).select(*R.features, *WINDOW_COLUMNS)
    out = detectors.fit_score(study.eligible_training(f), f, R.features, name, **params)
    return out.select("window_id", "detector_id", "raw_score", "alert_score")


@query()
def ml10_pca_detector(s, d):
    return _detector(s, d, "pca", variance=0.9)


@query()
def ml10_pca_embeddings(s, d):
    cols, e = [f"e{i}" for i in range(64)], _embedding(s, d)
    return detectors.score_pca(e, cols, detectors.fit_pca(e, cols, 0.9)).select("vec_id", "label", "raw_score")


@query()
def ml11_isolation_forest(s, d):
    return _detector(s, d, "isolation_forest")


# Outlier factors by comparing every window with every training window.
APART = "sqrt(" + " + ".join(f"(a.{f} - b.{f}) ** 2" for f in FEATS) + ")"
LOF_SQL = f""", lr as (select * from zf where split = 'train' and end_cycle <= floor(max_cycle::double * 0.3::double)),
ln as (select * from (select *, row_number() over (partition by a order by d, b) as r from (select a.window_id as a, b.window_id as b, {APART} as d from lr a cross join lr b where a.window_id <> b.window_id)) where r <= 20),
lk as (select a as id, max(d) as kd from ln group by 1),
ll as (select n.a as id, 1 / (avg(greatest(d, kd)) + 1e-10::double) as lrd from ln n join lk k on k.id = n.b group by 1),
qn as (select * from (select *, row_number() over (partition by a order by d, b) as r from (select a.window_id as a, b.window_id as b, {APART} as d from zf a cross join lr b)) where r <= 20),
lof as (select n.a as window_id, round(avg(lrd) * (avg(greatest(d, kd)) + 1e-10::double), 9) as raw from qn n join lk k on k.id = n.b join ll l on l.id = n.b group by 1),
lc as (select raw, max(k) as upto from (select raw, row_number() over (order by raw) as k from lof semi join lr using (window_id)) group by 1)
select window_id, 'lof' as detector_id, l.raw as raw_score, round(coalesce(upto, 0)::double / (select count(*) from lr), 6) as alert_score from lof l asof left join lc c on l.raw >= c.raw"""


@query(LOF_SQL)
def ml12_lof_novelty(s, d):
    out = _detector(s, d, "lof", neighbors=20)
    return out.select("window_id", "detector_id", "raw_score", F.round("alert_score", 6).alias("alert_score"))


@query()
def ml13_one_class_kernel(s, d):
    return _detector(s, d, "one_class")


@query()
def ml14_fit_score_detector(s, d):
    return _detector(s, d, "pca", variance=0.99)


@query()
def ml15_detector_study(s, d):
    c = _split(s, d)
    prepared = {"global": windows.summary_features(study.transformed_global(c), R), "per_mode": _features(s, d)}
    return study.detector_study(prepared).best


@query(CONTRIB + " select window_id, sensor, round(c, 6) as contribution, round(case when raw > 0 then c / raw else 0 end, 6) as share, true as complete from lc")
def ml16_pca_attribution(s, d):
    out = _attributed(s, d).select("window_id", (F.col("completeness_error") < 1e-9).alias("complete"), F.inline("contributions"))
    return out.select("window_id", "sensor", F.round("contribution", 6).alias("contribution"), F.round("share", 6).alias("share"), "complete")


@query("select engine, end_cycle, round((v1 + v2 + v3) / 3, 6) as raw_score from (select engine, cycle as end_cycle, var_pop(s1) over w as v1, var_pop(s2) over w as v2, var_pop(s3) over w as v3 from cyc window w as (partition by engine order by cycle rows between 9 preceding and current row)) where end_cycle >= 10")
def ml17_score_windows_with(s, d):
    seq = windows.window_arrays(_cycles(s, d), R)
    out = detectors.score_windows_with(seq, lambda x: np.repeat(x.mean(axis=1, keepdims=True), x.shape[1], axis=1))
    return out.select("engine", "end_cycle", F.round("raw_score", 6).alias("raw_score"))


_WHOLE_STUDY: dict[tuple[str, str], tuple[study.Study, study.Winners]] = {}
WHOLE_GRID = Grid(detectors=study.SOURCES)


@stage
def _whole_scores(s, d):
    return study.score_frame(_split(s, d), MODES, sources=study.SOURCES)


def _whole_study(s, d):
    """The study of all five sources; its winners' tables are made once one of them is asked for."""
    key = (s.sparkContext.applicationId, d)
    if key not in _WHOLE_STUDY:
        _WHOLE_STUDY[key] = study.alert_policy_study(_whole_scores(s, d), WHOLE_GRID)
    return _WHOLE_STUDY[key]


def _winners(s, d):
    key = (s.sparkContext.applicationId, d, "winners")
    if key not in _WHOLE_STUDY:
        _WHOLE_STUDY[key] = study.winners(_whole_scores(s, d), _whole_study(s, d), WHOLE_GRID)
    return _WHOLE_STUDY[key]


WINNERS_SQL = GRID_SQL + """, win as (select k.*, candidate_id, row_number() over (order by min_coverage desc, round(mean_coverage, 9) desc, worst_fe, worst_en, delay nulls last, lead desc nulls last, candidate_id) = 1 as overall
  from gb join gk k on candidate_id = k.detector_id || '__' || context || '__' || rule_id || '__ewma_' || ewma_id || '__persistence_' || persistence where r = 1),
wt as (select w.candidate_id, w.overall, w.persistence, s.*, t.threshold, smoothed_score > t.threshold as v from vsc s join win w on w.detector_id = s.detector_id and w.ewma_id = s.ewma_id join thr t on t.detector_id = w.detector_id and t.context = w.context and t.rule_id = w.rule_id and (t.op_mode is null or t.op_mode = s.op_mode)),
wa as (select *, persistence_count >= persistence as alert_active from (select *, case when v then row_number() over (partition by candidate_id, engine, isl, v order by end_cycle) else 0 end::int as persistence_count
  from (select *, sum((not v)::int) over (partition by candidate_id, engine order by end_cycle) as isl from wt))),
we as (select *, row_number() over (partition by candidate_id, engine order by event_start_cycle)::int as event_number from (select candidate_id, overall, detector_id, engine, min(end_cycle) as event_start_cycle, max(end_cycle) as event_end_cycle, count(*) as event_duration_endpoints
  from (select *, end_cycle - row_number() over (partition by candidate_id, engine order by end_cycle) as g from wa where alert_active) group by 1, 2, 3, 4, g)),
wo as (select w.candidate_id, w.overall, w.detector_id, o.policy_id, o.engine, any_value(onset_cycle) as onset_cycle, any_value(max_cycle) as max_cycle, min(case when event_start_cycle >= onset_cycle then event_start_cycle end) as first_detection,
  count(*) filter (event_start_cycle < onset_cycle) as false_events, count(*) filter (event_start_cycle < onset_cycle and event_end_cycle >= onset_cycle) as crossing_events, count(*) filter (event_start_cycle >= onset_cycle) as detection_events
  from win w cross join (select ons.* from ons join spl using (engine) where split = 'validation') o left join we e on e.candidate_id = w.candidate_id and e.engine = o.engine group by 1, 2, 3, 4, 5)"""
CELLS = {"both": "{a} and {b}", "only_a": "{a} and not {b}", "only_b": "not {a} and {b}", "neither": "not {a} and not {b}"}
CELLS_SQL = ", ".join(f"count(*) filter ({c.format(a='(a.' + x + ')', b='(b.' + x + ')')}) as {n}_{k}" for n, x in (("detected", "detected"), ("false_alert", "false_alert")) for k, c in CELLS.items())


@query(GRID_SQL + """ select candidate_id, policy_id, engine_count, detected_engines, false_events, false_alert_engines, median_delay, median_lead, tp, fp, tn, fn,
round(coverage_percent, 6) as coverage_percent, round(fp_per_1000_healthy, 6) as fp_per_1000_healthy from gm""", sources=study.SOURCES)
def ml18_alert_policy_study(s, d):
    cols = ["candidate_id", "policy_id", "engine_count", "detected_engines", "false_events", "false_alert_engines", "median_delay", "median_lead", "tp", "fp", "tn", "fn"]
    return _whole_study(s, d).metrics.select(*cols, F.round("coverage_percent", 6).alias("coverage_percent"), F.round("fp_per_1000_healthy", 6).alias("fp_per_1000_healthy"))


@query(WINNERS_SQL + """ select candidate_id, overall, window_id, round(smoothed_score, 6) as smoothed_score, round(threshold, 6) as threshold, v as threshold_violation, persistence_count, alert_active,
dense_rank() over (partition by candidate_id order by engine) - 1 as state_segment_id from wa""", sources=study.SOURCES)
def ml18_winner_traces(s, d):
    t = _winners(s, d).traces
    return t.select("candidate_id", "overall", "window_id", F.round("smoothed_score", 6).alias("smoothed_score"), F.round("threshold", 6).alias("threshold"), "threshold_violation", "persistence_count", "alert_active", "state_segment_id")


@query(WINNERS_SQL + " select candidate_id, overall, engine, event_number, event_start_cycle, event_end_cycle, event_duration_endpoints from we", sources=study.SOURCES)
def ml18_winner_events(s, d):
    return _winners(s, d).events.select("candidate_id", "overall", "engine", "event_number", "event_start_cycle", "event_end_cycle", "event_duration_endpoints")


@query(WINNERS_SQL + """ select candidate_id, overall, policy_id, engine, onset_cycle, max_cycle, first_detection, false_events, crossing_events, detection_events,
first_detection - onset_cycle as detection_delay, max_cycle - first_detection as lead_time from wo""", sources=study.SOURCES)
def ml18_winner_engines(s, d):
    return _winners(s, d).entities.drop("detected", "detector_id")


@query(WINNERS_SQL + f""", wd as (select *, first_detection is not null as detected, false_events > 0 as false_alert from wo join pol using (policy_id) where selection_policy)
select policy_id, a.detector_id as detector_a, b.detector_id as detector_b, count(*) as engine_count, {CELLS_SQL} from wd a join wd b using (policy_id, engine) where a.detector_id < b.detector_id group by 1, 2, 3""", sources=study.SOURCES)
def ml18_complementarity(s, d):
    return _winners(s, d).complementarity


@query(WINNERS_SQL + """ select candidate_id, policy_id, round(fp_per_1000_healthy, 6) as fp_per_1000_healthy, coalesce(fp_per_1000_healthy <= 60, false) as meets_fp_limit, median_delay, coalesce(median_delay <= 12, false) as meets_delay, 'feasible' as status
from gm join (select candidate_id from win where overall) using (candidate_id) join pol using (policy_id) where selection_policy
union all select null, null, null, false, null, false, 'no_feasible_candidate' where not exists (select * from win)""", sources=study.SOURCES)
def ml18_targets(s, d):
    return _winners(s, d).targets.withColumn("fp_per_1000_healthy", F.round("fp_per_1000_healthy", 6))


@query(METRICS + RANK_SQL + " select pmc.detector_id, pmc.policy_id, coverage_percent, tp, fp, tn, fn, round(average_precision, 6) as average_precision from pmc join rk using (detector_id, policy_id)")
def ml19_evaluate_detector(s, d):
    e = _evaluated(s, d)
    return e["metrics"].join(e["ranking"].select("detector_id", "policy_id", "average_precision"), ["detector_id", "policy_id"]).select("detector_id", "policy_id", *r9("coverage_percent"), "tp", "fp", "tn", "fn", F.round("average_precision", 6).alias("average_precision"))


def _new_cycles(s, d):
    """Validation cycles of the entities that are long enough for a window, which scoring asks for."""
    c = _split(s, d).where("split = 'validation'")
    return c.join(c.groupBy("engine").count().where(F.col("count") >= R.window).select("engine"), "engine", "left_semi")


@query()
def ml20_infer(s, d):
    rows, _ = study.infer(_new_cycles(s, d), study.fit_inference(_split(s, d), MODES, m=3, rule_id="quantile_0.950"))
    top = "top_three_sensor_contributions"
    return study.timeline(rows).withColumn(top, F.to_json(top))


# Stored tables in which some cells were altered: each must be found, and nothing else.
REPRODUCED = """select * from (select 'scores' as "table", (select count(*) from meta) as rows, "column", 0::bigint as only_left, 0::bigint as only_right, case when "column" = 'raw_score' then (select count(*) from meta where window_id like '%7') else 0 end as mismatches from (select unnest(['raw_score', 'alert_score']) as "column")
union all select 'ranking', (select count(*) from pol), "column", 0, 0, case when "column" = 'positives' then 1 else 0 end from (select unnest(['positives', 'negatives', 'ambiguous', 'average_precision', 'roc_auc']) as "column"))"""


@query(REPRODUCED)
def ml21_reproduce_scores(s, d):
    f = _features(s, d).select(*R.features, *WINDOW_COLUMNS)
    scores, ranking = study.scored_and_ranked(f, "pca", {"variance": 0.9})
    scores = scores.withColumn("raw_score", F.when(F.col("window_id").like("%7"), F.col("raw_score") + 0.5).otherwise(F.col("raw_score")))
    ranking = ranking.withColumn("positives", F.when(F.col("policy_id").like("%10pct%"), F.col("positives") + 1).otherwise(F.col("positives")))
    kept, key = Store(s, scratch(s, "store")), table_key("pca", {"features": f}, {"variance": 0.9})
    kept.put(f"scores-{key}", scores)
    kept.put(f"ranking-{key}", ranking)
    # Another dealing of the rows, of which the key is the same and so must the scores be.
    dealt = f.repartition(5, "end_cycle")
    again = table_key("pca", {"features": dealt}, {"variance": 0.9})
    found = study.reproduce_scores(kept.get(f"scores-{again}"), kept.get(f"ranking-{again}"), dealt, "pca", {"variance": 0.9})
    return found.select("table", "column", "rows", "only_left", "only_right", "mismatches")


VERIFIED = """select "table", "column", each * n as rows, 0::bigint as only_left, 0::bigint as only_right, case "column" when 'tp' then 5 * (n // 4) when 'feasible' then n // 4 else 0 end as mismatches
from (values ('aggregated', 1, 'detector_id'), ('aggregated', 1, 'feasible'), ('aggregated', 1, 'min_coverage'), ('aggregated', 1, 'worst_fp_per_1000'),
('metrics', 5, 'tp'), ('metrics', 5, 'fp'), ('metrics', 5, 'tn'), ('metrics', 5, 'fn'), ('metrics', 5, 'detected_engines'), ('metrics', 5, 'coverage_percent'), ('metrics', 5, 'fp_per_1000_healthy')) v("table", each, "column"),
(select count(*) as n from (select distinct detector_id, context from lists) c cross join rules cross join (values (1), (2), (3), (4)) a(e) cross join (values (1), (3), (5), (8)) m(m))"""


@query(VERIFIED)
def ml22_verify_study(s, d):
    saved = _scores(s, d)
    made = study.alert_policy_study(saved, GRID)
    eight = F.col("candidate_id").like("%persistence_8")
    altered = {"aggregated": made.aggregated.withColumn("feasible", F.col("feasible") != eight), "metrics": made.metrics.withColumn("tp", F.col("tp") + eight.cast("int"))}
    kept, key = Store(s, scratch(s, "store")), table_key("study", {"scores": saved}, {"grid": "energy, peak"})
    for name, table in altered.items():
        kept.put(f"{name}-{key}", table)
    found = study.verify_study(saved.repartition(5, "end_cycle"), GRID, {name: kept.get(f"{name}-{key}") for name in altered})
    return found.select("table", "column", "rows", "only_left", "only_right", "mismatches")


@query("select engine, cycle, s1 from cyc order by md5('7:' || engine::varchar || ':' || cycle::varchar), engine, cycle limit 500")
def ml23_sample_rows(s, d):
    return splits.sample_rows(_cycles(s, d), 500, 7, ["engine", "cycle"]).select("engine", "cycle", "s1")


@query()
def str1_stream_alerts(s, d):
    from ..streaming.alerts import stream_to_table

    c = _split(s, d)
    return stream_to_table(c.where("split = 'validation'"), study.fit_inference(c, MODES, m=3, rule_id="quantile_0.950"), R)


@query("""select engine, kind, count(*) as rows from (select engine, 'window' as kind from cs where split = 'validation' and cycle >= 10
union all select engine, 'late' from cs where split = 'validation' and cycle % 9 = 0 union all select engine, 'bad' from cs where split = 'validation' and cycle <= 2) group by 1, 2""")
def str1_stream_side_rows(s, d):
    """Repeated cycles a batch later, and cycles zero and null: all are told apart and counted."""
    from ..streaming.alerts import stream_to_table

    c = _split(s, d)
    rows = c.where("split = 'validation'")
    batch = F.floor((F.col("cycle") - 1) / 30)
    odd = rows.where("cycle <= 2").withColumn("cycle", F.when(F.col("cycle") == 1, 0))
    part = lambda df, at: df.withColumn("arrival", at.cast("int"))
    given = part(rows, batch).unionByName(part(rows.where("cycle % 9 = 0"), batch + 1)).unionByName(part(odd, F.lit(0)))
    out = stream_to_table(given, study.fit_inference(c, MODES, m=3, rule_id="quantile_0.950"), R, files=5, arrival=F.col("arrival"))
    return out.where("kind <> 'event'").groupBy("engine", "kind").agg(F.count("*").alias("rows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


