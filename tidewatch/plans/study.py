"""The data flow as whole jobs: preparation, scoring, the alert-policy grid, evaluation, inference."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import alerts, calibration, checks, compare, detectors, metrics, proxies, regimes, scaling, selection, splits, thresholds, windows
from ..operators.detectors import PCA, attribute_pca, score_pca
from ..schema import DETECTOR_GRID, EXPLANATION, RULES, Grid, Roles
from ..sources.scratch import cut


def split_cycles(cycles: DataFrame, seed: int = 42, roles: Roles = Roles()) -> DataFrame:
    """Cycles with the split of their entity."""
    summary = cut(splits.summarize_entities(cycles, roles), "summary")
    assigned = splits.stratified_split(summary, seed=seed, roles=roles)
    return cut(cycles.join(assigned.select(roles.entity, roles.split), roles.entity), "cycles")


def transformed(cycles: DataFrame, modes: int, roles: Roles = Roles(), least: int = 30) -> DataFrame:
    """Cycles of all splits, scaled by mode with parameters of healthy training rows."""
    marked = scaling.healthy_mask(cycles, roles)
    fit = marked.where(f"{roles.split} = 'train' and healthy")
    scalers = cut(scaling.fit_mode_scalers(fit, roles.sensors, modes, least, roles), "scalers")
    return scaling.transform_modes(cycles, scalers, roles.sensors, roles)


def transformed_global(cycles: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Cycles of all splits, scaled by one set of parameters of healthy training rows."""
    fit = scaling.healthy_mask(cycles, roles).where(f"{roles.split} = 'train' and healthy")
    scaler = cut(scaling.fit_global_scaler(fit, roles.sensors), "scaler")
    return scaling.transform_global(cycles, scaler, roles.sensors, roles)


def eligible_training(features: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return features.where((F.col(roles.split) == "train") & proxies.eligible(roles))


def standardized_features(features: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Features scaled by the eligible training windows (one row of parameters, broadcast)."""
    scaler = cut(scaling.fit_global_scaler(eligible_training(features, roles), roles.features), "feature_scaler")
    return scaling._scaled(features.crossJoin(F.broadcast(scaler)), roles.features)


#: Reference-free score sources: mean squares of standardized features by kind, and the greatest size of any.
SOURCES = ("energy", "peak", "level", "spread", "drift")


def energy_scores(features: DataFrame, roles: Roles = Roles(), digits: int = 9, sources: Sequence[str] = ("energy", "peak")) -> DataFrame:
    """Scores of reference-free detectors, all from one pass over standardized features.

    ``energy``: their mean square; ``peak``: their greatest size; ``level``, ``spread`` and
    ``drift``: the mean square of window means, deviations and slopes alone.
    """
    z = standardized_features(features, roles)
    n = len(roles.sensors)
    mean = lambda names: sum((F.col(c) * F.col(c) for c in names[1:]), F.col(names[0]) * F.col(names[0])) / F.lit(float(len(names)))
    made = {"energy": mean(roles.features), "peak": F.greatest(*[F.abs(F.col(c)) for c in roles.features])}
    made |= {k: mean(roles.features[i * n : (i + 1) * n]) for i, k in enumerate(("level", "spread", "drift"))}
    ids = ["window_id", roles.entity, roles.split, "start_cycle", "end_cycle", "max_cycle", roles.mode]
    return z.select(*ids, F.inline(F.array(*[F.struct(F.lit(k).alias("detector_id"), F.round(made[k], digits).alias("raw_score")) for k in sources])))


def score_frame(cycles: DataFrame, modes: int, roles: Roles = Roles(), sources: Sequence[str] = ("energy", "peak")) -> DataFrame:
    """Calibrated scores of every window and detector: the whole chain up to alert_score."""
    features = cut(windows.summary_features(transformed(cycles, modes, roles), roles), "features")
    raw = cut(energy_scores(features, roles, sources=sources), "raw")
    return cut(calibration.ecdf(eligible_training(raw, roles), raw), "scores")


def alert_trace(scores: DataFrame, alpha: float | None = 0.2, m: int = 3, context: str = "per_mode", rule_id: str = "quantile_0.950", roles: Roles = Roles()) -> DataFrame:
    """Traces of all windows under thresholds of the eligible training windows."""
    fitted = cut(thresholds.fit_thresholds(eligible_training(scores, roles), [r for r in RULES if r.rule_id == rule_id], [context], roles=roles), "thresholds")
    return cut(alerts.apply_policy(scores, fitted, alpha, m, context, rule_id, roles), "trace")


def onset_table(scores: DataFrame, policies: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """(policy, entity): onset_cycle, bad_from, max_cycle, and the healthy and anomalous windows that there are.

    Windows that an entity lacks count as neither: the few policies label every window once.
    """
    labelled = proxies.apply_policies(scores.select(roles.entity, "start_cycle", "end_cycle", "max_cycle"), policies)
    count = lambda state: F.count_if(F.col("label_state") == state).alias(f"{state}_windows")
    out = labelled.groupBy("policy_id", roles.entity).agg(F.first("policy_semantics").alias("policy_semantics"), F.max("onset_cycle").alias("onset_cycle"), F.max("max_cycle").alias("max_cycle"), count("healthy"), count("anomalous"))
    bad_from = F.when(F.col("policy_semantics") == "full_window", F.col("onset_cycle") + roles.window - 1).otherwise(F.col("onset_cycle"))
    return out.withColumn("bad_from", bad_from)


def violation_runs(scores: DataFrame, fitted: DataFrame, alphas: Sequence[float | None], roles: Roles = Roles()) -> DataFrame:
    """(detector_id, ewma_id, context, rule_id, entity, run_start, run_end): maximal runs of violations.

    One smoothing per detector and alpha, one pass per threshold; persistence comes later
    as arithmetic on the runs.
    """
    keys = ["detector_id", "ewma_id", "context", "rule_id", roles.entity]
    smooth = alerts.ewma(scores.select("detector_id", roles.entity, "end_cycle", roles.mode, "alert_score"), alphas, roles=roles)
    seen = thresholds.threshold_lookup(smooth, fitted, roles)
    over = seen.where(F.col("smoothed_score") > F.col("threshold")).select(*keys, "end_cycle")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("end_cycle"))
    return over.withColumn("__i", F.col("end_cycle") - place).groupBy(*keys, "__i").agg(F.min("end_cycle").alias("run_start"), F.max("end_cycle").alias("run_end")).drop("__i")


def grid_metrics(scores: DataFrame, fitted: DataFrame, grid: Grid, roles: Roles = Roles()) -> DataFrame:
    """A metric row for each candidate and policy, without scanning windows by candidates.

    A run of n violations is, for persistence m <= n, an event from its m-th row to its
    end; its false and true endpoints are overlaps with the entity's healthy and
    anomalous stretches.  Gaps in end cycles are gaps in runs already.
    """
    spark = scores.sparkSession
    candidates = thresholds.candidate_grid(spark, grid)
    policies = proxies.policy_table(spark, grid.policies)
    table = cut(onset_table(scores.where(F.col("detector_id") == grid.detectors[0]), policies, roles), "onsets")
    totals = table.groupBy("policy_id").agg(F.count("*").alias("engine_count"), F.sum("healthy_windows").alias("healthy_windows"), F.sum("anomalous_windows").alias("anomalous_windows"))
    runs = cut(violation_runs(scores, fitted, grid.ewma, roles), "runs")
    ms = spark.createDataFrame([(m,) for m in grid.persistence], "persistence int")
    events = runs.crossJoin(F.broadcast(ms)).withColumn("event_start", F.col("run_start") + F.col("persistence") - 1).where("event_start <= run_end")
    by = ["detector_id", "ewma_id", "context", "rule_id", "persistence"]
    joined = events.join(table.select("policy_id", roles.entity, "onset_cycle", "bad_from", "max_cycle"), roles.entity)
    s, e, o = F.col("event_start"), F.col("run_end"), F.col("onset_cycle")
    per = joined.groupBy(*by, "policy_id", roles.entity).agg(
        F.sum(F.greatest(F.lit(0), F.least(e, o - 1) - s + 1)).alias("fp"),
        F.sum(F.greatest(F.lit(0), e - F.greatest(s, F.col("bad_from")) + 1)).alias("tp"),
        F.min(F.when(s >= o, s)).alias("first_detection"),
        F.count_if(s < o).alias("false_events"),
        F.count_if((s < o) & (e >= o)).alias("crossing_events"),
        F.count_if(s >= o).alias("detection_events"),
        F.first("onset_cycle").alias("onset_cycle"),
        F.first("max_cycle").alias("max_cycle"),
    )
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    sums = ["fp", "tp", "false_events", "crossing_events", "detection_events"]
    made = per.groupBy(*by, "policy_id").agg(*[F.sum(c).alias(c) for c in sums], F.count("first_detection").alias("detected_engines"), F.count_if(F.col("false_events") > 0).alias("false_alert_engines"), q(F.col("first_detection") - F.col("onset_cycle")).alias("__d"), q(F.col("max_cycle") - F.col("first_detection")).alias("__l"))
    lengths = events.groupBy(*by).agg(F.count("*").alias("event_count"), F.percentile(F.col("run_end") - F.col("event_start") + 1, F.lit(0.5)).alias("median_event_duration"))
    out = candidates.crossJoin(F.broadcast(policies.select("policy_id", "selection_policy"))).join(F.broadcast(totals), "policy_id").join(made, [*by, "policy_id"], "left").join(lengths, by, "left")
    out = out.fillna(0, [*sums, "detected_engines", "false_alert_engines", "event_count"])
    out = out.withColumns({"tn": F.col("healthy_windows") - F.col("fp"), "fn": F.col("anomalous_windows") - F.col("tp")})
    out = metrics.confusion_rates(out)
    ratio = metrics.ratio
    return out.withColumns({
        "coverage_percent": ratio(F.col("detected_engines"), F.col("engine_count"), 100.0),
        "missed_percent": ratio(F.col("engine_count") - F.col("detected_engines"), F.col("engine_count"), 100.0),
        "false_alert_engine_percent": ratio(F.col("false_alert_engines"), F.col("engine_count"), 100.0),
        "false_events_per_1000_healthy": ratio(F.col("false_events"), F.col("healthy_windows"), 1000.0),
        "fragmentation": ratio(F.col("detection_events"), F.col("detected_engines")),
        **{f"{n}_{c}": F.col(f"__{k}")[i] for k, c in (("d", "delay"), ("l", "lead")) for i, n in enumerate(("q1", "median", "q3"))},
    }).drop("__d", "__l", "healthy_windows", "anomalous_windows")


@dataclass
class PreprocessingStudy:
    """Tables of a preprocessing study: a row for each candidate, and its modes by split and by centre."""

    selection: DataFrame
    occupancy: DataFrame
    centroids: DataFrame


def _union(parts: Sequence[DataFrame], missing: bool = False) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=missing)
    return out


def preprocessing_study(cycles: DataFrame, clusters: Sequence[int] = (4, 6, 8), roles: Roles = Roles(), least: int = 30, restarts: int = 5, seeds: Sequence[int] = (1, 2, 3, 4, 5), seed: int = 42, most: int = 5_000) -> PreprocessingStudy:
    """Scaling by one set of parameters (``p0_global``) against scaling by modes of k clusters (``p1_k<k>``).

    Clusters are of standardized settings of training rows.  A candidate's row has the fit
    rows and fallbacks of its scalers and, with clusters, the silhouette of both splits (a
    sample of at most ``most`` rows, see ``regimes.silhouette``), the least mode of both,
    inertia, distance of centres, and agreement of fits on shares of the entities.
    """
    names, key = list(roles.settings), F.concat_ws(":", roles.entity, roles.order)
    both = scaling.healthy_mask(cycles, roles).where(F.col(roles.split).isin("train", "validation"))
    fit = cut(scaling.fit_global_scaler(both.where(f"{roles.split} = 'train'"), names), "setting_scaler")
    original = both.withColumns({f"original_{c}": F.col(c) for c in names})
    z = cut(scaling._scaled(original.crossJoin(F.broadcast(fit)), names).withColumn("__row", key), "settings")
    train, valid = z.where(f"{roles.split} = 'train'"), z.where(f"{roles.split} = 'validation'")
    whole = train.agg(F.count_if("healthy").alias("sensor_scaler_min_fit_rows")).select(F.lit("p0_global").alias("candidate"), "sensor_scaler_min_fit_rows")
    rows, occupied, centres = [whole], [], []
    # All clusterings of the study, those on shares of the entities too, move in the same jobs.
    wanted = [f for k in clusters for f in (*regimes.restarts_of(f"all {k}", k, restarts, seed), *regimes.stability_fits(k, seeds, restarts=restarts))]
    made = regimes.fit_many(train, names, wanted, roles.entity)
    for k in clusters:
        centers = regimes.cheapest(made, f"all {k}")
        by_split = {n: cut(regimes.assign_regime(part, names, centers, roles.mode), "modes") for n, part in (("train", train), ("validation", valid))}
        scalers = scaling.fit_mode_scalers(by_split["train"].where("healthy"), roles.sensors, k, least, roles).select(roles.mode, "fit_rows", "fallback")
        scalers = cut(scalers, "mode_fits")
        one = scalers.agg(F.min("fit_rows").alias("sensor_scaler_min_fit_rows"), F.count_if("fallback").alias("fallback_mode_count"))
        for n, part in by_split.items():
            in_modes = cut(regimes.mode_occupancy(part, k, roles).withColumns({"k": F.lit(k), roles.split: F.lit(n)}).join(F.broadcast(scalers), roles.mode), "occupancy")
            occupied.append(in_modes)
            shape = regimes.silhouette(part, names, roles.mode, "__row", most, seed).select(F.col("silhouette").alias(f"{n}_silhouette"))
            least_mode = in_modes.agg(F.min("rows").alias(f"{n}_min_mode_rows"), F.min("row_share").alias(f"{n}_min_mode_fraction"))
            one = one.crossJoin(F.broadcast(shape)).crossJoin(F.broadcast(least_mode))
        quality = regimes.cluster_quality(by_split["train"], names, centers, roles).select("inertia_per_row", "min_centroid_distance")
        agreement = cut(regimes.agreement(valid, names, made, k, seeds), "stability")
        stable = agreement.agg(F.avg("adjusted_rand").alias("mean_adjusted_rand"), F.min("adjusted_rand").alias("min_adjusted_rand"))
        one = one.crossJoin(F.broadcast(quality)).crossJoin(F.broadcast(stable))
        rows.append(cut(one.select(F.lit(f"p1_k{k}").alias("candidate"), F.lit(k).alias("k"), "*"), "candidate"))
        centre = regimes.mode_centroids(by_split["train"], [f"original_{c}" for c in names], roles)
        renamed = centre.withColumnsRenamed({f"{w}_original_{c}": f"{w}_{c}" for c in names for w in ("center", "spread")})
        centres.append(renamed.withColumn("k", F.lit(k)))
    return PreprocessingStudy(_union(rows, missing=True), _union(occupied), _union(centres))


@dataclass
class DetectorStudy:
    """Tables of a detector study: the ranking of every candidate, and the best of each detector."""

    ranking: DataFrame
    best: DataFrame


def detector_study(prepared: Mapping[str, DataFrame], grid: Sequence[tuple[str, dict]] = DETECTOR_GRID, roles: Roles = Roles(), evaluate: str = "validation", at_once: int = 4) -> DetectorStudy:
    """Every detector and setting of ``grid`` on every preprocessing: fitted on eligible training windows, ranked on another split.

    ``prepared``: name to features of windows.  Each is scaled once.  Fits of other
    detectors and settings are independent jobs, of which ``at_once`` run at a time; a
    detector's outlier factors share their searches.  Scores of all candidates are then
    calibrated and ranked together.  Best: mean average precision, then mean ROC area,
    then the names of preprocessing and setting.
    """
    windows_ = ["window_id", roles.entity, roles.split, "start_cycle", "end_cycle", "max_cycle", roles.mode]
    key, jobs = ["preprocessing", "detector_id", "parameter_set"], []
    order = {d: k for k, d in enumerate(("one_class", "isolation_forest", "lof"))}  # the longest first
    for name, features in prepared.items():
        every = cut(features.select(*roles.features, *windows_), "study_features")
        both = detectors.standardized(eligible_training(every, roles), every.where(F.col(roles.split) == evaluate), roles.features)
        for detector in dict(grid):
            settings = [p for d, p in grid if d == detector]
            jobs += [(name, both, detector, some) for some in ([settings] if detector == "lof" else [[p] for p in settings])]

    def scored(job) -> list[DataFrame]:
        name, (train, both), detector, settings = job
        made = detectors.raw_scores(train, both, roles.features, detector, settings)
        texts = [",".join(f"{k}={v}" for k, v in sorted(p.items())) for p in settings]
        return [m.select(F.lit(name).alias("preprocessing"), "detector_id", F.lit(text).alias("parameter_set"), *windows_, "__t", "raw_score") for m, text in zip(made, texts, strict=True)]

    with ThreadPoolExecutor(at_once) as pool:
        table = _union([m for made in pool.map(scored, sorted(jobs, key=lambda j: order.get(j[2], len(order)))) for m in made])
    scores = cut(calibration.ecdf(table.where("__t").select(*key, "raw_score"), table.where("not __t"), groups=key), "calibrated")
    labelled = proxies.apply_policies(scores, proxies.policy_table(scores.sparkSession))
    ranking = cut(metrics.mean_ranking(metrics.ranking_metrics(labelled, key), key).select(*key, "mean_pr_auc", "mean_roc_auc"), "ranked")
    by = [F.desc("mean_pr_auc"), F.desc("mean_roc_auc"), F.asc("preprocessing"), F.asc("parameter_set")]
    return DetectorStudy(ranking, selection.select_best(ranking, ["detector_id"], by))


def scored_and_ranked(features: DataFrame, detector: str, params: dict, roles: Roles = Roles()) -> tuple[DataFrame, DataFrame]:
    """(scores of all windows, their ranking metrics by policy) of one detector, fitted on eligible training windows."""
    made = cut(detectors.fit_score(eligible_training(features, roles), features, roles.features, detector, **params), "made")
    ranking = metrics.ranking_metrics(proxies.apply_policies(made.drop(*roles.features), proxies.policy_table(features.sparkSession)))
    return made.select("window_id", "detector_id", "raw_score", "alert_score"), ranking


def reproduce_scores(scores: DataFrame, ranking: DataFrame, features: DataFrame, detector: str, params: dict, roles: Roles = Roles(), tolerance: float = 1e-6) -> DataFrame:
    """Refit a detector and compare with stored ``scores`` and ``ranking``: a row for each table and column, see ``compare_frames``."""
    again, ranked = scored_and_ranked(features, detector, params, roles)
    one = compare.compare_frames(scores, again, ["detector_id", "window_id"], [], ["raw_score", "alert_score"], tolerance, tolerance)
    exact, close = ["positives", "negatives", "ambiguous"], ["average_precision", "roc_auc"]
    two = compare.compare_frames(ranking, ranked, ["detector_id", "policy_id"], exact, close, tolerance, tolerance)
    return one.withColumn("table", F.lit("scores")).unionByName(two.withColumn("table", F.lit("ranking")))


@dataclass
class Study:
    """Tables of an alert-policy study."""

    thresholds: DataFrame
    candidates: DataFrame
    metrics: DataFrame
    aggregated: DataFrame
    best_per_detector: DataFrame
    best: DataFrame


@dataclass
class Winners:
    """Tables of a study's winners: the best candidate of each detector, of which ``overall`` marks the best of all."""

    traces: DataFrame
    events: DataFrame
    entities: DataFrame
    metrics: DataFrame
    complementarity: DataFrame
    targets: DataFrame


def alert_policy_study(scores: DataFrame, grid: Grid, roles: Roles = Roles(), evaluate: str = "validation") -> Study:
    """Thresholds from eligible training windows; all candidates on the windows of another split; selection."""
    fitted = cut(thresholds.fit_thresholds(eligible_training(scores, roles), grid.rules, grid.contexts, roles=roles), "thresholds")
    rows = cut(grid_metrics(scores.where(F.col(roles.split) == evaluate), fitted, grid, roles), "metrics")
    aggregated = cut(metrics.aggregate_candidates(rows, ["candidate_id", "detector_id", "context", "rule_id", "ewma_id", "persistence"]), "aggregated")
    per, best = selection.select_best_candidates(aggregated)
    return Study(fitted, thresholds.candidate_grid(scores.sparkSession, grid), rows, aggregated, per, best)


def winners(scores: DataFrame, made: Study, grid: Grid, roles: Roles = Roles(), evaluate: str = "validation") -> Winners:
    """What the winners of a study do, row by row, on the windows that they were selected on.

    Traces of all of them come from one pass.  ``entities``: each winner's outcome for every
    policy and entity; ``metrics``: their metric rows computed from the traces, which equal
    those of the grid; ``complementarity``: every two winners on the selection policies;
    ``targets``: whether the overall winner keeps the limits, on each selection policy, or
    one row that says that no candidate is feasible.
    """
    best = made.best.select("candidate_id", F.lit(True).alias("__best"))
    chosen = made.best_per_detector.join(F.broadcast(best), "candidate_id", "left").withColumn("overall", F.coalesce("__best", F.lit(False))).drop("__best")
    chosen = cut(chosen, "winners")
    flag = F.broadcast(chosen.select("candidate_id", "overall"))
    keys = ["candidate_id", "detector_id"]
    shown = scores.where(F.col(roles.split) == evaluate)
    traces = cut(alerts.trace_policies(shown, made.thresholds, chosen, grid.ewma, roles), "winner_traces")
    events = cut(alerts.alert_events(traces, keys, roles), "winner_events")
    policies = proxies.policy_table(scores.sparkSession, grid.policies)
    labelled = proxies.apply_policies(traces, policies)
    onsets = labelled.groupBy(*keys, "policy_id", roles.entity).agg(F.max("onset_cycle").alias("onset_cycle"), F.max("max_cycle").alias("max_cycle"))
    outcomes = cut(metrics.entity_outcomes(events, onsets, keys, roles), "winner_entities")
    rows = metrics.policy_metrics(outcomes, metrics.endpoint_confusion(labelled, [*keys, "policy_id"]), events, keys)
    selecting = F.broadcast(policies.where("selection_policy").select("policy_id"))
    rows = cut(rows.join(flag, "candidate_id"), "winner_metrics")
    met = metrics.target_attainment(rows.where("overall").join(selecting, "policy_id"))
    none = scores.sparkSession.range(1).join(made.best.limit(1), how="left_anti")
    met = met.select("candidate_id", "policy_id", "fp_per_1000_healthy", "meets_fp_limit", "median_delay", "meets_delay", F.lit("feasible").alias("status"))
    lacking = none.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("meets_fp_limit", "meets_delay") else F.lit(False).alias(f.name) for f in met.schema[:-1]], F.lit("no_feasible_candidate").alias("status"))
    return Winners(traces.join(flag, "candidate_id"), events.join(flag, "candidate_id"), outcomes.join(flag, "candidate_id"), rows, metrics.complementarity_of_all(outcomes.join(selecting, "policy_id"), roles), met.unionByName(lacking))


def verify_study(scores: DataFrame, grid: Grid, stored: Mapping[str, DataFrame], roles: Roles = Roles(), evaluate: str = "validation") -> DataFrame:
    """Recompute a study from saved scores and compare with its ``stored`` metric and aggregated tables, see ``compare_frames``."""
    again = alert_policy_study(scores, grid, roles, evaluate)
    counts = ["tp", "fp", "tn", "fn", "detected_engines"]
    one = compare.compare_frames(stored["aggregated"], again.aggregated, ["candidate_id"], ["detector_id", "feasible"], ["min_coverage", "worst_fp_per_1000"])
    two = compare.compare_frames(stored["metrics"], again.metrics, ["candidate_id", "policy_id"], counts, ["coverage_percent", "fp_per_1000_healthy"])
    return one.withColumn("table", F.lit("aggregated")).unionByName(two.withColumn("table", F.lit("metrics")))


def evaluate_policy(trace: DataFrame, policies: DataFrame, roles: Roles = Roles()) -> dict[str, DataFrame]:
    """One policy's evaluation, row by row: metrics, outcomes, events and ranking."""
    labelled = proxies.apply_policies(trace, policies)
    events = cut(alerts.alert_events(trace, roles=roles), "events")
    confusion = metrics.endpoint_confusion(labelled, ["detector_id", "policy_id"])
    onsets = labelled.groupBy("detector_id", "policy_id", roles.entity).agg(F.max("onset_cycle").alias("onset_cycle"), F.max("max_cycle").alias("max_cycle"))
    outcomes = cut(metrics.entity_outcomes(events, onsets, ["detector_id"], roles), "outcomes")
    return {"metrics": metrics.policy_metrics(outcomes, confusion, events, ["detector_id"]), "outcomes": outcomes, "events": events, "ranking": metrics.ranking_metrics(labelled)}


@dataclass
class InferenceState:
    """What scoring new cycles takes: parameter tables, a reference and the chosen policy."""

    scalers: DataFrame
    feature_scaler: DataFrame
    pca: PCA
    reference: DataFrame
    thresholds: DataFrame
    alpha: float = 0.2
    m: int = 8
    context: str = "per_mode"
    rule_id: str = "quantile_0.995"


def fit_inference(cycles: DataFrame, modes: int, roles: Roles = Roles(), variance: float = 0.9, **policy) -> InferenceState:
    """Fit all parameters on the training split of ``cycles``."""
    from ..operators.detectors import fit_pca

    marked = scaling.healthy_mask(cycles, roles)
    scalers = cut(scaling.fit_mode_scalers(marked.where(f"{roles.split} = 'train' and healthy"), roles.sensors, modes, 30, roles), "scalers")
    features = windows.summary_features(scaling.transform_modes(cycles, scalers, roles.sensors, roles), roles)
    train = cut(eligible_training(features, roles), "eligible")
    scaler = cut(scaling.fit_global_scaler(train, roles.features), "feature_scaler")
    z = scaling._scaled(train.crossJoin(F.broadcast(scaler)), roles.features)
    pca = fit_pca(z, roles.features, variance)
    raw = cut(score_pca(z, roles.features, pca).withColumn("detector_id", F.lit("pca")).withColumn("raw_score", F.round("raw_score", 9)), "reference")
    calibrated = cut(calibration.ecdf(raw, raw), "calibrated")
    state = InferenceState(scalers, scaler, pca, raw.select("detector_id", "raw_score"), cut(thresholds.fit_thresholds(calibrated, roles=roles), "thresholds"))
    for k, v in policy.items():
        setattr(state, k, v)
    return state


def infer(cycles: DataFrame, state: InferenceState, roles: Roles = Roles()) -> tuple[DataFrame, DataFrame]:
    """(windows, events) of new cycles: one row for each window with score, state, event and top three sensors.

    Values that aren't finite, keys that aren't whole, and entities shorter than a window
    raise Violation, as do repeated cycles.
    """
    checks.assert_empty(checks.check_inference_input(cycles.select(*roles.keys, *roles.settings, *roles.sensors), roles))
    features = windows.summary_features(scaling.transform_modes(cycles, state.scalers, roles.sensors, roles), roles)
    z = scaling._scaled(features.crossJoin(F.broadcast(state.feature_scaler)), roles.features)
    explained = attribute_pca(z, roles.features, roles.sensors, state.pca).withColumn("detector_id", F.lit("pca")).withColumn("raw_score", F.round("raw_score", 9))
    scored = cut(calibration.ecdf(state.reference, cut(explained.drop(*roles.features), "explained")), "scored")
    trace = cut(alerts.apply_policy(scored, state.thresholds, state.alpha, state.m, state.context, state.rule_id, roles), "trace")
    events = cut(alerts.alert_events(trace, roles=roles), "events")
    return alerts.event_flags(trace, events, roles=roles), events


@dataclass
class InferenceResult:
    """What an inference gives: its windows in the 21 columns of the timeline, its events, and what it was made with."""

    timeline: DataFrame
    events: DataFrame
    provenance: DataFrame


def provenance(state: InferenceState, roles: Roles = Roles(), digits: int = 9) -> DataFrame:
    """(artifact, rows, sha256) of everything that a state holds: its tables, components and policy.

    Numbers count to ``digits`` places, so that fits of rows that were dealt otherwise are
    the same artifact; no order of rows matters.
    """
    spark, parts = state.scalers.sparkSession, []
    rounded = lambda df: df.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])
    for name in ("scalers", "feature_scaler", "reference", "thresholds"):
        one = compare.frame_fingerprint(rounded(getattr(state, name)))
        parts.append(one.select(F.lit(name).alias("artifact"), "rows", F.col("digest").alias("sha256")))
    pca = np.round(np.vstack((state.pca.mean, state.pca.components)), digits) + 0.0
    policy = {"alpha": state.alpha, "persistence": state.m, "context": state.context, "rule_id": state.rule_id, "window": roles.window, "features": roles.features}
    texts = {"pca": json.dumps(pca.tolist()), "policy": json.dumps(policy, sort_keys=True)}
    made = [(k, len(pca) if k == "pca" else 1, hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items()]
    return _union([*parts, spark.createDataFrame(made, "artifact string, rows long, sha256 string")])


def inference(cycles: DataFrame, state: InferenceState, roles: Roles = Roles()) -> InferenceResult:
    """``infer`` with the timeline's columns and the provenance of the state."""
    windows_, events = infer(cycles, state, roles)
    return InferenceResult(timeline(windows_, roles), events, provenance(state, roles))


def timeline(rows: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The 21 columns of the inference timeline from the windows of ``infer``."""
    renamed = {
        "calibrated_score": F.col("alert_score"),
        "alert": F.col("alert_active"),
        "top_three_sensor_contributions": F.col("top_three"),
        "attribution_completeness_abs_difference": F.col("completeness_error"),
        **{k: F.lit(v) for k, v in EXPLANATION.items()},
    }
    # The timeline's columns in their order.
    first = ["window_id", roles.entity, "start_cycle", "end_cycle", roles.mode, "raw_score", "calibrated_score", "threshold", "smoothed_score", "threshold_violation", "persistence_count"]
    last = ["alert", "event_start", "event_status", "top_three_sensor_contributions", *EXPLANATION, "attribution_completeness_abs_difference"]
    return rows.withColumns(renamed).select(*first, *last)
