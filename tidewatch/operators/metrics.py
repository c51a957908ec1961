"""Evaluation of alerts and scores against proxy labels.

Undefined metrics are null; quotients by zero are undefined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import quantiles, running
from ..schema import DELAY_ASPIRATION, FEASIBLE_PER_1000, Roles


def ratio(a: Column, b: Column, times: float = 1.0) -> Column:
    return F.try_divide(a.cast("double") * times, b.cast("double"))


def align_policy(trace: DataFrame, labelled: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Trace rows with their policies' labels, by window id (one trace row for each window and detector)."""
    cols = ["window_id", "policy_id", "selection_policy", "policy_semantics", "onset_cycle", "label_state", "proxy_label"]
    return trace.join(labelled.select(*cols), "window_id")


def endpoint_confusion(aligned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tp, fp, tn, fn over labelled windows and their quotients."""
    on, bad = F.col("alert_active"), F.col("proxy_label") == 1
    labelled = aligned.where("proxy_label is not null")
    counts = labelled.groupBy(*keys).agg(F.count_if(on & bad).alias("tp"), F.count_if(on & ~bad).alias("fp"), F.count_if(~on & ~bad).alias("tn"), F.count_if(~on & bad).alias("fn"))
    return confusion_rates(counts)


def confusion_rates(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "fp_per_1000_healthy": ratio(fp, fp + tn, 1000.0)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def entity_outcomes(events: DataFrame, onsets: DataFrame, keys: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Per key, policy and entity: detection, delay, lead, false and crossing events.

    ``onsets``: a row (keys, policy_id, entity, onset_cycle, max_cycle) for every entity, so
    that those without events stay.  An event that starts before onset is false, also if
    it lasts beyond it (a crossing), and never a detection.
    """
    by = [*keys, "policy_id", roles.entity]
    ev = events.select(*keys, roles.entity, "event_start_cycle", "event_end_cycle")
    joined = onsets.join(ev, [*keys, roles.entity], "left")
    start, end, on = F.col("event_start_cycle"), F.col("event_end_cycle"), F.col("onset_cycle")
    out = joined.groupBy(*by).agg(F.first("onset_cycle").alias("onset_cycle"), F.first("max_cycle").alias("max_cycle"), F.min(F.when(start >= on, start)).alias("first_detection"), F.count_if(start < on).alias("false_events"), F.count_if((start < on) & (end >= on)).alias("crossing_events"), F.count_if(start >= on).alias("detection_events"))
    return out.withColumns({"detected": F.col("first_detection").isNotNull(), "detection_delay": F.col("first_detection") - F.col("onset_cycle"), "lead_time": F.col("max_cycle") - F.col("first_detection")})


def policy_metrics(outcomes: DataFrame, confusion: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metric rows by key and policy: confusion, coverage, false events, fragmentation, quartiles of delay and lead."""
    by = [*keys, "policy_id"]
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = outcomes.groupBy(*by).agg(F.count("*").alias("engine_count"), F.count_if("detected").alias("detected_engines"), F.count_if(F.col("false_events") > 0).alias("false_alert_engines"), F.sum("false_events").alias("false_events"), F.sum("crossing_events").alias("crossing_events"), F.sum("detection_events").alias("detection_events"), q("detection_delay").alias("__d"), q("lead_time").alias("__l"))
    durations = events.groupBy(*keys).agg(F.percentile("event_duration_endpoints", F.lit(0.5)).alias("median_event_duration"), F.count("*").alias("event_count"))
    out = out.join(confusion, by).join(durations, list(keys), "left")
    healthy = F.col("fp") + F.col("tn")
    return out.withColumns({
        "event_count": F.coalesce("event_count", F.lit(0)),
        "coverage_percent": ratio(F.col("detected_engines"), F.col("engine_count"), 100.0),
        "missed_percent": ratio(F.col("engine_count") - F.col("detected_engines"), F.col("engine_count"), 100.0),
        "false_alert_engine_percent": ratio(F.col("false_alert_engines"), F.col("engine_count"), 100.0),
        "false_events_per_1000_healthy": ratio(F.col("false_events"), healthy, 1000.0),
        "fragmentation": ratio(F.col("detection_events"), F.col("detected_engines")),
        **{f"{n}_{c}": F.col(f"__{k}")[i] for k, c in (("d", "delay"), ("l", "lead")) for i, n in enumerate(("q1", "median", "q3"))},
    }).drop("__d", "__l")


def aggregate_candidates(metrics: DataFrame, keys: Sequence[str] = ("candidate_id",), policies: int = 3, limit: float = FEASIBLE_PER_1000, least_coverage: float | None = None) -> DataFrame:
    """Per candidate over the selection policies: worst and mean metrics, and ``feasible``.

    A mean or median over policies is null if any policy's is.  ``least_coverage`` is an
    optional floor on the least coverage.
    """
    sel = metrics.where("selection_policy")
    whole = lambda c, f: F.when(F.count(c) == policies, f(c))
    out = sel.groupBy(*keys).agg(F.count_distinct("policy_id").alias("policies"), whole("coverage_percent", F.min).alias("min_coverage"), whole("coverage_percent", F.avg).alias("mean_coverage"), whole("fp_per_1000_healthy", F.max).alias("worst_fp_per_1000"), whole("false_events_per_1000_healthy", F.max).alias("worst_false_events"), whole("false_alert_engine_percent", F.max).alias("worst_false_engines"), whole("median_delay", F.median).alias("median_delay"), whole("median_lead", F.median).alias("median_lead"))
    ok = F.coalesce(F.col("worst_fp_per_1000") <= limit, F.lit(False)) & (F.col("policies") == policies)
    if least_coverage is not None:
        ok = ok & F.coalesce(F.col("min_coverage") >= least_coverage, F.lit(False))
    return out.withColumn("feasible", ok)


def average_precision(scores: DataFrame, groups: Sequence[str], score: str, label: str) -> DataFrame:
    """(groups, positives, negatives, average_precision, roc_auc) with ties, over rows whose label isn't null.

    Both come from running counts of distinct scores from the greatest down: step-wise
    precision by recall, and the share of pairs in the right order with ties as halves.
    Undefined with one class alone.
    """
    groups = list(groups)
    rows = scores.where(F.col(label).isNotNull())
    at = running(rows, groups, score, {"__p": label, "__n": f"1 - {label}"}, descending=True)
    total = at.groupBy(*groups).agg(F.sum("__p").alias("positives"), F.sum("__n").alias("negatives"))
    joined = at.join(total, groups) if groups else at.crossJoin(F.broadcast(total))
    p, n = F.col("__p").cast("double"), F.col("__n").cast("double")
    ap = F.sum(p / F.col("positives") * F.col("__p_upto") / (F.col("__p_upto") + F.col("__n_upto")))
    auc = F.sum(n * (F.col("__p_upto") - p / 2)) / (F.first("positives") * F.first("negatives"))
    defined = (F.col("positives") > 0) & (F.col("negatives") > 0)
    out = joined.where(defined).groupBy(*groups).agg(ap.alias("average_precision"), auc.alias("roc_auc"))
    return total.join(out, groups, "left") if groups else total.crossJoin(F.broadcast(out))


def ranking_metrics(labelled_scores: DataFrame, keys: Sequence[str] = ("detector_id",)) -> DataFrame:
    """Average precision and ROC area for each key and policy, with counts of label states."""
    by = [*keys, "policy_id"]
    rank = average_precision(labelled_scores, by, "alert_score", "proxy_label")
    counts = labelled_scores.groupBy(*by).agg(F.count_if(F.col("proxy_label").isNull()).alias("ambiguous"), F.max("selection_policy").alias("selection_policy"))
    return rank.join(counts, by)


def mean_ranking(ranking: DataFrame, keys: Sequence[str] = ("detector_id",), policies: int = 3) -> DataFrame:
    """Means over the selection policies; null unless all of them are defined."""
    whole = lambda c: F.when(F.count(c) == policies, F.avg(c))
    return ranking.where("selection_policy").groupBy(*keys).agg(whole("average_precision").alias("mean_pr_auc"), whole("roc_auc").alias("mean_roc_auc"))


def target_attainment(metrics: DataFrame) -> DataFrame:
    """Flags of a metric row: false positives within the limit, delay within the aspiration, false-alarm rate below 6 %."""
    far = F.col("fp_per_1000_healthy") / 10
    return metrics.withColumns({"far_percent": far, "meets_fp_limit": F.coalesce(F.col("fp_per_1000_healthy") <= FEASIBLE_PER_1000, F.lit(False)), "meets_delay": F.coalesce(F.col("median_delay") <= DELAY_ASPIRATION, F.lit(False)), "far_below_6": F.coalesce(far < 6, F.lit(False))})


def complementarity(outcomes: DataFrame, left: str, right: str, roles: Roles = Roles()) -> DataFrame:
    """Per policy, entities that both detectors, one or neither detect, and the same for false alerts."""
    pick = lambda d, p: outcomes.where(F.col("detector_id") == d).select("policy_id", roles.entity, F.col("detected").alias(f"{p}_d"), (F.col("false_events") > 0).alias(f"{p}_f"))
    both = pick(left, "a").join(pick(right, "b"), ["policy_id", roles.entity])
    cells = []
    for k, name in (("d", "detected"), ("f", "false_alert")):
        a, b = F.col(f"a_{k}"), F.col(f"b_{k}")
        cells += [F.count_if(a & b).alias(f"{name}_both"), F.count_if(a & ~b).alias(f"{name}_only_a"), F.count_if(~a & b).alias(f"{name}_only_b"), F.count_if(~a & ~b).alias(f"{name}_neither")]
    return both.groupBy("policy_id").agg(*cells).select(F.lit(left).alias("detector_a"), F.lit(right).alias("detector_b"), "*")


def complementarity_of_all(outcomes: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """``complementarity`` of every two detectors of ``outcomes``, the lesser name first, in one aggregation.

    Each entity's detectors of a policy are joined with one another: a few rows each.
    """
    one = outcomes.select("policy_id", roles.entity, F.col("detector_id").alias("detector_a"), F.col("detected").alias("a_d"), (F.col("false_events") > 0).alias("a_f"))
    other = one.withColumnsRenamed({"detector_a": "detector_b", "a_d": "b_d", "a_f": "b_f"})
    both = one.join(other, ["policy_id", roles.entity]).where("detector_a < detector_b")
    cells = [F.count("*").alias("engine_count")]
    for k, name in (("d", "detected"), ("f", "false_alert")):
        a, b = F.col(f"a_{k}"), F.col(f"b_{k}")
        cells += [F.count_if(a & b).alias(f"{name}_both"), F.count_if(a & ~b).alias(f"{name}_only_a"), F.count_if(~a & b).alias(f"{name}_only_b"), F.count_if(~a & ~b).alias(f"{name}_neither")]
    return both.groupBy("policy_id", "detector_a", "detector_b").agg(*cells)


def run_robustness(values: DataFrame, group: str, value: str) -> DataFrame:
    """count, median, mean, sample deviation, least and greatest by group."""
    rest = values.groupBy(group).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return rest.join(quantiles(values, [group], value, [0.5]).withColumnRenamed("q0", "median"), group, "left")


def score_reference_summary(scores: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Count, mean, population deviation and range of training scores by detector, and by detector and mode, in one pass."""
    one = scores.groupingSets([["detector_id"], ["detector_id", roles.mode]], "detector_id", roles.mode)
    out = one.agg(F.grouping(roles.mode).alias("__g"), F.count("*").alias("reference_count"), F.avg("alert_score").alias("mean"), F.stddev_pop("alert_score").alias("std"), F.min("alert_score").alias("least"), F.max("alert_score").alias("greatest"))
    return out.where("detector_id is not null").withColumn("context", F.when(F.col("__g") == 1, "global").otherwise("per_mode")).drop("__g")
