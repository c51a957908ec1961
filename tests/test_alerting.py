"""Alert state, events, thresholds, calibration, labels, selection and splits: random tables against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.order import quantiles
from tidewatch.operators import alerts, calibration, compare, detectors, metrics, proxies, selection, thresholds, windows
from tidewatch.operators.checks import Violation, assert_empty, check_cycles
from tidewatch.operators.splits import stratified_split
from tidewatch.plans import study
from tidewatch.schema import POLICIES, Grid, Roles, Rule

R = Roles()
SCORES = "detector_id string, window_id string, engine int, start_cycle int, end_cycle int, max_cycle int, op_mode int, split string, alert_score double"


def histories(seed, engines=7, length=40, skip=0.1):
    """{engine: [(cycle, mode, score)]} with gaps, runs of equal scores and engines of one row."""
    rng = random.Random(seed)
    out = {}
    for e in range(engines):
        n = 1 if e == 3 else rng.randrange(length // 2, length)
        rows, x = [], 0.5
        for c in range(1, n + 1):
            x = x if rng.random() < 0.3 else round(rng.random(), 2)
            if c == 1 or rng.random() >= skip:
                rows.append((c, rng.randrange(3), x))
        out[e * 11 + 2] = rows
    return out


def frame(spark, held):
    rows = [("d", f"{e}/{c}", e, c - 9, c, 60, m, "train", x) for e, cycles in held.items() for c, m, x in cycles]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCORES)


def segments_of(cycles):
    """Lists of rows without a gap between cycles."""
    out = []
    for r in cycles:
        if out and r[0] == out[-1][-1][0] + 1:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def trace_of(cycles, alpha, m, threshold):
    """{cycle: (segment, smoothed, run, active)} row by row."""
    out = {}
    for k, segment in enumerate(segments_of(cycles)):
        s, run = None, 0
        for c, mode, x in segment:
            s = x if s is None or alpha is None else alpha * x + (1 - alpha) * s
            run = run + 1 if s > threshold(mode) else 0
            out[c] = k, s, run, run >= m
    return out


def test_smoothing_is_the_recurrence():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        x, starts, a = rng.random(n), rng.random(n) < 0.05, np.array([1.0, 0.2, 0.7])
        for state in (None, np.array([0.4, 0.5, 0.6])):
            want, s = [], state
            for i, v in enumerate(x):
                s = np.full(3, v) if starts[i] or s is None else a * v + (1 - a) * s
                want.append(s)
            assert np.array_equal(alerts.smooth(x, starts, a, state), np.array(want))


@pytest.mark.parametrize(("alpha", "m", "context"), [(0.35, 2, "per_mode"), (None, 3, "global"), (0.8, 1, "global")])
def test_policy_trace_and_events_equal_row_by_row(spark, alpha, m, context):
    held = histories(5)
    limit = {0: 0.45, 1: 0.5, 2: 0.62, None: 0.55}
    modes = [0, 1, 2] if context == "per_mode" else [None]
    t = spark.createDataFrame([("d", context, "r", k, limit[k], 9) for k in modes], "detector_id string, context string, rule_id string, op_mode int, threshold double, reference_count long")
    trace = alerts.apply_policy(frame(spark, held), t, alpha, m, context, "r").cache()
    want = {e: trace_of(c, alpha, m, lambda k: limit[k if context == "per_mode" else None]) for e, c in held.items()}
    first, before = {}, 0
    for e in sorted(held):
        first[e], before = before, before + 1 + max(v[0] for v in want[e].values())
    rows = trace.collect()
    assert len(rows) == sum(map(len, held.values()))
    for r in rows:
        k, s, run, active = want[r.engine][r.end_cycle]
        assert (r.smoothed_score, r.persistence_count, r.alert_active, r.state_segment_id) == (pytest.approx(s, abs=1e-12), run, active, first[r.engine] + k)
    events = set()
    for e, at in want.items():
        live = [c for c in sorted(at) if at[c][3]]
        for k, run in enumerate(segments_of([(c,) for c in live]), 1):
            events.add((e, k, run[0][0], run[-1][0], len(run), f"engine_{e}_event_{k:03d}"))
    got = alerts.alert_events(trace)
    assert {(r.engine, r.event_number, r.event_start_cycle, r.event_end_cycle, r.event_duration_endpoints, r.event_id) for r in got.collect()} == events
    for r in alerts.event_flags(trace, got).collect():
        name = next((x[5] for x in events if (x[0], x[2]) == (r.engine, r.end_cycle)), None)
        assert (r.event_start, r.event_status) == (name is not None, name or ("active" if r.alert_active else "none"))


def test_a_policy_refuses_what_it_cannot_judge(spark):
    held = histories(6)
    t = spark.createDataFrame([("d", "per_mode", "r", 0, 0.7, 4)], "detector_id string, context string, rule_id string, op_mode int, threshold double, reference_count long")
    with pytest.raises(Exception, match="no threshold for mode"):
        alerts.apply_policy(frame(spark, held), t, None, 1, "per_mode", "r").collect()
    with pytest.raises(Violation, match="duplicate_key"):
        alerts.apply_policy(frame(spark, held).unionByName(frame(spark, held)), t, None, 1, "per_mode", "r")
    with pytest.raises(Violation, match="duplicate_cycle"):
        alerts.apply_policy(frame(spark, held).withColumn("end_cycle", F.lit(5)), t, None, 1, "per_mode", "r")
    with pytest.raises(Violation, match="score"):
        alerts.apply_policy(frame(spark, held).withColumn("alert_score", F.lit(1.5)), t, None, 1, "per_mode", "r")
    for alpha, m in ((0.0, 1), (1.2, 1), (0.5, 0)):
        with pytest.raises(Violation):
            alerts.apply_policy(frame(spark, held), t, alpha, m, "per_mode", "r")


def test_outcomes_of_events_against_onsets(spark):
    rng = random.Random(8)
    events, onsets, want = [], [], {}
    for e in range(40):
        onset, last = rng.randrange(5, 25), 30
        at, mine = 1, []
        while at < last - 4 and rng.random() < 0.7:
            start = at + rng.randrange(1, 5)
            end = min(last, start + rng.randrange(0, 6))
            mine.append((start, end))
            at = end + 2
        events += [("d", e, s, t) for s, t in mine]
        onsets.append(("d", "p", e, onset, last))
        hits = [s for s, _ in mine if s >= onset]
        first = min(hits, default=None)
        want[e] = (first, sum(s < onset for s, _ in mine), sum(s < onset <= t for s, t in mine), len(hits), first and first - onset, first and last - first)
    ev = spark.createDataFrame(events, "detector_id string, engine int, event_start_cycle int, event_end_cycle int")
    on = spark.createDataFrame(onsets, "detector_id string, policy_id string, engine int, onset_cycle int, max_cycle int")
    got = metrics.entity_outcomes(ev, on, ["detector_id"]).collect()
    assert {r.engine: (r.first_detection, r.false_events, r.crossing_events, r.detection_events, r.detection_delay, r.lead_time) for r in got} == want
    assert any(w[2] for w in want.values()) and any(w[0] is None for w in want.values())


def test_thresholds_are_order_statistics_and_moments(spark):
    held = histories(9)
    s = frame(spark, held)
    values = {None: [], 0: [], 1: [], 2: []}
    for c in held.values():
        for _, m, x in c:
            values[None].append(x)
            values[m].append(x)
    rules = [Rule("a", "quantile", 0.37), Rule("b", "quantile", 1.0), Rule("c", "mean_plus_std", 1.3)]
    got = {(r.rule_id, r.op_mode): (r.threshold, r.reference_count) for r in thresholds.fit_thresholds(s, rules).collect()}
    assert len(got) == 12
    for rule in rules:
        for mode, xs in values.items():
            xs = sorted(xs)
            want = xs[int(np.ceil((len(xs) - 1) * rule.value))] if rule.kind == "quantile" else np.mean(xs) + rule.value * np.std(xs)
            assert got[rule.rule_id, mode] == (pytest.approx(want), len(xs))
    with pytest.raises(Violation, match="split_not_allowed"):
        thresholds.fit_thresholds(s.withColumn("split", F.lit("test")))


def test_distribution_and_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(10)
    ref, q = np.round(rng.normal(size=300), 1), np.round(rng.normal(0, 2, 200), 1)
    a, b = (spark.createDataFrame([(float(v),) for v in x], "x double") for x in (ref, q))
    for r in calibration.ecdf(a, b, "x", [], "p").collect():
        assert r.p == pytest.approx((ref <= r.x).mean())
    rows = [(k, float(v)) for k, n in ((1, 1), (2, 2), (3, 150)) for v in rng.normal(size=n)] + [(3, None)]
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", points).collect():
        assert np.allclose(r[1:], np.quantile([v for g, v in rows if g == r.g and v is not None], points))


def test_labels_of_every_policy(spark):
    rng = random.Random(11)
    rows = [(f"w{i}", (end := rng.randrange(10, last + 1)) - 9, end, last) for i in range(200) for last in [rng.randrange(10, 130)]]
    got = proxies.apply_policies(spark.createDataFrame(rows, "window_id string, start_cycle int, end_cycle int, max_cycle int"), proxies.policy_table(spark)).collect()
    assert len(got) == len(rows) * len(POLICIES)
    for r in got:
        onset = int(np.floor(r.max_cycle * (1.0 - r.onset_fraction))) + 1
        late = r.end_cycle >= onset
        state = "healthy" if not late else "ambiguous" if r.policy_semantics == "full_window" and r.start_cycle < onset else "anomalous"
        assert (r.onset_cycle, r.label_state, r.proxy_label) == (onset, state, {"healthy": 0, "anomalous": 1}.get(state))


def test_selection_is_the_lexicographic_best(spark):
    rng = random.Random(12)
    pick = lambda *xs: rng.choice(xs)
    rows = [(f"k{i:02d}", pick("u", "v"), pick(40.0, 70.0), pick(60.0, 80.0), pick(10.0, 75.0), pick(1.0, 2.0), pick(1.0, 2.0), pick(None, 4.0, 6.0), pick(None, 3.0, 9.0)) for i in range(80)]
    table = spark.createDataFrame([(*r, r[4] <= 60) for r in rows], "candidate_id string, detector_id string, min_coverage double, mean_coverage double, worst_fp_per_1000 double, worst_false_events double, worst_false_engines double, median_delay double, median_lead double, feasible boolean")
    last = float("inf")
    order = lambda r: (-r[2], -r[3], r[5], r[6], last if r[7] is None else r[7], last if r[8] is None else -r[8], r[0])
    want = {d: min((r for r in rows if r[1] == d and r[4] <= 60), key=order) for d in "uv"}
    per, best = selection.select_best_candidates(table)
    assert {r.detector_id: r.candidate_id for r in per.collect()} == {d: r[0] for d, r in want.items()}
    assert [r.candidate_id for r in best.collect()] == [min(want.values(), key=order)[0]]
    assert selection.select_best_candidates(table.where("not feasible"))[1].count() == 0


def test_split_deals_whole_entities_by_stratum(spark):
    rng = random.Random(13)
    lives = [(e, n, n) for e, n in zip(rng.sample(range(1000), 83), [rng.randrange(20, 60) for _ in range(83)], strict=True)]
    summary = spark.createDataFrame(lives, "engine int, cycle_count int, max_cycle int")
    got = {r.engine: r for r in stratified_split(summary, seed=5).collect()}
    ranked = sorted(lives, key=lambda x: (x[2], x[0]))
    strata = {e: max(int(np.ceil(i * 5 / (len(lives) - 1))) - 1, 0) for i, (e, _, _) in enumerate(ranked)}
    assert {e: r.stratum for e, r in got.items()} == strata
    for k in range(5):
        mine = [got[e].split for e in strata if strata[e] == k]
        for split, share in (("train", 0.6), ("validation", 0.2), ("test", 0.2)):
            assert abs(mine.count(split) - share * len(mine)) < 1
    assert got != {r.engine: r for r in stratified_split(summary, seed=6).collect()}


def test_windows_of_every_length_and_gaps(spark):
    lengths = {4: 9, 5: 10, 9: 23, 13: 1}
    cycles = spark.createDataFrame([(e, c, "train", 0, float(c)) for e, n in lengths.items() for c in range(1, n + 1)], "engine int, cycle int, split string, op_mode int, s1 double")
    for w in (1, 10, 12):
        got = windows.window_metadata(cycles, Roles(window=w)).collect()
        want = {(e, c - w + 1, c, c - w + 1 + w // 2, n) for e, n in lengths.items() for c in range(w, n + 1)}
        assert {(r.engine, r.start_cycle, r.end_cycle, r.midpoint_cycle, r.max_cycle) for r in got} == want and len(got) == len(want)
    with pytest.raises(Violation, match="gap"):
        assert_empty(check_cycles(cycles.where("cycle <> 7")))


def test_factored_grid_equals_row_wise_evaluation(spark):
    rng = random.Random(3)
    rows = [("d", f"train:{e}:{c}", e, c - 9, c, 60, rng.randrange(2), "train", rng.random() ** 0.5) for e in range(4) for c in range(10, 61)]
    scores = spark.createDataFrame(rows, SCORES)
    grid = Grid(("d",), ("global", "per_mode"), (Rule("q", "quantile", 0.6),), (None, 0.5), (1, 3))
    fitted = thresholds.fit_thresholds(scores, grid.rules)
    got = {(r.context, r.ewma_id, r.persistence, r.policy_id): r for r in study.grid_metrics(scores, fitted, grid).collect()}
    assert len(got) == 2 * 2 * 2 * 5
    for context, alpha, m in (("per_mode", 0.5, 3), ("global", None, 1)):
        trace = alerts.apply_policy(scores, fitted, alpha, m, context, "q")
        for r in study.evaluate_policy(trace, proxies.policy_table(spark))["metrics"].collect():
            g = got[context, "off" if alpha is None else "alpha_0.50", m, r.policy_id]
            for c in ("tp", "fp", "tn", "fn", "false_events", "crossing_events", "detected_engines", "median_delay", "median_lead", "event_count", "median_event_duration", "fragmentation"):
                assert getattr(g, c) == getattr(r, c), (context, m, r.policy_id, c)


def test_winners_tables_equal_the_grid_and_one_policy_at_a_time(spark):
    rng = random.Random(4)
    rows = [(k, f"{split}:{e}:{c}", e, c - 9, c, 60, rng.randrange(2), split, min(1.0, rng.random() * (1.6 if c > 44 else 0.9))) for k in ("a", "b", "c") for split, es in (("train", range(4)), ("validation", range(4, 9))) for e in es for c in range(10, 61) if c != 30 + e]
    scores = spark.createDataFrame(rows, SCORES)
    grid = Grid(("a", "b", "c"), ("global", "per_mode"), (Rule("q", "quantile", 0.9), Rule("m", "mean_plus_std", 1.5)), (None, 0.5), (1, 3))
    made = study.alert_policy_study(scores, grid)
    won = study.winners(scores, made, grid)
    best = made.best_per_detector.collect()
    assert len(best) == 3
    shown = scores.where("split = 'validation'")
    cells = ("tp", "fp", "tn", "fn", "false_events", "crossing_events", "detected_engines", "median_delay", "median_lead", "event_count", "fragmentation", "coverage_percent")
    by_grid = {(r.candidate_id, r.policy_id): [getattr(r, c) for c in cells] for r in made.metrics.collect()}
    for r in won.metrics.collect():
        assert [getattr(r, c) for c in cells] == by_grid[r.candidate_id, r.policy_id]
    cols = ["window_id", "segment", "state_segment_id", "smoothed_score", "threshold", "threshold_violation", "persistence_count", "alert_active"]
    traces, events = won.traces.collect(), won.events.collect()
    for b in best:
        alone = alerts.apply_policy(shown.where(F.col("detector_id") == b.detector_id), made.thresholds, None if b.ewma_id == "off" else 0.5, b.persistence, b.context, b.rule_id)
        assert sorted(tuple(r[c] for c in cols) for r in traces if r.candidate_id == b.candidate_id) == sorted(tuple(r[c] for c in cols) for r in alone.select(*cols).collect())
        want = sorted((r.engine, r.event_start_cycle, r.event_end_cycle, r.event_number) for r in alerts.alert_events(alone).collect())
        assert sorted((r.engine, r.event_start_cycle, r.event_end_cycle, r.event_number) for r in events if r.candidate_id == b.candidate_id) == want
    assert {r.candidate_id for r in traces if r.overall} == {made.best.first().candidate_id}
    # Each two winners, against sets of entities.
    seen = {}
    for r in won.entities.collect():
        seen.setdefault((r.policy_id, r.detector_id), {})[r.engine] = (r.first_detection is not None, r.false_events > 0)
    both = won.complementarity.collect()
    assert len(both) == 3 * 3 and {(r.detector_a, r.detector_b) for r in both} == {("a", "b"), ("a", "c"), ("b", "c")}
    for r in both:
        x, y = seen[r.policy_id, r.detector_a], seen[r.policy_id, r.detector_b]
        for k, name in ((0, "detected"), (1, "false_alert")):
            pairs = [(x[e][k], y[e][k]) for e in x]
            assert [getattr(r, f"{name}_{c}") for c in ("both", "only_a", "only_b", "neither")] == [pairs.count(p) for p in ((True, True), (True, False), (False, True), (False, False))]
    targets = won.targets.collect()
    assert len(targets) == 3 and {t.status for t in targets} == {"feasible"} and all(t.meets_fp_limit for t in targets)
    # Nothing feasible: no rows of winners, and one row that says so.
    none = study.winners(scores, study.Study(made.thresholds, made.candidates, made.metrics, made.aggregated, made.best_per_detector.limit(0), made.best.limit(0)), grid)
    assert [tuple(t) for t in none.targets.collect()] == [(None, None, None, False, None, False, "no_feasible_candidate")]
    assert none.traces.count() == none.complementarity.count() == 0


def test_candidate_grid_is_one_local_table(spark):
    grid = Grid(("a", "b"))
    table = thresholds.candidate_grid(spark, grid)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "CartesianProduct" not in plan
    rows = table.orderBy("candidate_rank").collect()
    assert [r.candidate_rank for r in rows] == list(range(2 * 2 * 8 * 4 * 4)) and len({r.candidate_id for r in rows}) == len(rows)


def test_outlier_factors_equal_brute_force(spark):
    rng = np.random.default_rng(14)
    ref = rng.normal(size=(90, 3))
    ref[:5] = ref[5:10]  # repeated rows
    q = np.concatenate((ref[:20], rng.normal(0, 3, (15, 3))))
    frame_of = lambda x: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "key int, a double, b double, c double")
    cols, k = ["a", "b", "c"], 7
    d = np.sqrt(((ref[:, None] - ref[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, axis=1)[:, k - 1]
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, axis=1), kd[near]).mean(axis=1) + 1e-10)
    far = np.sqrt(((q[:, None] - ref[None]) ** 2).sum(axis=2))
    at = np.argsort(far, axis=1, kind="stable")[:, :k]
    want = lrd[at].mean(axis=1) * (np.maximum(np.take_along_axis(far, at, axis=1), kd[at]).mean(axis=1) + 1e-10)
    state = detectors.fit_lof(frame_of(ref).coalesce(1), cols, k)
    got = {r.key: r.raw_score for r in detectors.score_lof(frame_of(q), cols, state).collect()}
    assert np.allclose([got[i] for i in range(len(q))], want)
    # The same neighbours whatever the blocks.
    points = frame_of(ref).select(F.col("key").cast("long").alias("id"), F.array(*cols).alias("x"))
    one, many = ({r.id: [round(v, 12) for v in r.dist] for r in detectors.nearest(points, points, k, True, b).collect()} for b in (4096, 16))
    assert one == many
    with pytest.raises(Violation, match="too few"):
        detectors.fit_lof(frame_of(ref[:2]), cols, k)


def test_digests_tell_sets_not_orders(spark):
    a = spark.createDataFrame([(i,) for i in range(50)], "engine int")
    digest = lambda df: tuple(compare.id_digest(df, "engine").first())
    assert digest(a) == digest(a.orderBy(F.desc("engine")).unionByName(a)) and digest(a)[0] == 50
    assert digest(a) != digest(a.where("engine <> 7")) and digest(a.limit(0))[0] == 0
