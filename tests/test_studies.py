"""Regimes, checks, detectors, profiles, comparison and the stream against brute force on small random tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import checks, compare, detectors, profile, regimes
from tidewatch.schema import DETECTOR_GRID, Roles


def frame(spark, names, rows, types):
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types.split(), strict=True))
    return spark.createDataFrame(rows, schema)


def silhouette(x, labels):
    out = []
    for i, own in enumerate(labels):
        away = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        means = {c: away[labels == c].sum() / max(1, (labels == c).sum() - (c == own)) for c in set(labels)}
        a, b = means.pop(own), min(means.values())
        out.append(0.0 if (labels == own).sum() == 1 else (b - a) / max(a, b))
    return np.mean(out)


def test_silhouette_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x, labels = rng.normal(size=(90, 3)).round(3), rng.integers(0, 4, 90)
    labels[0] = 9
    rows = [(i, int(k), *map(float, p)) for i, (k, p) in enumerate(zip(labels, x, strict=True))]
    df = frame(spark, "id label a b c".split(), [*rows, (90, None, 0.0, 0.0, 0.0)], "long int double double double")
    got = regimes.silhouette(df, ["a", "b", "c"], "label", "id").first()
    assert got["rows"] == 90 and got["silhouette"] == pytest.approx(silhouette(x, labels), abs=1e-12)
    assert regimes.silhouette(df, ["a"], "label", "id", most=40).first()["rows"] == 40
    for few in (df.where("label = 9"), df.where("label > 50")):
        assert regimes.silhouette(few, ["a"], "label", "id").first()["silhouette"] is None


def test_agreement_of_labelings_equals_pair_counts(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    df = frame(spark, ["a", "b"], [(int(x), int(y)) for x, y in zip(a, b, strict=True)], "int int")
    same = [(a[i] == a[j], b[i] == b[j]) for i, j in itertools.combinations(range(40), 2)]
    both, in_a, in_b = sum(x and y for x, y in same), sum(x for x, _ in same), sum(y for _, y in same)
    expected = in_a * in_b / len(same)
    want = (both - expected) / ((in_a + in_b) / 2 - expected)
    got = regimes.adjusted_rand(df, "a", "b").first()
    assert got["n"] == 40 and got["adjusted_rand"] == pytest.approx(want)
    assert regimes.adjusted_rand(df.withColumn("c", F.col("a") + 7), "a", "c").first()["adjusted_rand"] == pytest.approx(1.0)


def test_modes_are_mapped_only_one_to_one(spark):
    df = frame(spark, ["raw", "op_mode"], [(5, 0), (5, 0), (8, 1), (8, 1)], "int int")
    mapping = regimes.canonical_mapping(df, "raw", "op_mode")
    assert {(r.raw, r.op_mode, r.problem) for r in mapping.collect()} == {(5, 0, None), (8, 1, None)}
    again = regimes.apply_mapping(df.select("raw"), mapping.withColumnRenamed("op_mode", "mode"), "raw", "mode")
    assert sorted(r.mode for r in again.collect()) == [0, 0, 1, 1]
    torn = regimes.canonical_mapping(df.unionByName(frame(spark, ["raw", "op_mode"], [(5, 1)], "int int")), "raw", "op_mode")
    assert {r.problem for r in torn.collect()} == {"not_a_permutation"}


def test_nearest_centre_with_ties_takes_the_least(spark):
    df = frame(spark, ["a", "b"], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], "double double")
    got = regimes.assign_regime(df, ["a", "b"], np.array([[0.0, 0.0], [2.0, 0.0]]))
    assert [r.op_mode for r in got.orderBy("a").collect()] == [0, 0, 1]


CYCLES = [(1, c, 0, 1.0 * c, 2.0, 3.0, 4.0) for c in (1, 2, 3)]


@pytest.mark.parametrize(
    ("rows", "found"),
    [
        (CYCLES, set()),
        ([*CYCLES, (1, 5, 0, 0.0, 0.0, 0.0, 0.0)], {"gap"}),
        ([*CYCLES, CYCLES[0]], {"duplicate_key"}),
        ([*CYCLES, (None, 1, 0, 0.0, 0.0, 0.0, 0.0)], {"null_key"}),
    ],
)
def test_cycles_are_checked(spark, rows, found):
    df = frame(spark, "engine cycle op_mode op1 s1 s2 s3".split(), rows, "int int int double double double double")
    assert {r.check for r in checks.check_cycles(df).collect()} == found


def test_scoring_refuses_what_it_cannot_score(spark):
    names = "engine cycle op1 s1 s2 s3".split()
    good = [(1, c, 0.0, 1.0, 2.0, 3.0) for c in range(1, 11)]
    df = lambda rows: frame(spark, names, rows, "int double double double double double")
    found = lambda rows: {r.check for r in checks.check_inference_input(df([(e, float(c), *x) for e, c, *x in rows])).collect()}
    assert found(good) == set()
    assert found(good[:-1]) == {"too_short"}
    assert found([*good[:-1], (1, 10, 0.0, float("nan"), 2.0, 3.0)]) == {"not_finite"}
    assert found([*good[:-1], (1, 10, 0.0, None, 2.0, 3.0)]) == {"not_finite"}
    assert found([*good, (1, 10.5, 0.0, 1.0, 2.0, 3.0)]) == {"not_integral"}
    with pytest.raises(checks.Violation, match="unknown columns"):
        checks.check_inference_input(df([(e, float(c), *x) for e, c, *x in good]).withColumn("more", F.lit(1)))


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = frame(spark, list("abcd"), [tuple(map(float, r)) for r in x], "double double double double")
    model = detectors.fit_pca(df, list("abcd"), 0.8)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    keep = int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.8, side="right")) + 1
    main = vectors[:, ::-1][:, :keep]
    left = (x - x.mean(axis=0)) - (x - x.mean(axis=0)) @ main @ main.T
    got = sorted(r.raw_score for r in detectors.score_pca(df, list("abcd"), model).collect())
    assert model.components.shape == (keep, 4) and got == pytest.approx(sorted((left**2).mean(axis=1)))


def test_odd_rows_score_highest_by_every_detector(spark):
    rng = np.random.default_rng(2)
    roles = Roles(sensors=("s1",))
    # The third feature follows from the others, so that components leave a residual.
    free = rng.normal(size=(120, 2))
    rows = [(i, *map(float, (a, b, a + b + e))) for i, ((a, b), e) in enumerate(zip(free, 0.05 * rng.normal(size=120), strict=True))]
    typed = "long double double double"
    train = frame(spark, ["window_id", *roles.features], rows, typed)
    odd = frame(spark, ["window_id", *roles.features], [(900, 9.0, -9.0, 9.0), (901, 0.0, 0.0, 0.0)], typed)
    for detector, params in {d: p for d, p in DETECTOR_GRID}.items():
        got = {r.window_id: r for r in detectors.fit_score(train, odd, roles.features, detector, **params).collect()}
        assert got[900].raw_score > got[901].raw_score and got[900].alert_score == 1.0, detector


def test_profiles_and_comparison(spark):
    df = frame(spark, "engine cycle s1 s2 s3".split(), [(1, 1, 1.0, 5.0, None), (1, 2, 2.0, 5.0, float("inf")), (1, 3, 4.0, 5.0, 1.0)], "int int double double double")
    got = {r.sensor: r for r in profile.sensor_quality(df).collect()}
    assert (got["s3"].missing, got["s3"].not_finite) == (1, 1) and got["s2"].constant and not got["s1"].constant
    assert {(r.sensor_a, r.sensor_b): r.correlation for r in profile.correlations(df, ["s1"]).collect()} == {("s1", "s1"): pytest.approx(1.0)}
    other = frame(spark, ["cycle", "s1", "s2"], [(1, 1.0 + 1e-12, 5.0), (2, 2.5, 6.0), (9, 0.0, 0.0)], "int double double")
    found = {r.column: r for r in compare.compare_frames(df, other, ["cycle"], ["s2"], ["s1"]).collect()}
    assert {(r.rows, r.only_left, r.only_right) for r in found.values()} == {(4, 1, 1)}
    assert found["s1"].mismatches == 1 and found["s1"].max_abs_difference == pytest.approx(0.5) and found["s2"].mismatches == 1


def test_reference_of_the_stream_is_bounded_and_close(spark):
    from tidewatch.streaming.alerts import reference_steps

    values = np.random.default_rng(1).integers(0, 400, 1000) / 7
    df = frame(spark, ["raw_score"], [(float(v),) for v in values], "double")
    share = lambda steps, v: max((r.share for r in steps if r.raw_score <= v), default=0.0)
    whole, few = reference_steps(df, 1000).collect(), reference_steps(df, 50).collect()
    assert len(whole) == len(set(values)) and len(few) <= 50
    for v in (-1.0, *np.quantile(values, [0, 0.1, 0.5, 0.93, 1]), 99.0):
        true = (values <= v).mean()
        assert share(whole, v) == pytest.approx(true) and true - 1 / 50 <= share(few, v) <= true + 1e-12


def test_rows_that_cannot_be_scored_leave_a_gap():
    import pandas as pd

    from tidewatch.streaming.alerts import Entity, Scorer, advance

    roles = Roles(window=2, sensors=("s1",))
    scorer = Scorer.__new__(Scorer)
    scorer.roles, scorer.alpha, scorer.m = roles, 0.5, 1
    scorer.modes, scorer.mean, scorer.scale, scorer.limits = np.array([0]), np.zeros((1, 1)), np.ones((1, 1)), np.array([0.4])
    scorer.center, scorer.spread, scorer.pca_mean, scorer.left = np.zeros(3), np.ones(3), np.zeros(3), np.eye(3)
    scorer.values, scorer.share = np.array([1.0, 50.0]), np.array([0.0, 0.5, 1.0])
    rows = pd.DataFrame([(1, 1, 0, 1.0), (1, 2, 0, 2.0), (1, 3, 7, 1.0), (1, 4, 0, None), (1, 5, 3, 1.0), (1, 6, 0, 3.0), (1, 7, 0, 30.0), (1, 0, 0, 1.0)], columns=["engine", "cycle", "op_mode", "s1"])
    why = scorer.reasons(rows).tolist()
    assert why == [None, None, "mode", "values", "mode", None, None, "cycle"]
    good, state = rows[[w is None for w in why]], Entity()
    out = advance(scorer, 1, state, good["cycle"].to_numpy(), good["op_mode"].to_numpy(), good[["s1"]].to_numpy())
    # The next window starts after the rows that were left out.
    windows = [r for r in out if r["kind"] == "window"]
    assert [r["end_cycle"] for r in windows] == [2, 7] and state.last_cycle == 7
    assert windows[-1]["alert_score"] == windows[-1]["smoothed_score"] == 1.0


def test_a_timeline_has_its_columns(spark):
    from tidewatch.plans import catalog

    rows = catalog.ml20_infer(spark, "/root/testdata/sf0.001")
    assert len(rows.columns) == 21
    one = rows.agg(F.count("*").alias("n"), F.count_distinct("window_id").alias("ids"), F.max("attribution_completeness_abs_difference").alias("gap"), F.count_if(~F.col("calibrated_score").between(0, 1)).alias("out")).first()
    assert one["n"] == one["ids"] > 0 and one["gap"] < 1e-9 and one["out"] == 0


def test_a_detector_study_scales_once_and_equals_fits_one_at_a_time(spark):
    from tidewatch.operators import metrics, proxies
    from tidewatch.plans import study
    from tidewatch.sources import scratch

    roles, rng = Roles(), np.random.default_rng(31)
    rows = [(*map(float, rng.normal(size=9) + (e % 3)), f"{s}:e{e:03d}:c{c:04d}", e, s, c - 9, c, 40, 0) for e in range(8) for s in (("train", "validation")[e % 2],) for c in range(10, 41)]
    features = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in roles.features) + ", window_id string, engine int, split string, start_cycle int, end_cycle int, max_cycle int, op_mode int")
    prepared = {"one": features, "two": features.withColumn("mean_s1", F.col("mean_s1") * F.col("std_s2"))}
    grid = [("pca", {"variance": 0.5}), ("lof", {"neighbors": 2}), ("lof", {"neighbors": 200})]
    written = scratch._WRITTEN.setdefault(spark.sparkContext.applicationId, [])
    before = len(written)
    made = study.detector_study(prepared, grid)
    tables = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in written[before:]]
    # One scaling of each preprocessing, and a search of neighbours for each fit and each scoring of all settings.
    assert tables.count("train") == 2 and tables.count("near_found") == 4
    got = {(r.preprocessing, r.detector_id, r.parameter_set): (r.mean_pr_auc, r.mean_roc_auc) for r in made.ranking.collect()}
    assert len(got) == 6 and {r.detector_id for r in made.best.collect()} == {"pca", "lof"}
    for name, detector, params in (("one", *grid[0]), ("two", *grid[1]), ("two", *grid[2])):
        scores = detectors.fit_score(study.eligible_training(prepared[name]), prepared[name].where("split = 'validation'"), roles.features, detector, **params)
        alone = metrics.mean_ranking(metrics.ranking_metrics(proxies.apply_policies(scores, proxies.policy_table(spark)))).first()
        setting = ",".join(f"{k}={v}" for k, v in params.items())
        assert got[name, detector, setting] == pytest.approx((alone.mean_pr_auc, alone.mean_roc_auc))
