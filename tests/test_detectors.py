"""Neighbours by pivot cells, batched clusterings and packed forests against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import order
from tidewatch.operators import detectors, regimes, thresholds
from tidewatch.schema import DETECTOR_GRID


def points(spark, x, ids=None):
    return spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, x array<double>")


def by_hand(ref, ids, queries, k, own=None):
    out = []
    for n, q in enumerate(queries):
        d = np.sqrt(((ref - q) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if own is None or ids[j] != own[n]][:k]
        out.append((ids[order].tolist(), d[order].tolist()))
    return out


def cases():
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 50, (12, 4))
    yield "random", rng.normal(size=(300, 3)), 1000
    yield "clustered", (middle[rng.integers(0, 12, 600)] + rng.normal(0, 0.3, (600, 4))), 1000
    yield "repeated", np.repeat(rng.normal(size=(5, 2)), 60, axis=0), 1000
    yield "one point", np.zeros((150, 2)), 1000
    yield "grid of ties", np.stack(np.meshgrid(range(12), range(12)), axis=-1).reshape(-1, 2).astype(float), 1000
    yield "far from zero", 1e7 + rng.integers(0, 3, (200, 2)).astype(float), 1000


@pytest.mark.parametrize("name, x, top", list(cases()), ids=[n for n, *_ in cases()])
@pytest.mark.parametrize("other", [True, False])
def test_neighbours_equal_brute_force(spark, name, x, top, other):
    rng = np.random.default_rng(5)
    ids = rng.permutation(top)[: len(x)]
    k = 7
    ref = points(spark, x, ids).repartition(3)
    queries = ref if other else points(spark, np.concatenate((x[:20], x[:10] + 0.5, x[:3] * 3)))
    asked = {r.id: np.array(r.x) for r in queries.collect()}
    rows = detectors.nearest(ref, queries, k, other, block=64).collect()
    assert sorted(r.id for r in rows) == sorted(asked)
    want = by_hand(x, ids, [asked[r.id] for r in rows], k, [r.id for r in rows] if other else None)
    for r, (near, dist) in zip(rows, want, strict=True):
        assert r.near == near and np.allclose(r.dist, dist), (name, r.id)


def test_cells_spare_most_comparisons(spark):
    rng = np.random.default_rng(6)
    middle = rng.normal(0, 100, (40, 5))
    x = middle[rng.integers(0, 40, 4000)] + rng.normal(0, 0.5, (4000, 5))
    ref = points(spark, x)
    rows = detectors.nearest(ref, ref, 10, True).select("met").collect()
    assert sum(r.met for r in rows) < 0.1 * len(x) ** 2
    assert detectors.nearest(ref, ref.limit(0), 5, True).count() == 0
    few = detectors.nearest(ref.limit(2), ref.limit(2), 5, True).collect()
    assert all(len(r.near) == 1 for r in few)
    assert detectors.nearest(ref.limit(0), ref.limit(2), 5, False).where("size(near) = 0").count() == 2


def lloyd(x, start):
    c = start.copy()
    for _ in range(200):
        at = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))])
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    return c, float(((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_fits_at_once_equal_fits_one_at_a_time(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 0.4, (60, 2)) for m in ((0, 0), (6, 0), (0, 6), (6, 6))])
    rows = spark.createDataFrame([(i % 12, float(a), float(b)) for i, (a, b) in enumerate(x)], "engine int, a double, b double").repartition(4)
    fits = [*regimes.restarts_of("all 4", 4, 5, 42), *regimes.restarts_of("all 6", 6, 5, 42), *regimes.stability_fits(4, (1, 2, 3))]
    made = regimes.fit_many(rows, ["a", "b"], fits, "engine")
    assert len(made) == 10 + 15
    for f in (fits[0], fits[7], fits[12]):
        alone = regimes.fit_many(rows.repartition(2), ["a", "b"], [f], "engine")[f.name]
        assert np.allclose(alone[0], made[f.name][0]) and alone[1] == pytest.approx(made[f.name][1])
    # A rest point of Lloyd's iterations, and the clusters that there are.
    best = regimes.cheapest(made, "all 4")
    rest, cost = lloyd(x, best)
    assert np.allclose(np.sort(rest, axis=0), np.sort(best, axis=0), atol=1e-5)
    assert cost == pytest.approx(lloyd(x, np.array([(0, 0), (6, 0), (0, 6), (6, 6)], float))[1])
    assert min(made[f"all 4/{i}"][1] for i in range(5)) == pytest.approx(cost)
    # A share holds its entities alone.
    share = rows.where(F.pmod(F.xxhash64("engine", F.lit(2)), F.lit(1_000_000)) / 1e6 < 0.8)
    part = np.array([(r.a, r.b) for r in share.collect()])
    assert made["share 4 2/0"][1] == pytest.approx(float(((part[:, None] - made["share 4 2/0"][0][None]) ** 2).sum(axis=2).min(axis=1).sum()))
    got = regimes.regime_stability(rows, rows, ["a", "b"], 4, (1, 2, 3)).collect()
    assert {(r.seed_a, r.seed_b) for r in got} == {(1, 2), (1, 3), (2, 3)} and all(r.adjusted_rand == pytest.approx(1.0) for r in got)


def test_fits_of_few_and_equal_rows(spark):
    rows = spark.createDataFrame([(1, 2.0)] * 30 + [(2, 5.0)] * 3, "engine int, a double")
    made = regimes.fit_many(rows, ["a"], regimes.restarts_of("x", 4, 2, 1))
    assert regimes.cheapest(made, "x").tolist() == [[2.0], [5.0]] and made["x/0"][1] == 0.0
    assert regimes.fit_many(rows.limit(0), ["a"], regimes.restarts_of("x", 4, 1, 1))["x/0"][0].shape == (0, 1)


def test_agreement_of_groups_equals_that_of_each(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(a), int(a if rng.random() < 0.6 else rng.integers(0, 3))) for g in range(3) for a in rng.integers(0, 3, 80)]
    table = spark.createDataFrame(rows, "g int, a int, b int")
    got = {r.g: r.adjusted_rand for r in regimes.adjusted_rand(table, "a", "b", ["g"]).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(regimes.adjusted_rand(table.where(F.col("g") == g), "a", "b").first().adjusted_rand)


def test_rows_enter_trees_by_chance_and_by_themselves():
    h = np.arange(20_000) * 7919 + 5
    row, tree = detectors._trees_of(h, 50, 0.03, 42)
    counts = np.bincount(tree, minlength=50)
    assert abs(len(row) - 0.03 * 50 * len(h)) < 5 * np.sqrt(0.03 * 50 * len(h)) and counts.min() > 450 and counts.max() < 760
    assert len(set(zip(row.tolist(), tree.tolist(), strict=True))) == len(row)
    part = detectors._trees_of(h[5000:6000], 50, 0.03, 42)
    pairs = {(r - 5000, t) for r, t in zip(row.tolist(), tree.tolist(), strict=True) if 5000 <= r < 6000}
    assert pairs == set(zip(part[0].tolist(), part[1].tolist(), strict=True))
    assert len(detectors._trees_of(h[:10], 4, 1.0, 1)[0]) == 40


def test_forest_scores_equal_a_walk_through_its_nodes(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.normal(size=(600, 3)), [[9.0, 9.0, 9.0]], np.zeros((5, 3))))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "key int, a double, b double, c double").repartition(3)
    cols = ["a", "b", "c"]
    forest = detectors.fit_forest(rows, cols, trees=40, most=128)
    trees = forest.orderBy("tree").collect()
    assert len(trees) == 40 and all(t.rows == 128 for t in trees)
    for t in trees:
        depth = [0] * len(t.feature)
        for i, f in enumerate(t.feature):
            if f >= 0:
                depth[t.left[i]] = depth[t.left[i] + 1] = depth[i] + 1
        assert max(depth) <= 7
    got = {r.key: r.raw_score for r in detectors.score_forest(rows, cols, forest).collect()}
    for k in (0, 17, 600, 602):
        paths = []
        for t in trees:
            i = 0
            while t.feature[i] >= 0:
                i = t.left[i] + (x[k][t.feature[i]] > t.cut[i])
            paths.append(t.path[i])
        assert got[k] == pytest.approx(2 ** (-np.mean(paths) / float(detectors._path(np.array([128]))[0])))
    assert got[600] > np.quantile(list(got.values()), 0.99)
    again = {r.key: r.raw_score for r in detectors.score_forest(rows, cols, detectors.fit_forest(rows.repartition(7), cols, trees=40, most=128)).collect()}
    assert again == got
    same = spark.createDataFrame([(i, 1.0) for i in range(9)], "key int, a double")
    assert len({r.raw_score for r in detectors.score_forest(same, ["a"], detectors.fit_forest(same, ["a"], 5, 256)).collect()}) == 1


def test_the_registered_grid_is_what_the_study_runs(spark):
    printed = sorted(tuple(sorted(p.params.values())) for p in thresholds.detector_grid(spark).collect())
    assert printed == sorted(tuple(sorted(float(v) for v in p.values())) for _, p in DETECTOR_GRID)
    assert [p for d, p in DETECTOR_GRID if d == "isolation_forest"] == [{"most": m, "trees": 300} for m in (256, 1024, 5000)]


def test_ranks_of_a_value_that_most_rows_share(spark):
    rng = np.random.default_rng(11)
    rows = [(i, 7 if rng.random() < 0.9 else int(rng.integers(0, 15))) for i in rng.permutation(4000).tolist()]
    table = spark.createDataFrame([*rows, (9000, None)], "engine int, max_cycle int").repartition(5)
    got = {r.engine: r.rank for r in order.row_rank(table, "max_cycle", ["engine"], "rank", 16).collect()}
    assert got == {e: k for k, (m, e) in enumerate(sorted((m, e) for e, m in rows), 1)}
    sizes = [r["count"] for r in order.in_ranges(table, ["max_cycle", "engine"], 16).groupBy("__range").count().collect()]
    assert len(sizes) > 12 and max(sizes) < 3 * 4000 / 16


def exact_one_class(x, gamma, nu):
    """The kernel one-class dual by projected gradients with momentum: (score of any rows, rho)."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    n, top = len(x), 1 / (nu * len(x))

    def project(a):
        lo, hi = a.min() - 1, a.max()
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.clip(a - mid, 0, top).sum() > 1 else (lo, mid)
        return np.clip(a - hi, 0, top)

    a = project(np.full(n, 1 / n))
    b, t, rate = a.copy(), 1.0, 1 / np.linalg.eigvalsh(k)[-1]
    for _ in range(3000):
        new = project(b - rate * (k @ b))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        b, a, t = new + (t - 1) / after * (new - a), new, after
    f = k @ a
    free = (a > 1e-4 * top) & (a < top * (1 - 1e-4))
    return f, float(np.median(f[free]))


def test_one_class_signs_are_those_of_the_exact_kernel(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate((rng.normal(size=(700, 4)), rng.normal(3, 0.5, (270, 4)), rng.uniform(-8, 8, (30, 4))))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "key int, a double, b double, c double, d double").repartition(3)
    cols = ["a", "b", "c", "d"]
    for nu in (0.05, 0.2):
        state = detectors.fit_one_class(rows, cols, nu)
        f, rho = exact_one_class(x, state["gamma"], nu)
        got = {r.key: r.raw_score for r in detectors.score_one_class(rows, cols, state).collect()}
        same = sum((got[i] > 0) == (f[i] < rho) for i in range(len(x)))
        assert same >= 0.98 * len(x), (nu, same)
        assert abs(sum(v > 0 for v in got.values()) / len(x) - nu) < 0.02 and 0 <= state["error"] < 0.1
    same = spark.createDataFrame([(1, 2.0)] * 8, "key int, a double")
    assert all(np.isfinite(r.raw_score) for r in detectors.score_one_class(same, ["a"], detectors.fit_one_class(same, ["a"])).collect())


def test_fits_are_the_same_bits_however_rows_are_dealt(spark):
    rng = np.random.default_rng(21)
    x = np.concatenate((rng.normal(3e4, 0.1, (2000, 1)), rng.lognormal(0, 3, (2000, 1)), rng.normal(size=(2000, 1)) * 1e-7), axis=1)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "key int, a double, b double, c double")
    cols, fits = ["a", "b", "c"], []
    for dealt in (rows.coalesce(1), rows.repartition(3), rows.repartition(7, "b"), rows.orderBy(F.desc("c"))):
        scaler = detectors.fit_feature_scaler(dealt, cols)
        mean, cov = detectors.covariance(detectors.standardize(dealt, scaler), cols)
        fits.append((scaler, mean.tolist(), cov.tolist()))
    assert all(f == fits[0] for f in fits)
    scaler, mean, cov = fits[0]
    assert np.allclose([scaler[c][0] for c in cols], x.mean(axis=0)) and np.allclose([scaler[c][1] for c in cols], x.std(axis=0))
    assert np.allclose(cov, np.cov((x - x.mean(axis=0)) / x.std(axis=0), rowvar=False), atol=1e-9) and np.allclose(mean, 0, atol=1e-9)
    odd = rows.withColumn("a", F.when(F.col("key") > 5, F.col("a"))).withColumn("b", F.lit(float("nan"))).withColumn("c", F.lit(2.0))
    made = detectors.fit_feature_scaler(odd, cols)
    assert made["a"] == (pytest.approx(x[6:, 0].mean()), pytest.approx(x[6:, 0].std())) and made["c"] == (2.0, 1.0) and np.isnan(made["b"][0])


def test_cut_points_of_running_counts_are_drawn_once(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), F.rand(1).alias("v"))
    got = order.running(rows, ["g"], "v", {"n": "1"})
    assert "percentile_approx" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.groupBy("g").agg(F.max("n_upto").alias("n"), F.count("*").alias("m")).where("n <> m").count() == 0 and got.count() == 3000


def test_spread_rows_and_copies_meet_few_others(spark):
    rng = np.random.default_rng(22)
    x = np.tile(rng.normal(size=(1500, 5)), (4, 1))
    ref = points(spark, x).repartition(3)
    rows = detectors.nearest(ref, ref, 10, True).collect()
    want = by_hand(x, np.arange(len(x)), [x[r.id] for r in rows[:60]], 10, [r.id for r in rows[:60]])
    assert all(r.near == near and np.allclose(r.dist, dist) for r, (near, dist) in zip(rows, want, strict=False))
    assert len(rows) == len(x) and sum(r.met for r in rows) < 0.5 * len(x) ** 2


def test_outlier_factors_take_ties_by_other_columns(spark):
    # On a grid many neighbours are equally far; those of the least key count, however rows are dealt.
    x = np.stack(np.meshgrid(range(9), range(9)), axis=-1).reshape(-1, 2) ** 1.5
    rows = spark.createDataFrame([(f"w{i:03d}", *map(float, v)) for i, v in enumerate(x)], "key string, a double, b double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    far = d + np.where(np.eye(len(x)) > 0, np.inf, 0)
    near, k = np.argsort(far, axis=1, kind="stable")[:, :6], 6
    kd = np.take_along_axis(far, near, axis=1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(far, near, axis=1), kd[near]).mean(axis=1) + 1e-10)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    want = lrd[at].mean(axis=1) * (np.maximum(np.take_along_axis(d, at, axis=1), kd[at]).mean(axis=1) + 1e-10)
    for dealt in (rows, rows.orderBy(F.desc("key")).coalesce(1), rows.repartition(5)):
        got = {r.key: r.raw_score for r in detectors.score_lof(rows, ["a", "b"], detectors.fit_lof(dealt, ["a", "b"], k)).collect()}
        assert np.allclose([got[f"w{i:03d}"] for i in range(len(x))], want)
