"""Operating regimes: clustering of settings, canonical labels and cluster quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mixed
from ..schema import Roles
from ..sources.scratch import cut


@dataclass(frozen=True)
class Fit:
    """One clustering to fit: ``k`` centres from seeded starts, on all rows or on a seeded share of the entities."""

    name: str
    k: int
    seed: int
    share: float = 1.0
    share_seed: int = 0


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, the least on ties, and the squared distance to it."""
    d = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _batches(frames):
    for f in frames:
        if len(f):
            yield np.stack(f["x"]).astype(float), f["h"].to_numpy(), np.stack(f["m"]).astype(bool)


def _sums(data: DataFrame, centers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(rows of each centre, their sums, cost) of every set of centres: one aggregation for all of them."""
    sent = data.sparkSession.sparkContext.broadcast(centers)

    def run(frames):
        held: dict[tuple[int, int, int], float] = {}
        for x, _, m in _batches(frames):
            for f, c in enumerate(sent.value):
                part = x[m[:, f]]
                if not len(part):
                    continue
                at, d = _nearest(part, c)
                held[f, 0, -1] = held.get((f, 0, -1), 0.0) + float(d.sum())
                for dim, v in [(-2, None), *enumerate(part.T)]:
                    for i, total in enumerate(np.bincount(at, v, len(c)).tolist()):
                        held[f, i, dim] = held.get((f, i, dim), 0.0) + total
        yield pd.DataFrame([(*k, v) for k, v in held.items()], columns=["f", "c", "dim", "v"])

    # A row for each set, centre and dimension: a size that parameters bound.
    got = {(r[0], r[1], r[2]): r[3] for r in data.mapInPandas(run, "f long, c long, dim long, v double").groupBy("f", "c", "dim").agg(F.sum("v")).collect()}
    sent.unpersist()
    return [(np.array([got.get((f, i, -2), 0.0) for i in range(len(c))]), np.array([[got.get((f, i, d), 0.0) for d in range(c.shape[1])] for i in range(len(c))]), got.get((f, 0, -1), 0.0)) for f, c in enumerate(centers)]


def _drawn(data: DataFrame, fits: Sequence[Fit], centers: list[np.ndarray], costs: Sequence[float], step: int, most: int) -> list[np.ndarray]:
    """Rows drawn for each fit with a chance of 2 k times their share of its cost, at most ``most``: those of least draw."""
    sent = data.sparkSession.sparkContext.broadcast((centers, list(costs)))

    def run(frames):
        sets, total = sent.value
        for x, h, m in _batches(frames):
            for f, fit in enumerate(fits):
                if total[f] > 0 and m[:, f].any():
                    part, u = x[m[:, f]], mixed(h[m[:, f]], fit.seed, step)
                    chance = 2 * fit.k * _nearest(part, sets[f])[1] / total[f]
                    hit = u < chance
                    if not hit.any():
                        continue
                    yield pd.DataFrame({"f": np.full(int(hit.sum()), f), "u": (u[hit] / chance[hit]), "x": list(part[hit])})

    first = F.row_number().over(Window.partitionBy("f").orderBy("u", "x"))
    rows = data.mapInPandas(run, "f long, u double, x array<double>").withColumn("__r", first).where(F.col("__r") <= most).collect()
    sent.unpersist()
    return [np.array([r["x"] for r in rows if r["f"] == f], float).reshape(-1, centers[f].shape[1]) for f in range(len(fits))]


def _weighted_start(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` distinct points: seeded draws by weight and squared distance, then weighted means until they rest."""
    points, inverse = np.unique(points, axis=0, return_inverse=True)
    weights = np.bincount(inverse.ravel(), weights, len(points))
    rng, chosen = np.random.default_rng(seed), []
    away = np.ones(len(points))
    while len(chosen) < min(k, len(points)):
        p = np.maximum(weights, 1e-12) * away
        if not p.sum() > 0:
            break
        chosen.append(int(rng.choice(len(points), p=p / p.sum())))
        away = _nearest(points, points[chosen])[1]
    c = points[chosen]
    for _ in range(30):
        at = _nearest(points, c)[0]
        n = np.bincount(at, weights, len(c))
        new = np.where(n[:, None] > 0, np.stack([np.bincount(at, weights * v, len(c)) for v in points.T], axis=1) / np.maximum(n, 1e-300)[:, None], c)
        if np.allclose(new, c, rtol=0, atol=1e-12):
            break
        c = new
    return c


def fit_many(rows: DataFrame, cols: Sequence[str], fits: Sequence[Fit], entity: str | None = None, rounds: int = 4, iterations: int = 50, tol: float = 1e-6) -> dict[str, tuple[np.ndarray, float]]:
    """Centres in lexicographic order and inertia of every fit, by name; all fits move in the same jobs.

    Starts are k-means||: one row of least hash, ``rounds`` seeded draws of about 2 k rows
    in proportion to their squared distance, and a weighted clustering of what was drawn.
    Then every iteration is one aggregation over all sets of centres, until no centre of a
    fit moves by more than ``tol``; fits that rest go on without being computed.  With fewer
    distinct rows than ``k`` there are fewer centres; without rows none.
    """
    share = lambda f: F.pmod(F.xxhash64(entity, F.lit(f.share_seed)), F.lit(1_000_000)) / 1e6 < f.share if f.share < 1 else F.lit(True)
    hashed = F.xxhash64(*([entity] if entity else []), *cols)
    data = cut(rows.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), hashed.alias("h"), F.array(*[share(f) for f in fits]).alias("m")), "clustering")
    d = len(cols)
    first = data.select("x", "m", F.posexplode(F.array(*[F.xxhash64("h", F.lit(f.seed)) for f in fits])).alias("f", "u")).where(F.get("m", F.col("f")))
    starts = {r["f"]: np.array([r["b"]["x"]], float) for r in first.groupBy("f").agg(F.min(F.struct("u", "x")).alias("b")).collect()}
    live = [i for i in range(len(fits)) if i in starts]
    data = data.select("x", "h", F.array(*[F.get("m", F.lit(i)) for i in live]).alias("m")) if live else data
    chosen, sets = [fits[i] for i in live], [starts[i] for i in live]
    for step in range(rounds if live else 0):
        costs = [cost for *_, cost in _sums(data, sets)]
        more = _drawn(data, chosen, sets, costs, step, 8 * max(f.k for f in chosen))
        sets = [np.concatenate((a, b)) for a, b in zip(sets, more, strict=True)]
    if live:
        sets = [_weighted_start(c, n, f.k, f.seed) for f, c, (n, *_) in zip(chosen, sets, _sums(data, sets), strict=True)]
    moving, inertia = list(range(len(live))), [0.0] * len(live)
    for step in range(iterations + 1):
        if not moving:
            break
        part = data.select("x", "h", F.array(*[F.get("m", F.lit(i)) for i in moving]).alias("m"))
        rest = []
        for i, (n, total, cost) in zip(moving, _sums(part, [sets[i] for i in moving]), strict=True):
            inertia[i] = cost
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sets[i])
            if step < iterations and np.abs(new - sets[i]).max() > tol:
                rest.append(i)
                sets[i] = new
        moving = rest
    ordered = [c[np.lexsort(np.round(c, 9).T[::-1])] for c in sets]
    out = {f.name: (np.empty((0, d)), 0.0) for f in fits}
    return out | {f.name: (c, cost) for f, c, cost in zip(chosen, ordered, inertia, strict=True)}


def restarts_of(name: str, k: int, restarts: int, seed: int, share: float = 1.0) -> list[Fit]:
    """Fits of one clustering from several starts; those of a share are of the same entities, drawn by ``seed``."""
    return [Fit(f"{name}/{i}", k, seed + i, share, seed) for i in range(restarts)]


def cheapest(made: dict[str, tuple[np.ndarray, float]], name: str) -> np.ndarray:
    """The centres of least inertia among the restarts of ``name``; of equal ones the first."""
    return min((v for k, v in made.items() if k.rpartition("/")[0] == name), key=lambda v: v[1])[0]


def fit_regimes(rows: DataFrame, cols: Sequence[str], k: int, restarts: int = 5, seed: int = 42) -> np.ndarray:
    """Centroids (k, columns), the cheapest of ``restarts`` seeded fits, in lexicographic order: label = place."""
    return cheapest(fit_many(rows, cols, restarts_of("regimes", k, restarts, seed)), "regimes")


def squared_distance(cols: Sequence[str], center: Sequence[float]) -> Column:
    return sum((F.pow(F.col(c) - F.lit(float(v)), F.lit(2.0)) for c, v in zip(cols, center, strict=True)), F.lit(0.0))


def assign_regime(rows: DataFrame, cols: Sequence[str], centers: np.ndarray, out: str = "op_mode") -> DataFrame:
    """``rows`` with the number of the nearest centroid, the least on ties: one native expression."""
    options = F.array(*[F.struct(squared_distance(cols, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)])
    return rows.withColumn(out, F.array_min(options)["i"].cast("int"))


def canonical_mapping(rows: DataFrame, raw: str, canonical: str) -> DataFrame:
    """(raw, canonical, problem): each raw label's canonical one; problem tells where that is no bijection."""
    pairs = rows.groupBy(raw, canonical).agg(F.count("*").alias("n"))
    a = pairs.groupBy(raw).agg(F.count("*").alias("__a"))
    b = pairs.groupBy(canonical).agg(F.count("*").alias("__b"))
    return pairs.join(a, raw).join(b, canonical).select(raw, canonical, "n", F.when((F.col("__a") > 1) | (F.col("__b") > 1), "not_a_permutation").alias("problem"))


def apply_mapping(rows: DataFrame, mapping: DataFrame, raw: str, canonical: str) -> DataFrame:
    return rows.join(F.broadcast(mapping.select(raw, canonical)), raw)


def mode_occupancy(rows: DataFrame, modes: int, roles: Roles = Roles()) -> DataFrame:
    """(op_mode, rows, row_share, engines, engine_share), empty modes kept."""
    every = rows.sparkSession.range(modes).select(F.col("id").cast("int").alias(roles.mode))
    per = rows.groupBy(roles.mode).agg(F.count("*").alias("rows"), F.count_distinct(roles.entity).alias("engines"))
    total = rows.agg(F.count("*").alias("__r"), F.count_distinct(roles.entity).alias("__e"))
    out = every.join(per, roles.mode, "left").crossJoin(F.broadcast(total)).fillna(0, ["rows", "engines"])
    return out.select(roles.mode, "rows", F.try_divide(F.col("rows").cast("double"), F.col("__r")).alias("row_share"), "engines", F.try_divide(F.col("engines").cast("double"), F.col("__e")).alias("engine_share"))


def mode_centroids(rows: DataFrame, cols: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Centre and population deviation of each setting within its mode, in original units."""
    return rows.groupBy(roles.mode).agg(*[x for c in cols for x in (F.avg(c).alias(f"center_{c}"), F.stddev_pop(c).alias(f"spread_{c}"))])


def adjusted_rand(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, adjusted_rand): agreement of two labelings, from their contingency counts; 1 if both are trivial."""
    by = list(by)
    pairs = rows.groupBy(*by, a, b).agg(F.count("*").cast("double").alias("n"))
    two = lambda n: n * (n - 1) / 2
    ij = pairs.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    sa = pairs.groupBy(*by, a).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(two(F.col("m"))).alias("sa"))
    sb = pairs.groupBy(*by, b).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(two(F.col("m"))).alias("sb"))
    out = ij.join(sa, by).join(sb, by) if by else ij.crossJoin(sa).crossJoin(sb)
    expected = F.try_divide(F.col("sa") * F.col("sb"), two(F.col("n")))
    index = F.try_divide(F.col("ij") - expected, (F.col("sa") + F.col("sb")) / 2 - expected)
    return out.select(*by, F.col("n").cast("long").alias("n"), F.coalesce(index, F.lit(1.0)).alias("adjusted_rand"))


def silhouette(rows: DataFrame, cols: Sequence[str], label: str, key: str, most: int = 5_000, seed: int = 42) -> DataFrame:
    """One row (rows, silhouette): mean Euclidean silhouette of a seeded sample of at most ``most`` rows.

    The sample is part of the statistic: the rows of least MD5 of seed and key, which bounds
    what is broadcast.  Rows without a label are left out; null with fewer than two labels.
    """
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    point = F.array(*[F.col(c).cast("double") for c in cols])
    drawn = rows.where(F.col(label).isNotNull()).select(key, label, point.alias("__x")).orderBy(mark, key).limit(most)
    sample = cut(drawn, "silhouette")
    held = sample.select(label, "__x").toPandas().sort_values(label, kind="stable")
    names, starts, sizes = np.unique(held[label].to_numpy(), return_index=True, return_counts=True)
    points = np.stack(held["__x"]) if len(held) else np.empty((0, len(cols)))
    sent = rows.sparkSession.sparkContext.broadcast((points, names, starts, sizes))

    def run(batches):
        x, names, starts, sizes = sent.value
        for f in batches:
            mine, own = np.stack(f["__x"]) if len(f) else np.empty((0, x.shape[1])), np.searchsorted(names, f[label].to_numpy())
            for a in range(0, len(f), 16):
                part, at = own[a : a + 16], np.arange(len(own[a : a + 16]))
                away = np.sqrt(((mine[a : a + 16, None, :] - x[None, :, :]) ** 2).sum(axis=2))
                total = np.add.reduceat(away, starts, axis=1)
                near = total[at, part] / np.maximum(sizes[part] - 1, 1)
                mean = total / sizes
                mean[at, part] = np.inf
                far = mean.min(axis=1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(sizes[part] == 1, 0.0, (far - near) / np.maximum(near, far))
                yield pd.DataFrame({"value": np.where(np.isfinite(far), value, np.nan)})

    each = sample.repartition(32).mapInPandas(run, "value double")
    return each.agg(F.count("*").alias("rows"), F.avg(F.when(~F.isnan("value"), F.col("value"))).alias("silhouette"))


def cluster_quality(rows: DataFrame, cols: Sequence[str], centers: np.ndarray, roles: Roles = Roles()) -> DataFrame:
    """One row (inertia_per_row, min_centroid_distance, min_row_share)."""
    nearest = F.array_min(F.array(*[squared_distance(cols, c) for c in centers]))
    inertia = rows.agg(F.avg(nearest).alias("inertia_per_row"))
    spark = rows.sparkSession
    c = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(centers)], "i int, v array<double>")
    o = c.select(F.col("i").alias("j"), F.col("v").alias("u"))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "u", lambda a, b: (a - b) * (a - b)), F.lit(0.0).cast("double"), lambda a, x: a + x))
    least = c.join(o, F.col("i") < F.col("j")).agg(F.min(gap).alias("min_centroid_distance"))
    share = mode_occupancy(rows, len(centers), roles).agg(F.min("row_share").alias("min_row_share"))
    return inertia.crossJoin(least).crossJoin(share)


def stability_fits(k: int, seeds: Sequence[int] = (1, 2, 3, 4, 5), fraction: float = 0.8, restarts: int = 5) -> list[Fit]:
    """The fits that ``agreement`` of ``k`` clusters compares: several starts for each seeded share of the entities."""
    return [f for s in seeds for f in restarts_of(f"share {k} {s}", k, restarts, s, fraction)]


def agreement(rows: DataFrame, cols: Sequence[str], made: Mapping[str, tuple[np.ndarray, float]], k: int, seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """(seed_a, seed_b, adjusted_rand) of the labels of ``rows`` by the fits of every two seeds: one pass over the rows."""
    labelled = rows.select(*cols)
    for s in seeds:
        labelled = assign_regime(labelled, cols, cheapest(made, f"share {k} {s}"), f"__m{s}")
    pairs = [F.struct(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), F.col(f"__m{a}").alias("label_a"), F.col(f"__m{b}").alias("label_b")) for i, a in enumerate(seeds) for b in seeds[i + 1 :]]
    every = labelled.select(F.inline(F.array(*pairs)))
    return adjusted_rand(every, "label_a", "label_b", ["seed_a", "seed_b"]).select("seed_a", "seed_b", "adjusted_rand")


def regime_stability(train: DataFrame, validation: DataFrame, cols: Sequence[str], k: int, seeds: Sequence[int] = (1, 2, 3, 4, 5), fraction: float = 0.8, roles: Roles = Roles(), restarts: int = 5) -> DataFrame:
    """(seed_a, seed_b, adjusted_rand) of labels of ``validation`` by fits on seeded shares of the entities, all fitted at once."""
    return agreement(validation, cols, fit_many(train, cols, stability_fits(k, seeds, fraction, restarts), roles.entity), k, seeds)
