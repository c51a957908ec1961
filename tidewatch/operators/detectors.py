"""Anomaly detectors over feature columns: fit on training rows, score any rows.

Every detector is a pair fit(rows, cols) -> state and score(rows, cols, state) -> rows with
``raw_score``, greater for odder rows.  States are small and bounded by parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import mixed
from ..functions.scalars import mean_square

Z = "__z"


#: Steps of the two whole numbers that a number becomes in an exact sum, as a power of two.
STEP = 30


def _top(x: float) -> float:
    """A power of two that isn't below ``x``: numbers are divided by it without rounding."""
    return 2.0 ** np.ceil(np.log2(x)) if x > 0 else 1.0


def _exact(sums: tuple[int, int], n: int) -> float:
    """A mean from ``n`` and the sums of both whole numbers, rounded once."""
    return ((int(sums[0]) << STEP) + int(sums[1])) / (n << 2 * STEP) if n else 0.0


def _exact_means(rows: DataFrame, values: Sequence[Column]) -> list[float]:
    """Means of numbers of size 4 at most; no order of rows or tasks changes a bit of them.

    Doubles lose other bits in every order; a number is told in steps of 2 ** -60 by two
    whole numbers here, whose sums are exact.
    """
    aggs, step = [], F.lit(2.0**STEP)
    for i, v in enumerate(values):
        high = F.rint(v * step)
        low = F.rint((v * step - high) * step)
        aggs += [F.sum(high.cast("long")).alias(f"h{i}"), F.sum(low.cast("long")).alias(f"l{i}"), F.count(v).alias(f"n{i}")]
    r = rows.agg(*aggs).first()
    return [_exact((r[f"h{i}"] or 0, r[f"l{i}"] or 0), r[f"n{i}"]) for i in range(len(values))]


def fit_feature_scaler(rows: DataFrame, cols: Sequence[str], eps: float = 1e-9) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature (1 where it hardly varies); they are the same bits however rows are dealt."""
    r = rows.agg(*[F.max(F.abs(c)).alias(c) for c in cols]).first()
    # Columns that hold undefined numbers have no mean.
    tops = {c: _top(r[c] or 0.0) for c in cols if np.isfinite(r[c] or 0.0)}
    small = lambda c: F.col(c).cast("double") / F.lit(tops[c])
    means = dict(zip(tops, _exact_means(rows, [small(c) for c in tops]), strict=True)) if tops else {}
    off = [small(c) - F.lit(m) for c, m in means.items()]
    more = _exact_means(rows, [*[d * d for d in off], *off]) if tops else []
    scale = {c: tops[c] * float(np.sqrt(max(more[i] - more[i + len(tops)] ** 2, 0.0))) for i, c in enumerate(tops)}
    return {c: (tops[c] * means[c], scale[c] if scale[c] > eps else 1.0) if c in tops else (float("nan"), 1.0) for c in cols}


def standardize(rows: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


@dataclass
class PCA:
    """Components (kept, features) of the covariance; mean of the features."""

    mean: np.ndarray
    components: np.ndarray


def covariance(rows: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance: each task sums outer products exactly (see ``_exact_means``), and sums meet by matrix entry."""
    d, names = len(cols), list(cols)
    top = lambda c: F.max(F.abs(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))))
    sizes = rows.agg(F.count("*").alias("n"), *[top(c).alias(f"t{i}") for i, c in enumerate(names)]).first()
    n, seen = sizes["n"], np.array([sizes[f"t{i}"] or 0.0 for i in range(d)], float)
    if not n or not np.isfinite(seen).all():
        return np.full(d, 0.0 if not n else np.nan), np.full((d, d), 0.0 if not n else np.nan)
    tops, (i, j) = np.array([_top(t) for t in seen]), np.triu_indices(d)

    def sums(about):
        def run(batches):
            total = np.zeros((2, d if about is None else len(i)), np.int64)
            for f in batches:
                x = f[names].to_numpy(float) / tops
                for a in range(0, len(x), 512):
                    v = x[a : a + 512]
                    if about is not None:
                        v = v - about
                        v = v[:, i] * v[:, j]
                    v = v * 2.0**STEP
                    high = np.rint(v)
                    total += np.stack((high.sum(axis=0), np.rint((v - high) * 2.0**STEP).sum(axis=0))).astype(np.int64)
            yield pd.DataFrame({"at": np.arange(total.shape[1]), "high": total[0], "low": total[1]})

        got = rows.select(*names).mapInPandas(run, "at long, high long, low long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
        return np.array([_exact((r["high"], r["low"]), n) for r in sorted(got)])

    mean = sums(None)
    cov = np.empty((d, d))
    cov[i, j] = sums(mean) * (n / max(n - 1, 1)) * tops[i] * tops[j]
    cov[j, i] = cov[i, j]
    return mean * tops, cov


def fit_pca(rows: DataFrame, cols: Sequence[str], variance: float = 0.9) -> PCA:
    """The fewest components whose cumulative share of variance exceeds ``variance``."""
    mean, cov = covariance(rows, cols)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    keep = min(int(np.searchsorted(share, variance, side="right")) + 1, len(cols))
    parts = vectors[:, :keep].T
    signs = np.sign(parts[np.arange(keep), np.abs(parts).argmax(axis=1)])
    return PCA(mean, parts * signs[:, None])


def residuals(cols: Sequence[str], model: PCA) -> list[Column]:
    """Reconstruction residuals as expressions: x - mean less its projection on the components."""
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, model.mean, strict=True)]
    left = np.eye(len(cols)) - model.components.T @ model.components
    return [sum((xi * F.lit(float(w)) for xi, w in zip(x[1:], row[1:], strict=True)), x[0] * F.lit(float(row[0]))) for row in left]


def score_pca(rows: DataFrame, cols: Sequence[str], model: PCA) -> DataFrame:
    """raw_score: mean squared reconstruction error; expressions up to 24 features, Arrow batches beyond."""
    if len(cols) > 24:
        names = list(rows.columns)

        def run(batches):
            for f in batches:
                x = f[list(cols)].to_numpy(float) - model.mean
                yield f[names].assign(raw_score=((x - x @ model.components.T @ model.components) ** 2).mean(axis=1))

        return rows.mapInPandas(run, _schema(rows))
    named = rows.withColumns({f"{Z}{i}": r for i, r in enumerate(residuals(cols, model))})
    out = named.withColumn("raw_score", mean_square([F.col(f"{Z}{i}") for i in range(len(cols))]))
    return out.drop(*[f"{Z}{i}" for i in range(len(cols))])


def attribute_pca(rows: DataFrame, cols: Sequence[str], sensors: Sequence[str], model: PCA, k: int = 3) -> DataFrame:
    """``rows`` with raw_score, contributions, top_three and completeness_error.

    Features come as all means, then deviations, then slopes; a sensor's contribution is
    the sum of its three squared residuals over the number of features; contributions add
    up to the score.  Shares are 0 where the score is 0.  Ranks: contribution descending,
    then the sensor's place.
    """
    n = len(sensors)
    named = rows.withColumns({f"{Z}{i}": r for i, r in enumerate(residuals(cols, model))})
    part = lambda s: sum((F.col(f"{Z}{s + j * n}") * F.col(f"{Z}{s + j * n}") for j in range(1, 3)), F.col(f"{Z}{s}") * F.col(f"{Z}{s}")) / F.lit(float(len(cols)))
    named = named.withColumn("raw_score", mean_square([F.col(f"{Z}{i}") for i in range(len(cols))]))
    total = F.col("raw_score")
    entries = F.array(*[F.struct((-part(s)).alias("neg"), F.lit(s).alias("place"), F.lit(name).alias("sensor"), part(s).alias("contribution"), F.when(total > 0, part(s) / total).otherwise(0.0).alias("share")) for s, name in enumerate(sensors)])
    named = named.withColumn("__e", F.array_sort(entries))
    ranked = F.transform("__e", lambda e, i: F.struct(e["sensor"].alias("sensor"), e["contribution"].alias("contribution"), e["share"].alias("share"), (i + 1).cast("int").alias("rank")))
    out = named.withColumn("contributions", ranked)
    gap = F.abs(F.aggregate("contributions", F.lit(0.0).cast("double"), lambda a, e: a + e["contribution"]) - total)
    out = out.withColumn("completeness_error", gap).withColumn("top_three", F.slice("contributions", 1, k))
    return out.drop("__e", *[f"{Z}{i}" for i in range(len(cols))])


def _path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _trees_of(h: np.ndarray, trees: int, share: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, tree) of the trees that each row enters: gaps between them are geometric draws by the row's hash.

    A row costs as many draws as it enters trees, and one more; which trees it enters
    depends on the row alone, not on the task that reads it.
    """
    if share >= 1:
        return np.repeat(np.arange(len(h)), trees), np.tile(np.arange(trees), len(h))
    live, at, rows, found, step = np.arange(len(h)), np.full(len(h), -1), [], [], 0
    while len(live):
        u = 1.0 - mixed(h[live], seed, step)
        at = at + 1 + np.floor(np.log(u) / np.log1p(-share)).astype(np.int64)
        inside = at < trees
        live, at, step = live[inside], at[inside], step + 1
        rows.append(live)
        found.append(at)
    return np.concatenate(rows), np.concatenate(found)


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature, cut, left, path) of a tree's nodes, level by level: all nodes of a level are split at once.

    feature is -1 at leaves, where path is the depth and the expected rest; the right child
    stands after the left one.
    """
    at, local, count, base, depth, levels = np.arange(len(x)), np.zeros(len(x), np.int64), 1, 0, 0, []
    while count:
        at = at[np.argsort(local[at], kind="stable")]
        mine = local[at]
        starts = np.searchsorted(mine, np.arange(count))
        sizes = np.diff(np.append(starts, len(at)))
        low, high = np.minimum.reduceat(x[at], starts, axis=0), np.maximum.reduceat(x[at], starts, axis=0)
        wide = high > low
        split = wide.any(axis=1) & (depth < limit)
        f = np.where(wide, rng.random(wide.shape), -1.0).argmax(axis=1)
        node = np.arange(count)
        cut = low[node, f] + rng.random(count) * (high[node, f] - low[node, f])
        cut = np.minimum(cut, np.nextafter(high[node, f], -np.inf))  # both sides hold a row
        place = np.cumsum(split) - 1
        levels.append((np.where(split, f, -1), np.where(split, cut, 0.0), np.where(split, base + count + 2 * place, 0), np.where(split, 0.0, depth + _path(sizes))))
        local[at] = 2 * place[mine] + (x[at, f[mine]] > cut[mine])
        at = at[split[mine]]
        base, count, depth = base + count, 2 * int(split.sum()), depth + 1
    return tuple(np.concatenate(c) for c in zip(*levels, strict=True))


def fit_forest(rows: DataFrame, cols: Sequence[str], trees: int = 100, most: int = 256, seed: int = 42) -> DataFrame:
    """Isolation trees, a row for each: (tree, rows, feature, cut, left, path), arrays over its nodes by level.

    A row enters a tree with a chance that gives somewhat more than ``most`` rows, and the
    ``most`` of the least hash grow the tree, so a tree's task holds a bounded sample.
    """
    n, names = max(1, rows.count()), list(cols)
    share = min(1.0, (most + 4 * np.sqrt(most)) / n)
    keyed = rows.select(*cols, F.xxhash64(*rows.columns).alias("__key"))  # all columns tell rows apart

    def draw(batches):
        for f in batches:
            h = f["__key"].to_numpy()
            row, tree = _trees_of(h, trees, share, seed)
            yield f[names].iloc[row].assign(tree=tree, h=mixed(h[row] + tree * 0x5851F42D, seed, 1 << 20))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cols).schema)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree = int(frame["tree"].iloc[0])
        x = frame.sort_values(["h", *names])[names].to_numpy(float)[:most]
        made = _grow(x, int(np.ceil(np.log2(max(2, len(x))))), np.random.default_rng((seed, tree)))
        return pd.DataFrame([(tree, len(x), *made)], columns=["tree", "rows", "feature", "cut", "left", "path"])

    picked = keyed.mapInPandas(draw, f"{schema}, tree long, h double")
    return picked.groupBy("tree").applyInPandas(grow, "tree long, rows long, feature array<int>, cut array<double>, left array<int>, path array<double>")


def score_forest(rows: DataFrame, cols: Sequence[str], forest: DataFrame) -> DataFrame:
    """raw_score: 2 ** (-mean path / expected path).

    The trees, whose size is bounded by their number and sample, become arrays by tree and
    node; all trees take a step for a block of rows at once.
    """
    made = forest.orderBy("tree").toPandas()
    width = max([len(f) for f in made["feature"]], default=1)
    packed = [np.stack([np.pad(v, (0, width - len(v))) for v in made[c]]) if len(made) else np.zeros((0, width)) for c in ("feature", "cut", "left", "path")]
    feature, cut, left, path = (a.astype(t) for a, t in zip(packed, (np.int16, float, np.int32, float), strict=True))
    root = max(made["rows"], default=2)
    sent = rows.sparkSession.sparkContext.broadcast((feature, cut, left, path, float(_path(np.array([max(root, 2)]))[0])))
    names = list(rows.columns)

    def run(batches):
        feature, cut, left, path, norm = sent.value
        tree = np.arange(len(feature))[None, :]
        for f in batches:
            x, score = f[list(cols)].to_numpy(float), np.ones(len(f))
            for a in range(0, len(x) if len(feature) else 0, 256):
                part = x[a : a + 256]
                row, node = np.arange(len(part))[:, None], np.zeros((len(part), len(feature)), np.int32)
                while True:
                    at = feature[tree, node]
                    if (at < 0).all():
                        break
                    node = np.where(at < 0, node, left[tree, node] + (part[row, np.maximum(at, 0)] > cut[tree, node]))
                score[a : a + 256] = 2.0 ** (-path[tree, node].mean(axis=1) / norm)
            yield f[names].assign(raw_score=score)

    return rows.mapInPandas(run, _schema(rows))


def _schema(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", raw_score double"


def _middle(v: np.ndarray) -> int:
    """How many of some sorted numbers go left: up to a wide gap in their middle half, or else half of them."""
    a, b = max(1, len(v) // 4), max(2, len(v) - len(v) // 4)
    gaps = v[a:b] - v[a - 1 : b - 1]
    at = int(gaps.argmax())
    return a + at if gaps[at] > 0.05 * (v[-1] - v[0]) else len(v) // 2


def _groups(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of rows in groups of at most ``most``: parted along the widest axis until they fit, neighbours side by side."""
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        axis = np.ptp(x[at], axis=0).argmax()
        order = np.argsort(x[at, axis], kind="stable")
        half = _middle(x[at[order], axis])
        todo += [at[order[half:]], at[order[:half]]]
    return out


def _cells(sample: np.ndarray, many: int) -> tuple[np.ndarray, ...]:
    """(axis, edge, left, cell) of the nodes of a tree that parts a sample along its widest axis into about ``many`` cells.

    axis is -1 at leaves; the right child, of values above the edge, stands after the left
    one; cells are numbered from left to right, so that neighbours have near numbers.
    """
    axis, edge, left, path, todo = [-1], [0.0], [0], [0.0], [(0, np.arange(len(sample)), 0.0, 0.5)]
    while todo:
        node, at, place, step = todo.pop(0)
        wide = np.ptp(sample[at], axis=0) if len(at) else np.zeros(1)
        if len(axis) + 2 > 2 * many or not wide.max() > 0:
            continue
        a = int(wide.argmax())
        v = np.sort(sample[at, a])
        middle = v[_middle(v) - 1]
        middle = middle if middle < v[-1] else v[v < v[-1]][-1]  # both sides hold a row
        axis[node], edge[node], left[node] = a, middle, len(axis)
        for side, rows in enumerate((at[sample[at, a] <= middle], at[sample[at, a] > middle])):
            todo.append((len(axis), rows, place + side * step, step / 2))
            axis, edge, left, path = [*axis, -1], [*edge, 0.0], [*left, 0], [*path, place + side * step]
    axis, cell = np.array(axis), np.full(len(axis), -1)
    ends = np.flatnonzero(axis < 0)
    cell[ends[np.argsort(np.array(path)[ends], kind="stable")]] = np.arange(len(ends))
    return axis, np.array(edge), np.array(left), cell


def _cell_of(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    axis, edge, left, cell = tree
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (axis[node] >= 0).any():
        at = axis[node]
        node = np.where(at < 0, node, left[node] + (x[rows, np.maximum(at, 0)] > edge[node]))
    return cell[node]


def _in_cells(rows: DataFrame, tree: tuple[np.ndarray, ...]) -> DataFrame:
    """``rows`` (..., x) with ``cell``."""
    sent, names = rows.sparkSession.sparkContext.broadcast(tree), list(rows.columns)

    def run(batches):
        for f in batches:
            if len(f):
                yield f[names].assign(cell=_cell_of(np.stack(f["x"]).astype(float), sent.value))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{schema}, cell long")


LEAF = "cell long, lo array<double>, hi array<double>, rows long, points binary, counts binary, ids binary, extra binary"


def _leaves(points: DataFrame, carry: Sequence[str], most: int) -> DataFrame:
    """Reference vectors packed by place, a row for at most ``most`` of a cell: their box and, as bytes, vectors, ids and ``carry``."""

    def run(batches):
        def packed(frames):
            f = pd.concat(frames, ignore_index=True)
            x = np.stack(f["x"]).astype(float)
            for at in _groups(x, most):
                ids = [np.asarray(v, np.int64) for v in f["ids"].iloc[at]]
                extra = f[list(carry)].to_numpy(float)[at] if carry else np.empty((len(at), 0))
                yield f["cell"].iloc[0], x[at].min(axis=0), x[at].max(axis=0), len(at), x[at].tobytes(), np.array([len(v) for v in ids], np.int64).tobytes(), np.concatenate(ids).tobytes(), extra.tobytes()

        names, held = [c.split()[0] for c in LEAF.split(", ")], []
        for f in batches:
            for _, part in f.groupby("cell", sort=False):
                if held and held[-1]["cell"].iloc[0] != part["cell"].iloc[0]:
                    yield pd.DataFrame(list(packed(held)), columns=names)
                    held = []
                held.append(part)
        if held:
            yield pd.DataFrame(list(packed(held)), columns=names)

    return points.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, LEAF)


def _boxes(rows: DataFrame, low: str, high: str, count: Column, d: int) -> tuple[np.ndarray, ...]:
    """(cell, lows, highs, count) of the cells of ``rows``: their number is a parameter."""
    edges = [f(F.col(c)[i]).alias(f"{n}{i}") for n, c, f in (("l", low, F.min), ("h", high, F.max)) for i in range(d)]
    got = rows.groupBy("cell").agg(count.alias("n"), *edges).toPandas().sort_values("cell")
    return got["cell"].to_numpy(), got[[f"l{i}" for i in range(d)]].to_numpy(float), got[[f"h{i}" for i in range(d)]].to_numpy(float), got["n"].to_numpy()


def _least_gap(lo: np.ndarray, hi: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distance of a box from each of some boxes."""
    return np.sqrt((np.maximum(0.0, np.maximum(lows - hi, lo - highs)) ** 2).sum(axis=1))


def _tiles(given: tuple, asked: tuple, want: int, block: int, most: int, tasks: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(cell, first, blocks) of the cells of queries, and (cell, first, blocks, gap): which cells of the reference a tile's blocks meet.

    A tile is a stretch of cells with about ``block`` queries, more where ``tasks`` tiles
    would not hold all, but no more than ``most`` in a block of it.  No neighbour is lost:
    the cells nearest to a tile that hold ``want`` vectors bound, by the greatest distance
    of boxes, how far a neighbour of any query can be.
    """
    cells, lows, highs, counts = given
    at, qlo, qhi, many = asked
    size = min(most, max(block, -(-int(many.sum()) // tasks)))
    asks, gives, first, start = [], [], 0, 0
    while start < len(at):
        stop = start + max(1, int(np.searchsorted(np.cumsum(many[start:]), size, side="right")))
        blocks = -(-int(many[start:stop].sum()) // most)
        lo, hi = qlo[start:stop].min(axis=0), qhi[start:stop].max(axis=0)
        far = np.sqrt((np.maximum(np.abs(hi - lows), np.abs(highs - lo)) ** 2).sum(axis=1))
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(counts[order]), want)
        bound = far[order[enough]] if enough < len(order) else np.inf
        gap = _least_gap(lo, hi, lows, highs)
        near = gap <= bound * (1 + 1e-9)
        asks.append(pd.DataFrame({"cell": at[start:stop], "first": first, "blocks": blocks}))
        gives.append(pd.DataFrame({"cell": cells[near], "first": first, "blocks": blocks, "gap": gap[near]}))
        first, start = first + blocks, stop
    return pd.concat(asks, ignore_index=True), pd.concat(gives, ignore_index=True)


@dataclass
class _Slab:
    """Reference vectors of some leaves: boxes and starts of the leaves, vectors, and the ids and carried values of each."""

    lows: np.ndarray
    highs: np.ndarray
    starts: np.ndarray
    x: np.ndarray
    counts: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    extra: np.ndarray


def _slab(f: pd.DataFrame, d: int) -> _Slab:
    read = lambda c, t: np.concatenate([np.frombuffer(v, t) for v in f[c]])
    x, counts = read("points", float).reshape(-1, d), read("counts", np.int64)
    place = np.concatenate(([0], np.cumsum(counts)))
    return _Slab(np.stack(f["lo"]).astype(float), np.stack(f["hi"]).astype(float), np.concatenate(([0], np.cumsum(f["rows"].to_numpy(np.int64)))), x, counts, place, read("ids", np.int64), read("extra", float).reshape(len(x), -1))


def _hits(x: np.ndarray, y: np.ndarray, limit: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs within ``limit`` (squared), or within the ``want``-th least where that is less, and some beyond.

    Distances are of single precision and, by more than their error, too low.
    """
    middle = x.mean(axis=0)
    a, b = x - middle, y - middle
    unit = _top(float(max(np.abs(a).max(), np.abs(b).max())))
    a, b = a / unit, b / unit
    less = 1 - (x.shape[1] + 8) * 2.0**-21
    left = np.column_stack((-2 * a, less * (a * a).sum(axis=1), np.ones(len(a)))).astype(np.float32)
    right = np.column_stack((b, np.ones(len(b)), less * (b * b).sum(axis=1))).astype(np.float32)
    far = left @ right.T
    limit = limit / unit / unit
    if np.isinf(limit).any() and len(y) > want:
        at = np.flatnonzero(np.isinf(limit))
        # What the least can be too low by, twice, as the limit is met with values that are.
        over = 4 * (1 - less) * ((a[at] * a[at]).sum(axis=1) + (b * b).sum(axis=1).max())
        limit[at] = np.maximum(np.partition(far[at], want - 1, axis=1)[:, want - 1], 0) + over
    return np.nonzero(far <= (limit * (1 + 1e-6) + 1e-37).astype(np.float32)[:, None])


def _meet(x: np.ndarray, best: list[np.ndarray], met: np.ndarray, slab: _Slab) -> None:
    """Merge a slab's rows into the nearest of a group of queries: ``best`` has distances, ids and carried values, by (distance, id).

    Leaves come nearest first; a query leaves off where the next leaf is beyond its last neighbour.
    """
    want, d = best[0].shape[1], x.shape[1]
    gap = _least_gap(x.min(axis=0), x.max(axis=0), slab.lows, slab.highs)
    order = np.argsort(gap, kind="stable")
    sizes = np.diff(slab.starts)[order]
    upto, at, many = np.cumsum(sizes), 0, 2 * want
    while at < len(order):
        live = np.flatnonzero(best[0][:, -1] * (1 + 1e-9) >= gap[order[at]])
        if not len(live):
            break
        stop = min(len(order), at + max(1, int(np.searchsorted(upto[at:], (upto[at - 1] if at else 0) + many))))
        # Of the next leaves and the queries, those of which any may hold a neighbour of any.
        leaves, last = order[at:stop], best[0][live, -1] * (1 + 1e-9)
        leaves = leaves[gap[leaves] <= last.max()]
        away = np.zeros((len(live), len(leaves)))
        for c in range(d):
            away += np.maximum(0.0, np.maximum(slab.lows[leaves, c] - x[live, c, None], x[live, c, None] - slab.highs[leaves, c])) ** 2
        needed = away <= (last * last)[:, None]
        leaves, live = leaves[needed.any(axis=0)], live[needed.any(axis=1)]
        at, many = stop, min(4 * many, 8192)
        if not len(live):
            continue
        rows = np.concatenate([np.arange(slab.starts[i], slab.starts[i + 1]) for i in leaves])
        y = slab.x[rows]
        met[live] += slab.counts[rows].sum()
        for a in range(0, len(live), 256):
            part = live[a : a + 256]
            q, j = _hits(x[part], y, best[0][part, -1] ** 2, want)
            dist = np.zeros(len(q))
            for c in range(d):
                dist += (x[part[q], c] - y[j, c]) ** 2
            dist = np.sqrt(dist)
            keep = dist <= best[0][part[q], -1]
            q, j, dist = q[keep], rows[j[keep]], dist[keep]
            times = slab.counts[j]
            each = np.repeat(slab.place[j] - np.cumsum(times) + times, times) + np.arange(times.sum())
            old = len(part) * want
            q = np.concatenate((np.repeat(np.arange(len(part)), want), np.repeat(q, times)))
            dist = np.concatenate((best[0][part].ravel(), np.repeat(dist, times)))
            ids = np.concatenate((best[1][part].ravel(), slab.ids[each]))
            sort = np.lexsort((ids, dist, q))
            pick = sort[(np.searchsorted(q[sort], np.arange(len(part)))[:, None] + np.arange(want)).ravel()]
            extra = np.where((pick < old)[:, None], best[2][part].reshape(old, -1)[np.minimum(pick, old - 1)], slab.extra[np.repeat(j, times)[np.maximum(pick - old, 0)]] if len(j) else 0.0)
            best[0][part], best[1][part], best[2][part] = dist[pick].reshape(-1, want), ids[pick].reshape(-1, want), extra.reshape(len(part), want, -1)


def _lists(dist: np.ndarray, ids: np.ndarray, extra: np.ndarray) -> dict:
    whole = np.isfinite(dist)
    return {"near": [i[f] for i, f in zip(ids, whole, strict=True)], "dist": [v[f] for v, f in zip(dist, whole, strict=True)]}


def _neighbours(points: DataFrame, queries: DataFrame, want: int, carry: Sequence[str] = (), finish: Callable = _lists, columns: str = "near array<long>, dist array<double>", block: int = 1024, most_cells: int = 512, seed: int = 42, most: int = 65_536) -> DataFrame:
    """(x, ``columns``, met) of every distinct vector of ``queries``: what ``finish`` makes of its ``want`` nearest reference rows.

    ``points``: (x, ids, ``carry``), a row for each distinct reference vector with the least
    ids of its rows, ``want`` at most.  Cells come from a bounded sample; boxes of cells tell
    which packed leaves of the reference (see ``_leaves``) a tile of queries can need.  A
    task holds a block of at most ``most`` queries and a slab of the reference at a time;
    groups of its queries meet leaves, nearest first, until none can hold a neighbour.
    ``met``: how many reference rows a query was compared with.
    """
    from ..sources.scratch import cut

    spark, n = points.sparkSession, points.count()
    many = min(most_cells, int(np.ceil(np.sqrt(n))))
    drawn = points.orderBy(F.xxhash64(F.col("ids")[0], F.lit(seed)), F.col("ids")[0]).limit(8 * many)
    sample = np.array([r[0] for r in drawn.select("x").collect()], float)
    d, tree = sample.shape[1], _cells(sample, many)
    size = int(np.clip(np.sqrt(n) / 2, 16, 256))
    leaves = cut(_leaves(_in_cells(points.select("x", "ids", *carry), tree), carry, size), "near_leaves")
    asked = cut(_in_cells(queries.select("x").distinct(), tree), "near_queries")
    given, wanted = _boxes(leaves, "lo", "hi", F.sum("rows"), d), _boxes(asked, "x", "x", F.count("*"), d)
    if not len(wanted[0]):
        return spark.createDataFrame([], f"x array<double>, {columns}, met long")
    asks, gives = _tiles(given, wanted, want, block, most, 4 * spark.sparkContext.defaultParallelism)
    total = int((asks["first"] + asks["blocks"]).max())
    asks = F.broadcast(spark.createDataFrame(asks.astype("int64"), "cell long, first long, blocks long"))
    gives = F.broadcast(spark.createDataFrame(gives.astype({"cell": "int64", "first": "int64", "blocks": "int64", "gap": "float64"}), "cell long, first long, blocks long, gap double"))
    leaf = [c.split()[0] for c in LEAF.split(", ")][1:]
    left = asked.join(asks, "cell").select((F.col("first") + F.pmod(F.xxhash64("x"), F.col("blocks"))).cast("int").alias("block"), F.lit(-1.0).alias("gap"), "x")
    right = leaves.join(gives, "cell").select(F.explode(F.sequence(F.col("first").cast("int"), (F.col("first") + F.col("blocks") - 1).cast("int"))).alias("block"), "gap", *leaf)
    dealt = left.unionByName(right, allowMissingColumns=True).repartitionById(total, "block").sortWithinPartitions("block", "gap")

    def run(batches):
        key, held, parts, best, met, waiting, rows = None, [], [], None, None, [], 0

        def meet():
            nonlocal waiting, rows, held, parts, best, met
            if best is None:
                held = np.concatenate(held)
                parts = _groups(held, int(np.clip(np.sqrt(len(held)), 32, 256)))
                best = [np.full((len(held), want), np.inf), np.full((len(held), want), np.iinfo(np.int64).max), np.zeros((len(held), want, len(carry)))]
                met = np.zeros(len(held), np.int64)
            slab = _slab(pd.concat(waiting, ignore_index=True), d)
            for at in parts:
                mine, seen = [b[at] for b in best], met[at]
                _meet(held[at], mine, seen, slab)
                for b, m in zip(best, mine, strict=True):
                    b[at] = m
                met[at] = seen
            waiting, rows = [], 0

        def done():
            if waiting:
                meet()
            for a in range(0, len(held), 8192):
                part = slice(a, a + 8192)
                yield pd.DataFrame({"x": list(held[part]), **finish(*[b[part] for b in best]), "met": met[part]})

        for f in batches:
            for now, g in f.groupby("block", sort=False):
                if now != key:
                    if key is not None and len(held):
                        yield from done()
                    key, held, parts, best, met, waiting, rows = now, [], [], None, None, [], 0
                ask = (g["gap"] < 0).to_numpy()
                if ask.any():
                    held.append(np.stack(g["x"][ask]).astype(float))
                if not ask.all() and len(held):
                    waiting.append(g[~ask].drop(columns="x"))
                    rows += int(waiting[-1]["rows"].sum())
                    if rows > 400_000:
                        meet()
        if key is not None and len(held):
            yield from done()

    return cut(dealt.mapInPandas(run, f"x array<double>, {columns}, met long"), "near_found")


def nearest(reference: DataFrame, queries: DataFrame, k: int, other: bool, block: int = 1024, most_cells: int = 512, seed: int = 42) -> DataFrame:
    """(id, near array<long>, dist array<double>, met): the exact ``k`` nearest reference rows of every query, least id on ties.

    Both have columns (id long, x array<double>).  ``other``: a row isn't its own
    neighbour.  ``met``: how many reference rows the query was compared with.

    Of equal reference rows only the k (or k + 1) of least id can be neighbours, and equal
    queries have equal neighbours, so both are reduced to distinct vectors first; see ``_neighbours``.
    """
    from ..sources.scratch import cut

    want = k + 1 if other else k
    order = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    least = reference.select("id", "x").withColumn("__r", order).where(F.col("__r") <= want)
    points = cut(least.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")), "near_points")
    if points.isEmpty():
        return queries.select("id", F.array().cast("array<long>").alias("near"), F.array().cast("array<double>").alias("dist"), F.lit(0).cast("long").alias("met"))
    joined = queries.select("id", "x").join(_neighbours(points, queries, want, block=block, most_cells=most_cells, seed=seed), "x")
    if not other:
        return joined.select("id", "near", "dist", "met")
    rest = F.slice(F.filter(F.arrays_zip(F.col("near"), F.col("dist")), lambda z: z["near"] != F.col("id")), 1, k)
    return joined.select("id", rest.alias("z"), "met").select("id", F.col("z.near").alias("near"), F.col("z.dist").alias("dist"), "met")


def fit_lof(rows: DataFrame, cols: Sequence[str], neighbors: int | Sequence[int] = 20) -> dict:
    """All training rows, a row for each distinct vector, with k-distance and local reachability density.

    Several numbers of ``neighbors`` are fitted from one search of the greatest.  Equal rows
    have both in common, so only their number counts.  Vectors at one distance are taken by
    their rows' other columns, in order.  Fewer than three rows raise Violation; with fewer
    than ``neighbors`` others, all are neighbours.
    """
    from ..sources.scratch import cut
    from .checks import Violation

    rest = [c for c in rows.columns if c not in cols]
    numbered = (rows.orderBy(*rest) if rest else rows).withColumn("id", F.monotonically_increasing_id())
    vectors = numbered.select("id", F.array(*[F.col(c).cast("double") for c in cols]).alias("x")).groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("c"))
    vectors = cut(vectors, "lof_points")
    n = vectors.agg(F.sum("c")).first()[0] or 0
    if n < 3:
        raise Violation(f"{n} rows are too few for neighbours")
    ks = [min(k, n - 1) for k in ([neighbors] if isinstance(neighbors, int) else neighbors)]
    copies = lambda want: F.array_repeat("id", F.least(F.col("c"), F.lit(want)).cast("int"))
    # The nearest of a vector's row is the row itself, and ids are those of vectors.
    near = _neighbours(vectors.select("x", copies(max(ks) + 1).alias("ids")), vectors, max(ks) + 1)
    kd = near.select(F.col("near")[0].alias("id"), *[F.col("dist")[k].alias(f"kd{i}") for i, k in enumerate(ks)])
    one = near.select(F.col("near")[0].alias("id"), F.posexplode(F.arrays_zip(F.col("near").alias("other"), F.col("dist").alias("d")))).where("pos > 0").select("id", "pos", "col.other", "col.d")
    reach = [(1 / (F.avg(F.when(F.col("pos") <= k, F.greatest("d", f"kd{i}"))) + 1e-10)).alias(f"lrd{i}") for i, k in enumerate(ks)]
    density = one.join(kd.withColumnRenamed("id", "other"), "other").groupBy("id").agg(*reach).join(kd, "id")
    carried = [f"{c}{i}" for i in range(len(ks)) for c in ("kd", "lrd")]
    return {"ks": ks, "carried": carried, "points": cut(vectors.join(density, "id").select("x", copies(max(ks)).alias("ids"), *carried), "lof_stats")}


def score_lofs(rows: DataFrame, cols: Sequence[str], state: dict) -> DataFrame:
    """``rows`` with raw0, raw1, ...: for each number of neighbours their mean density over the row's own, from one search.

    Rows are queries, training rows too: such a row counts itself among its neighbours.
    """
    ks = state["ks"]

    def reached(dist: np.ndarray, ids: np.ndarray, extra: np.ndarray) -> dict:
        part = lambda i, k: (np.maximum(dist[:, :k], extra[:, :k, 2 * i]).mean(axis=1) + 1e-10) * extra[:, :k, 2 * i + 1].mean(axis=1)
        return {f"raw{i}": part(i, k) for i, k in enumerate(ks)}

    keyed = rows.withColumn("__x", F.array(*[F.col(c).cast("double") for c in cols]))
    columns = ", ".join(f"raw{i} double" for i in range(len(ks)))
    found = _neighbours(state["points"], keyed.select(F.col("__x").alias("x")), max(ks), state["carried"], reached, columns)
    return keyed.join(found.drop("met").withColumnRenamed("x", "__x"), "__x").drop("__x")


def score_lof(rows: DataFrame, cols: Sequence[str], state: dict) -> DataFrame:
    """raw_score of a state of one number of neighbours, see ``score_lofs``."""
    return score_lofs(rows, cols, state).withColumnRenamed("raw0", "raw_score")


def _rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x**2).sum(axis=1)[:, None] - 2 * x @ y.T + (y**2).sum(axis=1)[None, :]
    return np.exp(-gamma * np.maximum(d, 0))


def _landmarks(x: np.ndarray, gamma: float, many: int, seed: int) -> np.ndarray:
    """At most ``many`` rows, drawn with a chance by their ridge leverage: how much of the kernel others don't tell."""
    x = np.unique(x, axis=0)
    if len(x) <= many:
        return x
    k = _rbf(x, x, gamma)
    leverage = np.clip(np.diagonal(np.linalg.solve(k + 1e-2 * np.eye(len(x)), k)), 1e-12, 1)
    keys = np.log(np.random.default_rng(seed).random(len(x))) / leverage
    return x[np.argsort(-keys, kind="stable")[:many]]


def _one_class_sums(rows: DataFrame, cols: Sequence[str], maps: tuple, w: np.ndarray, rho: float, width: float) -> tuple[float, np.ndarray, np.ndarray, float, float]:
    """(loss, gradient, Hessian, rows, lost) over all rows, of margins rho - w.z whose corner is rounded over ``width``.

    The last coordinate is rho's.  lost: the sum of 1 - |z|^2, what the features miss of the kernel's diagonal.
    """
    sent, m = rows.sparkSession.sparkContext.broadcast((*maps, w, rho)), len(w) + 1
    i, j = np.triu_indices(m)

    def run(batches):
        points, turn, gamma, w, rho = sent.value
        n, loss, lost, g, h = 0, 0.0, 0.0, np.zeros(m), np.zeros((m, m))
        for f in batches:
            z = _rbf(f.to_numpy(float), points, gamma) @ turn
            t = rho - z @ w
            inside = np.abs(t) < width
            slope = np.where(t >= width, 1.0, np.where(inside, (t + width) / (2 * width), 0.0))
            # A margin is rho - w.z: its derivative is -z for w and 1 for rho.
            e = np.column_stack((-z, np.ones(len(z))))
            n, lost = n + len(z), lost + float((1 - (z * z).sum(axis=1)).sum())
            loss += float(np.where(t >= width, t, np.where(inside, (t + width) ** 2 / (4 * width), 0.0)).sum())
            g += slope @ e
            h += e[inside].T @ e[inside] / (2 * width)
        yield pd.DataFrame({"i": np.concatenate(([-1, -2, -3], np.full(m, -4), i)), "j": np.concatenate(([0, 0, 0], np.arange(m), j)), "v": np.concatenate(([n, loss, lost], g, h[i, j]))})

    # A row for each entry: landmarks squared.
    got = rows.select(*cols).mapInPandas(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    sent.unpersist()
    one = {int(a): v for a, _, v in got[got["i"].between(-3, -1)].itertuples(index=False)}
    g, h = np.zeros(m), np.zeros((m, m))
    part = got[got["i"] == -4]
    g[part["j"]] = part["v"]
    part = got[got["i"] >= 0]
    h[part["i"], part["j"]] = h[part["j"], part["i"]] = part["v"]
    return one[-2], g, h, one[-1], one[-3]


def fit_one_class(rows: DataFrame, cols: Sequence[str], nu: float = 0.1, landmarks: int = 256, rounds: int = 40, seed: int = 42) -> dict:
    """A one-class boundary of an RBF kernel on Nyström features of landmark rows.

    gamma is 1 / (features * variance).  Landmarks come from a bounded sample, the
    8 ``landmarks`` rows of least hash, by ridge leverage; all rows are fitted to.
    Minimizes |w|^2 / 2 - rho + mean(max(0, rho - w.z)) / nu by Newton steps over a corner
    that is rounded less and less; each round is one aggregation, for at most ``rounds``.
    ``error``: the mean share of the kernel's diagonal that the features miss.
    """
    d = len(cols)
    var = rows.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(F.col(c) * F.col(c)).alias(f"q{i}") for i, c in enumerate(cols)], F.count("*").alias("n")).first()
    n = max(1, var["n"])
    total, square = sum(var[f"s{i}"] or 0.0 for i in range(d)) / (n * d), sum(var[f"q{i}"] or 0.0 for i in range(d)) / (n * d)
    gamma = 1.0 / (d * max(square - total * total, 1e-12))
    sample = rows.select(*cols).orderBy(F.xxhash64(*cols, F.lit(seed)), *cols).limit(8 * landmarks).toPandas().to_numpy(float)
    points = _landmarks(sample, gamma, landmarks, seed) if len(sample) else np.zeros((1, d))
    values, vectors = np.linalg.eigh(_rbf(points, points, gamma))
    keep = values > 1e-9
    maps = (points, vectors[:, keep] / np.sqrt(values[keep]), gamma)
    m = int(keep.sum())
    # Start from the mean of the sample, which most rows are near.
    z = _rbf(sample, points, gamma) @ maps[1] if len(sample) else np.zeros((1, m))
    w = z.mean(axis=0)
    rho = float(np.quantile(z @ w, nu))
    scale = max(float(np.std(z @ w)), 1e-6)
    width, ahead, best, lost = scale, None, np.inf, 0.0
    for _ in range(rounds if var["n"] else 0):
        loss, g, h, count, lost = _one_class_sums(rows, cols, maps, w, rho, width)
        value = 0.5 * float(w @ w) - rho + loss / (nu * n)
        if ahead is not None and value > best + 1e-12 * abs(best):
            # Too far: half of the last step.
            ahead = (ahead[0] / 2, ahead[1] / 2)
            if max(np.abs(ahead[0]).max(initial=0.0), abs(ahead[1])) < 1e-9 * scale:
                break
            w, rho = start[0] + ahead[0], start[1] + ahead[1]
            continue
        grad = np.append(w, -1.0) + g / (nu * n)
        hess = np.diag(np.append(np.ones(m), 1e-9)) + h / (nu * n)
        if np.abs(grad).max() < 1e-3 and width > 2e-3 * scale:
            # Nearly at rest: a sharper corner from here on.
            width, ahead, best = width / 4, None, np.inf
            continue
        if np.abs(grad).max() < 1e-6:
            break
        step = -np.linalg.solve(hess, grad)
        step *= min(1.0, 10 * scale / max(abs(step[-1]), 1e-12))
        start, best, ahead = (w, rho), value, (step[:m], float(step[-1]))
        w, rho = w + ahead[0], rho + ahead[1]
    return {"points": points, "turn": maps[1], "gamma": gamma, "w": w, "rho": rho, "error": lost / n}


def score_one_class(rows: DataFrame, cols: Sequence[str], state: dict) -> DataFrame:
    """raw_score: rho - w.z, positive outside the boundary."""
    sent, names = rows.sparkSession.sparkContext.broadcast(state), list(rows.columns)

    def run(batches):
        s = sent.value
        for f in batches:
            z = _rbf(f[list(cols)].to_numpy(float), s["points"], s["gamma"]) @ s["turn"]
            yield f[names].assign(raw_score=s["rho"] - z @ s["w"])

    return rows.mapInPandas(run, _schema(rows))


DETECTORS: dict[str, tuple[Callable, Callable]] = {
    "pca": (fit_pca, score_pca),
    "isolation_forest": (fit_forest, score_forest),
    "lof": (fit_lof, score_lof),
    "one_class": (fit_one_class, score_one_class),
}


def standardized(train: DataFrame, rows: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(training rows, training rows and ``rows`` together, told apart by ``__t``), scaled by the training rows and written."""
    from ..sources.scratch import cut

    scaler = fit_feature_scaler(train, cols)
    t, r = cut(standardize(train, scaler), "train"), standardize(rows, scaler)
    return t, cut(r.withColumn("__t", F.lit(False)).unionByName(t.select(*cols, F.lit(True).alias("__t")), allowMissingColumns=True), "both")


def raw_scores(t: DataFrame, both: DataFrame, cols: Sequence[str], detector: str, settings: Sequence[dict], digits: int = 9) -> list[DataFrame]:
    """``both`` with raw_score and detector_id for each of a detector's settings, fitted on ``t``; outlier factors share their searches."""
    from ..sources.scratch import cut

    named = lambda df: df.withColumn("raw_score", F.round("raw_score", digits)).withColumn("detector_id", F.lit(detector))
    if detector == "lof" and len(settings) > 1 and all(set(p) == {"neighbors"} for p in settings):
        made = cut(score_lofs(both, cols, fit_lof(t, cols, [p["neighbors"] for p in settings])), "scored")
        return [named(made.withColumn("raw_score", F.col(f"raw{i}"))).drop(*[f"raw{j}" for j in range(len(settings))]) for i in range(len(settings))]
    fit, score = DETECTORS[detector]
    return [cut(named(score(both, cols, fit(t, cols, **p))), "scored") for p in settings]


def fit_score(train: DataFrame, rows: DataFrame, cols: Sequence[str], detector: str, digits: int = 9, **params) -> DataFrame:
    """``rows`` with raw_score and alert_score: scaler, detector and calibration fitted on ``train``."""
    from .calibration import ecdf

    t, both = standardized(train, rows, cols)
    scored = raw_scores(t, both, cols, detector, [params], digits)[0]
    return ecdf(scored.where("__t"), scored.where("not __t").drop("__t"))


def ensemble(members: Sequence[DataFrame], score: str = "alert_score") -> DataFrame:
    """(window_id, members, alert_score): means over member tables; a window that a member lacks or repeats is an error."""
    tagged = None
    for k, m in enumerate(members):
        one = m.select("window_id", F.col(score).alias("s"), F.lit(k).alias("member"))
        tagged = one if tagged is None else tagged.unionByName(one)
    n = len(members)
    got = tagged.groupBy("window_id").agg(F.avg("s").alias(score), F.count("*").alias("__n"), F.count_distinct("member").alias("members"))
    checked = F.when((F.col("__n") == n) & (F.col("members") == n), F.col(score)).otherwise(F.raise_error(F.concat(F.lit("members don't agree on "), "window_id")).cast("double"))
    return got.select("window_id", "members", checked.alias(score))


def score_windows_with(sequences: DataFrame, reconstruct: Callable[[np.ndarray], np.ndarray], column: str = "sequence") -> DataFrame:
    """``sequences`` with raw_score: mean squared error of a reconstruction of (rows, steps, sensors)."""
    names = list(sequences.columns)

    def run(batches):
        for f in batches:
            x = np.array([np.stack(s) for s in f[column]], float)
            yield f[names].assign(raw_score=((x - reconstruct(x)) ** 2).mean(axis=(1, 2)) if len(f) else [])

    return sequences.mapInPandas(run, _schema(sequences))
