"""Quality: ordinal cumulative-link regression over hashed style terms.

P(grade > k) = sigmoid(z - theta_k), z one shared linear function of the text's terms,
theta_1 < theta_2 < ...: the expected grade and any tail probability follow from z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace
from .hashed_terms import STYLE, Lookup, labelled_sample, sample_features, select_terms, shard_rows, shards, term_counts
from .toxicity import _keep


@dataclass
class CumulativeLink:
    chosen: np.ndarray
    weights: np.ndarray
    theta: np.ndarray

    def latent(self, ids: np.ndarray, words: int) -> float:
        return float(term_shares(ids, words, len(self.weights)) @ self.weights) if len(self.weights) else 0.0

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ...: columns."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(z)[:, None] - self.theta[None, :], -40, 40)))


def term_shares(ids: np.ndarray, words: int, size: int) -> np.ndarray:
    """Square roots of the share of each term among the text's words."""
    return np.sqrt(np.bincount(ids, minlength=size) / max(1, words))


def _gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, theta: np.ndarray):
    """Sums over rows of the loss and of its gradient by weights and thresholds."""
    z = x @ weights
    edge = np.concatenate(([-40.0], theta, [40.0]))
    s = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    low, high = s(edge[y] - z), s(edge[y + 1] - z)
    p = np.maximum(high - low, 1e-12)
    d_low, d_high = low * (1 - low), high * (1 - high)
    dz = (d_high - d_low) / p
    d_theta = np.zeros(len(theta) + 2)
    np.add.at(d_theta, y, d_low / p)
    np.add.at(d_theta, y + 1, -d_high / p)
    return -np.log(p).sum(), x.T @ dz, d_theta[1:-1]


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", grades: int = 2, id_col: str = "doc_id", text_col: str = "text", per_grade: int = 6_000, most_terms: int = 1_024, least_gain: float = 20.0, rounds: int = 40, rate: float = 0.3, decay: float = 1e-3, parts: int = 6) -> CumulativeLink:
    """Fit on at most ``per_grade`` labelled rows of each grade 0 .. grades-1 (least id hash).

    Every round sums the gradient over ``parts`` shards of the sample, in order, and takes an Adam step;
    thresholds stay ordered because their gaps are exponentials.  They are finally
    shifted to the grades' shares among all labels.  Rows with a null id or grade are
    ignored; with fewer than two grades present, z is 0 and thresholds give the shares.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    known = {r[0]: r[1] for r in labels.where(F.col(grade).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(grade).cast("int")).count().collect()}
    every = np.array([known.get(g, 0) for g in range(grades)], float) + 0.5
    above = lambda n: np.log(n[::-1].cumsum()[::-1][1:] / n.cumsum()[:-1])  # noqa: E731  log odds of grade > k
    if (every > 1).sum() < 2:
        return CumulativeLink(np.empty(0, np.int64), np.empty(0), -above(every))
    sample = work.save(labelled_sample(docs, labels, grade, id_col, text_col, per_grade, grades), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("grade").count().collect()}
    totals = [sizes.get(g, 0) for g in range(grades)]
    chosen, _ = select_terms(term_counts(sample, STYLE, grades), totals, most_terms, least_gain)
    dealt = work.save(shards(sample_features(sample, STYLE, chosen), parts), "shards")
    start = -above(np.array(totals, float) + 0.5)
    flat = np.concatenate((np.zeros(len(chosen)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))))
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    for k in range(rounds if len(chosen) else 0):
        weights, theta = flat[: len(chosen)], np.cumsum(np.concatenate(([flat[len(chosen)]], np.exp(flat[len(chosen) + 1 :]))))
        sent = spark.sparkContext.broadcast((weights, theta))

        def run(batches, sent=sent):
            w, t = sent.value
            for batch in batches:
                for shard, y, words, rows in shard_rows(batch):
                    total = np.zeros(len(w) + len(t))
                    for a in range(0, len(rows), 512):
                        x = np.stack([term_shares(i, c, len(w)) for i, c in zip(rows[a : a + 512], words[a : a + 512].tolist(), strict=True)])
                        _, dw, dt = _gradient(x, y[a : a + 512], w, t)
                        total += np.concatenate((dw, dt))
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["shard", "n", "gradient"])

        got = [(r[1], np.frombuffer(r[2])) for r in sorted(dealt.mapInArrow(run, "shard int, n long, gradient binary").collect())]
        if not got:
            break
        n = max(1, sum(x for x, _ in got))
        g = sum(x for _, x in got) / n
        by_theta = g[len(chosen) :]
        tail = np.cumsum(by_theta[::-1])[::-1]  # of theta_1, then of each gap
        step = np.concatenate((g[: len(chosen)] + decay * weights, [tail[0]], tail[1:] * np.exp(flat[len(chosen) + 1 :])))
        m1, m2 = 0.9 * m1 + 0.1 * step, 0.99 * m2 + 0.01 * step * step
        flat = flat - rate * (m1 / (1 - 0.9 ** (k + 1))) / (np.sqrt(m2 / (1 - 0.99 ** (k + 1))) + 1e-8)
        sent.unpersist()
    work.clear()
    theta = np.cumsum(np.concatenate(([flat[len(chosen)]], np.exp(flat[len(chosen) + 1 :]))))
    theta = np.maximum.accumulate(theta - above(every) + above(np.array(totals, float) + 0.5))
    return CumulativeLink(chosen, flat[: len(chosen)], theta)


def _latents(spark, model: CumulativeLink):
    sent = spark.sparkContext.broadcast(model)

    def latents(column):
        m = sent.value
        look = m.__dict__.setdefault("look", Lookup(STYLE, m.chosen))  # the cache lives as long as the model
        for t in column:
            yield m.latent(*look(t.as_py() or b""))

    return latents


def grade(docs: DataFrame, model: CumulativeLink, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, z, expected_grade, tail array of P(grade > k)), a row for each row of ``docs``.

    Null and empty texts have no terms: z is 0.  Ids may be null or repeat.
    """
    latents = _latents(docs.sparkSession, model)
    theta = model.theta

    def run(batches):
        m = CumulativeLink(np.empty(0), np.empty(0), theta)
        for b in batches:
            z = np.array(list(latents(b.column(1))), float)
            t = m.tails(z)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z), pa.array(t.sum(axis=1)), pa.array(t.tolist(), pa.list_(pa.float64()))], ["doc_id", "z", "expected_grade", "tail"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, z double, expected_grade double, tail array<double>")


def keep_good(docs: DataFrame, model: CumulativeLink, text_col: str = "text", above: int = 0, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with P(grade > above) >= ``least``, with all their columns."""
    latents, theta = _latents(docs.sparkSession, model), float(model.theta[above])
    edge = theta + float(np.log(least / (1 - least)))
    return _keep(docs, text_col, latents, lambda z: z >= edge)
