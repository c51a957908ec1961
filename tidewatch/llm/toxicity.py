"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_t x_t + sum over pairs of <v_t, v_u> x_t x_u): the pairwise
part learns that two terms together are toxic where neither is alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace
from .hashed_terms import WORDS, Lookup, frequent_terms, labelled_sample, sample_features, select_pairs, select_terms, shard_rows, shards, term_counts


@dataclass
class FactorizationMachine:
    """Weights of selected terms.  x_t is 1 where the term stands in a text, else 0."""

    chosen: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.w0
        v = self.v[ids]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[ids].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, ids: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.raw(ids), -40, 40))))


#: Rows of a gradient step.
BATCH = 128


def _pass(w0, w, v, docs, y, rate, decay, rng, batch=BATCH):
    """One AdaGrad pass over docs (lists of positions) from (w0, w, v); the moved weights."""
    w, v = w.copy(), v.copy()
    g0, gw, gv = 1e-3, np.full_like(w, 1e-3), np.full_like(v, 1e-3)
    order = rng.permutation(len(docs))
    for a in range(0, len(order), batch):
        rows = [docs[i] for i in order[a : a + batch]]
        t, n = y[order[a : a + batch]], np.array([len(r) for r in rows])
        # The batch's own terms alone are moved.
        terms, ids = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
        of = np.repeat(np.arange(len(rows)), n)
        here = np.zeros((len(rows), len(terms)))
        here[of, ids] = 1.0
        wt, vt = w[terms], v[terms]
        s = here @ vt
        p = 1 / (1 + np.exp(-np.clip(w0 + here @ wt + 0.5 * ((s * s).sum(axis=1) - here @ (vt * vt).sum(axis=1)), -30, 30)))
        e = (p - t) / len(rows)
        d0, sums = e.sum(), here.T @ e
        dw = sums + decay * wt
        dv = here.T @ (e[:, None] * s) - sums[:, None] * vt + decay * vt
        g0 += d0 * d0
        gw[terms] += dw * dw
        gv[terms] += dv * dv
        w0 -= rate * d0 / np.sqrt(g0)
        w[terms] -= rate * dw / np.sqrt(gw[terms])
        v[terms] -= rate * dv / np.sqrt(gv[terms])
    return w0, w, v


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 15_000, most_terms: int = 20_000, least_gain: float | None = None, frequent: int = 600, most_pairs: int = 1_000, pair_gain: float | None = None, factors: int = 8, rounds: int = 6, passes: int = 2, least_steps: int = 300, rate: float = 0.15, decay: float = 1e-4, parts: int = 6, seed: int = 7) -> FactorizationMachine:
    """Fit on at most ``per_class`` labelled rows of each class (those of the least id hash).

    Terms are those that lean to a class alone, by ``least_gain``, and those of pairs that
    lean together by ``pair_gain`` more than either does alone, wherever one or both are
    neutral.  Gains are log likelihood ratios; by default a term needs one more than the
    logarithm of the terms compared, which a tenth of a term at most reaches by chance, and
    a pair twice that: few labelled rows of few terms need less than many do.  Pairs are counted among the leaning terms of greatest gain and the
    ``frequent`` most frequent others.  Each round, every one of ``parts`` shards of the
    sample runs ``passes`` AdaGrad passes from the shared weights and the weights are
    averaged in order of shard, so that the model depends on the rows alone.  Small shards
    run more passes, so that each takes ``least_steps`` steps in all: few labelled rows
    would otherwise end before the weights have moved.  The intercept is then shifted to the class shares among all given labels.  Rows of ``labels`` with a
    null id or grade are ignored; without both classes every score is the share of the one
    there is (0.5 shrunk, without labels 0).
    """
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    counted = {r[0]: r[1] for r in labels.where(F.col(grade).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(grade).cast("int")).count().collect()}
    n0, n1 = counted.get(0, 0), counted.get(1, 0)
    if not n0 or not n1:
        flat = np.log((n1 + 0.5) / (n0 + 0.5)) if n0 + n1 else -40.0
        return FactorizationMachine(np.empty(0, np.int64), float(flat), np.empty(0), np.empty((0, factors)))
    sample = work.save(labelled_sample(docs, labels, grade, id_col, text_col, per_class, 2), "sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("grade").count().collect()}
    totals = [sizes.get(0, 0), sizes.get(1, 0)]
    counts = work.save(term_counts(sample, WORDS, 2), "counts")
    if least_gain is None:
        least_gain = float(np.log(max(1, counts.count()))) + 1
    pair_gain = 2 * least_gain if pair_gain is None else pair_gain
    leaning, _ = select_terms(counts, totals, most_terms, least_gain)
    top, n_top = select_terms(counts, totals, frequent // 2, least_gain)
    often, n_often = frequent_terms(counts, totals, frequent, 0.5)
    fresh = ~np.isin(often, top)
    places = np.concatenate((top, often[fresh]))
    order = np.argsort(places)
    asked, n_asked = places[order], np.concatenate((n_top, n_often[fresh]))[order]
    # Written first: two Python steps in one task would hold twice the workers.
    pairs = select_pairs(work.save(sample_features(sample, WORDS, asked), "asked"), n_asked, totals, most_pairs, pair_gain) if len(asked) else []
    chosen = np.union1d(leaning, np.array([asked[i] for p in pairs for i in p[:2]], np.int64))
    n = np.array(counts.where(F.col("term").isin([int(t) for t in chosen])).orderBy("term").collect(), float).reshape(-1, 3)[:, 1:]
    lean = np.log((n[:, 1] + 0.5) / (totals[1] + 1)) - np.log((n[:, 0] + 0.5) / (totals[0] + 1))
    dealt = work.save(shards(sample_features(sample, WORDS, chosen), parts), "shards")
    rng = np.random.default_rng(seed)
    w0, w, v = float(np.log((totals[1] + 0.5) / (totals[0] + 0.5))), np.sign(lean) * (np.minimum(np.abs(lean), 4) / 4) ** 2, rng.normal(0, 0.02, (len(chosen), factors))
    for k, (a, b, n_clean, n_toxic) in enumerate(pairs):
        # A pair starts with a little of what it says, in a factor of its own as far as they go.
        i, j = np.searchsorted(chosen, (asked[a], asked[b]))
        sign = 1.0 if n_toxic * totals[0] > n_clean * totals[1] else -1.0
        v[i, k % factors] = max(v[i, k % factors], 0.3)
        v[j, k % factors] = sign * max(abs(v[j, k % factors]), 0.3)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((w0, w, v))

        def run(batches, sent=sent, k=k):
            for batch in batches:
                for shard, y, _, rows in shard_rows(batch):
                    a, b, c = sent.value
                    local = np.random.default_rng((seed, k, shard))
                    for _ in range(max(passes, -(-least_steps // (rounds * -(-max(1, len(rows)) // BATCH))))):
                        a, b, c = _pass(a, b, c, rows, y.astype(float), rate / (1 + k), decay, local)
                    made = np.concatenate(([a], b, c.ravel())).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([made], pa.binary())], ["shard", "n", "weights"])

        # A row for each shard, of a size that most_terms and frequent bound.
        got = [(r[1], np.frombuffer(r[2])) for r in sorted(dealt.mapInArrow(run, "shard int, n long, weights binary").collect())]
        if not got:
            break
        mean = sum(n_ * x for n_, x in got) / sum(n_ for n_, _ in got)
        w0, w, v = float(mean[0]), mean[1 : 1 + len(chosen)], mean[1 + len(chosen) :].reshape(v.shape)
        sent.unpersist()
    work.clear()
    w0 += float(np.log(n1 / n0) - np.log(totals[1] / totals[0])) if min(totals) else 0.0
    return FactorizationMachine(chosen, w0, w, v)


def _scorer(spark, model: FactorizationMachine):
    sent = spark.sparkContext.broadcast(model)

    def scores(column) -> Iterator[float]:
        m = sent.value
        look = m.__dict__.setdefault("look", Lookup(WORDS, m.chosen))  # the cache lives as long as the model
        for t in column:
            ids, _ = look(t.as_py() or b"")
            yield m.score(ids)

    return scores


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, kept expressions, score), a row for each row of ``docs``.

    Null and empty texts get the score of no term.  Ids may be null or repeat: rows are
    scored one by one.  Columns of ``docs`` that aren't named don't matter.
    """
    scores = _scorer(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in (keep or {}).items()], F.col(text_col).cast("binary").alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(scores(b.column(b.num_columns - 1))), pa.float64())], [*names, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double")


def keep_clean(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    return _keep(docs, text_col, _scorer(docs.sparkSession, model), lambda s: s < threshold)


def _keep(docs: DataFrame, text_col: str, scores, good) -> DataFrame:
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([good(s) for s in scores(b.column(at).cast(pa.binary()))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
