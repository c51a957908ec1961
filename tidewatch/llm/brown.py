"""Brown class-based n-grams: exchange clustering, class transitions, word emissions.

log10 P(text) = sum over its tokens of log10 P(class | class before) + log10 P(token | class);
tokens are the words and one end token, and a text starts after an end.

* Known words are those of the greatest counts, at most ``known_words`` and seen twice or
  more.  Each has a class found by exchange: the ``exchange_words`` most frequent in
  rounds, in which every word's exact gain in log likelihood of moving to every class is
  computed in parallel from the bigram table, and moves that would lower the likelihood
  together aren't made; then every other known word joins the class of its greatest gain.
* Every other word, seen or not, belongs to a rare class chosen by a hash of its last two
  bytes.  A rare class gives its unseen words, as one event, what absolute discounting
  takes from its seen ones.
* Transitions are smoothed with the classes' own shares.

Hashes, counts and classes of known words travel to the tasks, 18 bytes each.  Counts of
all other words stay in a table and are joined by word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace, held_out

END = b""  # no word is empty


@dataclass
class Model:
    """By rank of the known words: count, class and log10 emission; classes: exchanged, then rare, then the end."""

    hashes: np.ndarray
    ranks: np.ndarray
    count: np.ndarray
    klass: np.ndarray
    classes: int
    rare: int
    step: np.ndarray
    emit: np.ndarray
    unseen: np.ndarray
    rare_total: np.ndarray
    discount: float
    tokens: int
    vocabulary: int
    ends: int


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-2:]) % rare


def _rare_column(rare: int) -> Column:
    last = F.when(F.length("word") > 2, F.expr("substring(word, length(word) - 1, 2)")).otherwise(F.col("word"))
    return F.pmod(F.crc32(last), F.lit(rare)).cast("int")


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 100_000) -> DataFrame:
    """(word binary, n long) over all texts, the end token as the empty word; null texts have the end alone.

    Tasks hold at most about ``most`` words at a time before they pass their sums on.
    """

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                held.update((t.as_py() or b"").lower().split())
                held[END] += 1
                if len(held) > most:
                    yield _counts(held)
                    held = Counter()
        if held:
            yield _counts(held)

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def known_hashes(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most ``most`` words, in order of rank: those with as great a count as fits, at least 2."""
    words = counts.where((F.length("word") > 0) & (F.col("n") >= 2))
    # Counts of counts: at most as many rows as the square root of twice the tokens.
    sizes = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toPandas()
    fits = sizes["words"].cumsum() <= most
    if not fits.any():
        return np.empty(0, np.int64), np.empty(0)
    got = words.where(F.col("n") >= int(sizes["n"][fits].min())).select(F.xxhash64("word").alias("h"), "n").toPandas()
    h, n = got["h"].to_numpy(np.int64), got["n"].to_numpy(float)
    order = np.lexsort((h, -n))
    return h[order], n[order]


class Encoder:
    """Tokens of texts as ranks of known words, others as -1 - rare class; with a bounded cache of words.

    Known words are told by 64-bit hashes.
    """

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray, rare: int, most: int = 200_000):
        self.hashes, self.ranks, self.rare, self.most, self.cache = hashes, ranks, rare, most, {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        got = list(map(self.cache.get, tokens))
        if None in got:
            self._learn({t for t, g in zip(tokens, got, strict=True) if g is None})
            got = list(map(self.cache.get, tokens))
            if len(self.cache) > self.most:
                self.cache = {}
        return np.array(got, np.int32)

    def _learn(self, words: set[bytes]) -> None:
        names = list(words)
        h = np.array([xxhash.xxh64_intdigest(w, 42) for w in names], np.uint64).view(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            ids = np.where(self.hashes[at] == h, self.ranks[at], -1).tolist()
        else:
            ids = [-1] * len(names)
        self.cache.update((w, i if i >= 0 else -1 - rare_class(w, self.rare)) for w, i in zip(names, ids, strict=True))


def _codes(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a batch, one after another, and the number of each."""
    parts = [np.frombuffer(x.as_buffer(), "<i4") for x in b.column(column)]
    return np.concatenate(parts or [np.empty(0, "<i4")]), np.array([len(p) for p in parts], np.int64)


def _neighbours(ids: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of texts of n codes each: every code and an end after the code before, an end at first."""
    after = np.insert(ids, np.cumsum(n), end)
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[:1] = end
    return before, after


def _sums(code_of, span: int, most: int = 2_000_000):
    """A function of batches that yields (a, b, n) of the bigrams of ``code_of(ids)``."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            ids, n = _codes(b, 0)
            before, after = _neighbours(code_of(ids), n, span - 1)
            held.append(before.astype(np.int64) * span + after)
            size += len(after)
            if size > most:
                yield _pairs(held, span)
                held, size = [], 0
        if held:
            yield _pairs(held, span)

    return run


def _pairs(held: list[np.ndarray], span: int) -> pa.RecordBatch:
    codes, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array((codes // span).astype(np.int32)), pa.array((codes % span).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])


def bigrams(encoded: DataFrame, code_of, span: int) -> DataFrame:
    """(a, b, n) over encoded texts; ``code_of`` maps ids to 0 .. span - 2, and span - 1 is the end."""
    return encoded.select("ids").mapInArrow(_sums(code_of, span), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams, up to what no clustering changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def best_moves(right: np.ndarray, left: np.ndarray, twice: np.ndarray, home: np.ndarray, table: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word its best class and the exact gain of moving there alone.

    right[w, c]: bigrams (w, class c); left[w, c]: (class c, w); twice[w]: (w, w), held
    in both; table: class bigram counts.  Likelihood: sum N(a,b) log N(a,b) less, for
    either side, sum N(a) log N(a), up to what no move changes.
    """
    to, gain = home.copy(), np.zeros(len(home))
    rows, cols = table.sum(axis=1), table.sum(axis=0)
    for i, h in enumerate(home):
        r, l, t = right[i], left[i], twice[i]
        n_r, n_l = r.sum(), l.sum()
        if not n_r + n_l:
            continue
        # The table without the word.
        base = table.copy()
        base[h, :] -= r
        base[:, h] -= l
        base[h, h] += t
        r0, l0 = r.copy(), l.copy()
        r0[h] -= t
        l0[h] -= t
        out = _xlogx(base + 0.0)
        # Joining class c changes row c, column c and the corner.
        c = np.arange(classes)
        row = _xlogx(base[:classes, :] + r0[None, :]) - out[:classes, :]
        col = _xlogx(base[:, :classes] + l0[:, None]) - out[:, :classes]
        f = row.sum(axis=1) + col.sum(axis=0) - row[c, c] - col[c, c]
        f += _xlogx(base[c, c] + r0[c] + l0[c] + t) - out[c, c]
        b_rows, b_cols = rows.copy(), cols.copy()
        b_rows[h] -= n_r
        b_cols[h] -= n_l
        f -= _xlogx(b_rows[c] + n_r) - _xlogx(b_rows[c]) + _xlogx(b_cols[c] + n_l) - _xlogx(b_cols[c])
        best = int(np.argmax(f))
        if f[best] > f[h] + 1e-9:
            to[i], gain[i] = best, f[best] - f[h]
    return to, gain


def exchange_classes(pairs: DataFrame, exchange: int, classes: int, rounds: int, parts: int = 12) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the words 0 .. exchange-1, the class bigram table, and the likelihood after each round.

    Codes ``exchange`` and ``exchange + 1`` are other words and the end, classes of their
    own.  Words start dealt by rank.  In round k, words with (w + k) even may move, so
    that neighbours in the ranking don't chase each other; of their moves the half of
    greater gain is kept, again and again, until the likelihood rises.  Two rounds without
    a move end it.  What comes to the driver is a row for each exchange word and the
    class table: both bounded by parameters.
    """
    spark, size = pairs.sparkSession, classes + 2
    klass = np.concatenate((np.arange(exchange) % classes, [classes, classes + 1]))
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("o"), "n", F.lit(0).alias("side")).unionByName(pairs.select(F.col("b").alias("w"), F.col("a").alias("o"), "n", F.lit(1).alias("side")))
    work = Workspace(spark, "exchange")
    sides = work.save(both.where(F.col("w") < exchange).repartition(parts, "w"), "sides")
    rest = [(r[0], r[1], r[2]) for r in pairs.where((F.col("a") >= exchange) & (F.col("b") >= exchange)).collect()]  # at most four

    def class_table(kl: np.ndarray) -> np.ndarray:
        def gather(batches):
            t = np.zeros((size, size))
            for b in batches:
                w, o, n, s = (b.column(i).to_numpy() for i in range(4))
                m = s == 0
                np.add.at(t, (kl[w[m]], kl[o[m]]), n[m])
                m = (s == 1) & (o >= exchange)
                np.add.at(t, (kl[o[m]], kl[w[m]]), n[m])
            yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary())], ["t"])

        t = sum((np.frombuffer(r[0]).reshape(size, size) for r in sides.mapInArrow(gather, "t binary").collect()), np.zeros((size, size)))
        for a, b, n in rest:
            t[kl[a], kl[b]] += n
        return t

    table = class_table(klass)
    history, still = [likelihood(table)], 0
    for k in range(rounds):
        moves = _moves(sides, klass, table, k, size, classes, parts)
        while moves:
            tried = klass.copy()
            for w, to, _ in moves:
                tried[w] = to
            now = class_table(tried)
            if likelihood(now) > history[-1]:
                klass, table = tried, now
                break
            moves = moves[: len(moves) // 2]
        still = 0 if moves else still + 1
        history.append(likelihood(table))
        if still == 2:
            break
    work.clear()
    return klass, table, history


def _moves(sides: DataFrame, klass: np.ndarray, table: np.ndarray, k: int, size: int, classes: int, parts: int) -> list[tuple]:
    """(w, to, gain) of the words that round k lets move and that gain by it, greatest gain first."""

    def moves(frame: pd.DataFrame) -> pd.DataFrame:
        w, o, n, s = (frame[c].to_numpy() for c in ("w", "o", "n", "side"))
        mine = np.unique(w)
        mine = mine[(mine + k) % 2 == 0]
        at = np.full(len(klass), -1)
        at[mine] = np.arange(len(mine))
        right, left, twice = np.zeros((len(mine), size)), np.zeros((len(mine), size)), np.zeros(len(mine))
        for side, into in ((0, right), (1, left)):
            m = (s == side) & (at[w] >= 0)
            np.add.at(into, (at[w[m]], klass[o[m]]), n[m])
        m = (s == 0) & (w == o) & (at[w] >= 0)
        np.add.at(twice, at[w[m]], n[m])
        to, gain = best_moves(right, left, twice, klass[mine], table, classes)
        return pd.DataFrame({"w": mine, "to": to, "gain": gain})[gain > 0]

    got = sides.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(4 * parts))).groupBy("part").applyInPandas(moves, "w long, to long, gain double").collect()
    return sorted((tuple(r) for r in got), key=lambda m: (-m[2], m[0]))


def joining_classes(entries: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, classes: int) -> np.ndarray:
    """For each word, a pair (codes, counts) of its neighbours, the class whose likelihood gains most by it.

    Code c < len(table): followed by class c; code len(table) + c: after class c.
    """
    size = len(table)
    if not entries:
        return np.empty(0, np.int64)
    of = np.repeat(np.arange(len(entries)), [len(c) for c, _ in entries])
    code, n = np.concatenate([c for c, _ in entries]).astype(np.int64), np.concatenate([x for _, x in entries]).astype(float)
    side, other = code // size, code % size
    # cells[i, c]: the cell that entry i adds to if its word joins class c.
    cells = np.where(side[:, None] == 0, table[:classes, :].T[other], table[:, :classes][other])
    gain = np.zeros((len(entries), classes))
    np.add.at(gain, of, _xlogx(cells + n[:, None]) - _xlogx(cells))
    right, left = np.zeros((len(entries), size)), np.zeros((len(entries), size))
    np.add.at(right, (of[side == 0], other[side == 0]), n[side == 0])
    np.add.at(left, (of[side == 1], other[side == 1]), n[side == 1])
    # The corner cell takes both sides at once.
    corner, r, l = np.diag(table)[:classes], right[:, :classes], left[:, :classes]
    gain += _xlogx(corner + r + l) + _xlogx(corner) - _xlogx(corner + r) - _xlogx(corner + l)
    for total, extra in ((table.sum(axis=1)[:classes], right.sum(axis=1)), (table.sum(axis=0)[:classes], left.sum(axis=1))):
        gain -= _xlogx(total + extra[:, None]) - _xlogx(total)
    return gain.argmax(axis=1)


def join_rest(encoded: DataFrame, klass: np.ndarray, table: np.ndarray, exchange: int, known: int, classes: int) -> np.ndarray:
    """Classes of the known words exchange .. known-1, by their neighbours' classes; those without neighbours in the table: class 0."""
    size = len(table)

    def run(batches):
        held, total = [], 0
        for b in batches:
            ids, n = _codes(b, 0)
            before, after = _neighbours(ids.astype(np.int64), n, -1 << 30)
            near = lambda x: np.where(x == -1 << 30, size - 1, np.where((x >= 0) & (x < exchange), klass[np.clip(x, 0, exchange)], size - 2))
            for word, code in ((before, near(after)), (after, size + near(before))):
                m = word >= exchange
                held.append(word[m] * (2 * size) + code[m])
                total += int(m.sum())
            if total > 2_000_000:
                yield _pairs(held, 2 * size)
                held, total = [], 0
        if held:
            yield _pairs(held, 2 * size)

    def assign(batches):
        for b in batches:
            entries = [(x.values.field("b").to_numpy(), x.values.field("n").to_numpy()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(joining_classes(entries, table, classes).astype(np.int32))], ["a", "klass"])

    # One exchange by word serves both groupings.
    near = encoded.select("ids").mapInArrow(run, "a int, b int, n long").repartition("a").groupBy("a", "b").agg(F.sum("n").alias("n"))
    found = near.groupBy("a").agg(F.collect_list(F.struct("b", "n")).alias("x")).mapInArrow(assign, "a int, klass int").toPandas()
    out = np.zeros(max(0, known - exchange), np.int64)
    out[found["a"].to_numpy(np.int64) - exchange] = found["klass"].to_numpy(np.int64)
    return out


ENCODED = "row long, doc_id {kind}, held_out boolean, trains boolean, n_tokens long, ids binary, word binary, n long"


def encode(docs: DataFrame, id_col: str, text_col: str, folds: int, trains: Column, hashes: np.ndarray, ranks: np.ndarray, rare: int) -> DataFrame:
    """A row of ids for each text and, for each of its words that isn't known, a row (row, word, n)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((hashes, ranks))
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), held_out(F.col(id_col), folds).alias("held_out"), trains.alias("trains"), F.col(text_col).cast("binary").alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    names = [c.split(" ")[0] for c in ENCODED.split(", ")]

    def run(batches):
        look = Encoder(*sent.value, rare)
        for b in (whole.slice(a, 500) for whole in batches for a in range(0, whole.num_rows, 500)):
            made, sizes, tails = [], [], []
            for i, t in enumerate(b.column(4)):
                tokens = (t.as_py() or b"").lower().split()
                ids = look(tokens)
                made.append(ids.astype("<i4").tobytes())
                sizes.append(len(tokens) + 1)
                other = np.flatnonzero(ids < 0).tolist()
                if other:
                    tails += [(i, w, n) for w, n in Counter(tokens[k] for k in other).items()]
            whole = [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays([*whole, pa.nulls(b.num_rows, pa.binary()), pa.nulls(b.num_rows, pa.int64())], names)
            if tails:
                blank = [pa.nulls(len(tails), c.type) for c in whole[1:]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([x[0] for x in tails], pa.int64())), *blank, pa.array([x[1] for x in tails], pa.binary()), pa.array([x[2] for x in tails], pa.int64())], names)

    return keyed.mapInArrow(run, ENCODED.format(kind=kind))


@dataclass
class Vocabulary:
    """All training counts as a table, and the known words of them by rank."""

    counts: DataFrame
    hashes: np.ndarray
    count: np.ndarray

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and their ranks."""
        order = np.argsort(self.hashes)
        return self.hashes[order], order.astype(np.int32)


def fit(encoded: DataFrame, words: Vocabulary, exchange_words: int = 3_000, classes: int = 48, rare: int = 64, rounds: int = 8, prior: float = 20.0) -> Model:
    """The model of encoded training texts (column ids)."""
    known, exchange = len(words.hashes), min(exchange_words, len(words.hashes))
    other = np.int64(exchange)

    def first(ids):
        return np.where((ids >= 0) & (ids < exchange), ids, other)

    work = Workspace(encoded.sparkSession, "brown-fit")
    pairs = work.save(bigrams(encoded, first, exchange + 2), "pairs")
    klass, table, _ = exchange_classes(pairs, exchange, classes, rounds)
    every = np.concatenate((klass[:exchange], join_rest(encoded, klass, table, exchange, known, classes)))

    def final(ids):
        out = classes - 1 - ids.astype(np.int64)
        seen = ids >= 0
        out[seen] = every[ids[seen]]
        return out

    size = classes + rare + 1
    steps = np.zeros((size, size))
    for a, b, n in bigrams(encoded, final, size).collect():  # at most size squared
        steps[a, b] = n
    share = (steps.sum(axis=0) + 0.5) / (steps.sum() + 0.5 * size)
    step = (steps + prior * share[None, :]) / (steps.sum(axis=1, keepdims=True) + prior)
    in_class = np.bincount(every, words.count, classes) if known else np.zeros(classes)
    emit = np.log10(words.count / in_class[every]) if known else np.empty(0)
    every_count = words.counts.where(F.length("word") > 0)
    total = words.counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.length("word") == 0, F.col("n"))), F.count_if((F.col("n") == 1) & (F.length("word") > 0)), F.count_if((F.col("n") == 2) & (F.length("word") > 0))).first()
    discount = min(0.9, max(0.1, total[3] / max(1, total[3] + 2 * total[4])))
    # Known words have the greatest counts, so the rest is told by its counts.
    tail = every_count.where(F.col("n") < (int(words.count.min()) if known else 1 << 62)).groupBy(_rare_column(rare).alias("r")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()
    rare_total, distinct = np.zeros(rare), np.zeros(rare)
    for r in tail:
        rare_total[r["r"]], distinct[r["r"]] = r["n"], r["words"]
    unseen = np.where(rare_total > 0, discount * distinct / np.maximum(rare_total, 1), 1.0)
    hashes, ranks = words.lookup()
    work.clear()
    return Model(hashes, ranks, words.count, every, classes, rare, np.log10(step), emit, np.log10(unseen), rare_total, discount, int(total[0] or 0), int(total[1] or 0), int(total[2] or 0))


def vocabulary(train: DataFrame, work: Workspace, text_col: str = "text", known_words: int = 400_000) -> Vocabulary:
    counts = work.save(word_counts(train, text_col), "counts")
    return Vocabulary(counts, *known_hashes(counts, known_words))


def score(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, known_words: int = 400_000, rare: int = 64, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of ``docs``.

    ``train``: the rows to learn from, as a table or as a condition on ``docs``.  base_score
    is the add-0.1 unigram log10 probability, score the class model's, perplexity its
    10 ** (-score / n_tokens).  Null texts are empty (one token, the end).  Ids may be of
    any type, null or repeated: rows keep keys of their own.  Without training rows every
    token is unseen and the two scores are those of the smoothing alone.  An empty table
    gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "brown")
    inside = isinstance(train, Column)
    words = vocabulary(docs.where(train) if inside else train, work, text_col, known_words)
    look = words.lookup()
    coded = work.save(encode(docs, id_col, text_col, folds, F.coalesce(train, F.lit(False)) if inside else F.lit(False), *look, rare), "encoded")
    texts = coded.where("word is null")
    learn = texts.where("trains") if inside else work.save(encode(train, id_col, text_col, folds, F.lit(True), *look, rare), "train").where("word is null")
    model = fit(learn, words, rare=rare, **options)
    sent = spark.sparkContext.broadcast(model)
    log_all = math.log10(model.tokens + 0.1 * (model.vocabulary + 1))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = sent.value
        base, last = np.log10(m.count + 0.1) - log_all, len(m.step) - 1
        end = math.log10(m.ends + 0.1) - log_all
        for b in batches:
            ids, n = _codes(b, 4)
            seen = ids >= 0
            at = np.where(seen, ids, 0)
            kl = m.classes - 1 - ids.astype(np.int64)
            kl[seen] = m.klass[ids[seen]]
            before, after = _neighbours(kl, n, last)
            of = np.repeat(np.arange(len(n)), n)
            total = lambda x: np.bincount(of, np.where(seen, x[at] if len(x) else 0.0, 0.0), len(n))
            steps = np.bincount(np.repeat(np.arange(len(n)), n + 1), m.step[before, after], len(n))
            known = np.bincount(of[seen], minlength=len(n)) + (m.ends > 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(known.astype(np.int64)), pa.array(total(base) + end), pa.array(steps + total(m.emit))], ["row", "doc_id", "held_out", "n_tokens", "known", "base", "model"])

    scored = texts.select("row", "doc_id", "held_out", "n_tokens", "ids").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, model double")
    # Words that aren't known, joined to their counts, if any; adaptive joins split words that many texts have.
    tail = coded.where("word is not null").select("row", "word", "n").join(words.counts.select("word", F.col("n").alias("c")), "word", "left")
    pick = lambda x: F.element_at(F.array(*[F.lit(float(v)) for v in x]), _rare_column(rare) + 1)
    c, no = F.col("c"), F.col("c").isNull()
    seen = F.log10(c - F.lit(model.discount)) - pick(np.log10(np.maximum(model.rare_total, 1)))
    sums = tail.select("row", F.when(no, 0).otherwise(F.col("n")).alias("known"), (F.col("n") * (F.log10(F.coalesce(c, F.lit(0)) + 0.1) - log_all)).alias("base"), (F.col("n") * F.when(no, pick(model.unseen)).otherwise(seen)).alias("model"))
    sums = sums.groupBy("row").agg(F.sum("known").alias("known_tail"), F.sum("base").alias("base_tail"), F.sum("model").alias("model_tail"))
    both = lambda x: F.col(x) + F.coalesce(F.col(f"{x}_tail"), F.lit(0))
    out = scored.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", both("known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), both("base").alias("base_score"), both("model").alias("score"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
