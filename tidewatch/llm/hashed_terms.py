"""Hashed text terms, their supervised selection and bounded training samples.

A term table turns each word of a text into a few hashed terms; which terms are worth a
weight is decided by a likelihood-ratio test over the labelled sample, as one Spark
aggregation; texts then become short lists of the positions of selected terms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|~^_=+-/\\`@"
_LETTERS = re.compile(r"[^\W\d_]+")


def word_terms(word: bytes) -> list[int]:
    """A lower-cased word without the punctuation at its edges, and its first four and five characters."""
    w = word.lower().strip(_EDGE).decode("utf-8", "replace")
    if not w:
        return []
    return [zlib.crc32(t.encode()) % BUCKETS for t in dict.fromkeys((w, "4^" + w[:4], "5^" + w[:5]))]


def shape_terms(word: bytes) -> list[int]:
    """A word, its trailing and leading symbols, its letter shape and its length class, for style."""
    s = word.decode("utf-8", "replace")
    core = s.strip(_EDGE.decode())
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"\d", "9", _LETTERS.sub(lambda m: "A" * min(2, len(m[0])) if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", s)))
    got = ["s^" + shape, "w^" + core.lower()]
    if not s.endswith(core) or not core:
        got.append("e^" + s[len(s.rstrip(_EDGE.decode())) :])
    return [zlib.crc32(t.encode()) % BUCKETS for t in dict.fromkeys(got)]


def text_words(text: bytes) -> list[bytes]:
    """Words of a text."""
    return text.split()


def style_words(text: bytes) -> list[bytes]:
    """Words as they stand, and a marker word for every line that equals an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = len(lines) - len(set(lines))
    return text.split() + [b"\x00again"] * again + [b"\x00line"] * len(lines)


@dataclass(frozen=True)
class Terms:
    """How texts become terms.  counted: positions repeat as terms do; else each stands once."""

    words: Callable[[bytes], list[bytes]]
    terms: Callable[[bytes], list[int]]
    counted: bool


WORDS = Terms(text_words, word_terms, False)
STYLE = Terms(style_words, shape_terms, True)


class Lookup:
    """Words to packed positions of selected terms, with a bounded cache of words."""

    def __init__(self, how: Terms, chosen: np.ndarray | None, most: int = 200_000):
        self.how, self.most, self.cache = how, most, {}
        self.place = None if chosen is None else {int(b): i for i, b in enumerate(chosen)}

    def _new(self, word: bytes) -> bytes:
        terms = self.how.terms(word)
        if self.place is not None:
            terms = [self.place[t] for t in terms if t in self.place]
        got = np.array(terms, "<i4").tobytes()
        if len(self.cache) >= self.most:
            self.cache.clear()
        if len(word) < 100:
            self.cache[word] = got
        return got

    def __call__(self, text: bytes) -> tuple[np.ndarray, int]:
        """Positions (or buckets, without a selection) and the number of words."""
        words = self.how.words(text)
        get, new = self.cache.get, self._new
        uniq = words if self.how.counted else set(words)
        ids = np.frombuffer(b"".join([new(w) if (g := get(w)) is None else g for w in uniq]), "<i4")
        return (ids if self.how.counted else np.unique(ids)), len(words)


def labelled_sample(docs: DataFrame, labels: DataFrame, grade: str, id_col: str, text_col: str, per_grade: int, grades: int) -> DataFrame:
    """(text, grade, key) of at most ``per_grade`` labelled documents of each grade.

    Those with the least hash of their id are taken: a bounded sample that no order of the
    rows changes.  The chosen ids are bounded, so they are broadcast to one scan of docs.
    ``key``: a hash of text and grade, by which later steps order rows.
    """
    picked = None
    known = labels.select(F.col(id_col).alias("__id"), F.col(grade).cast("int").alias("grade")).where("__id is not null and grade is not null")
    for g in range(grades):
        part = known.where(F.col("grade") == g).orderBy(F.xxhash64("__id"), "__id").limit(per_grade)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(picked), "__id")
    return rows.select("text", "grade", F.xxhash64("text", "grade").alias("key"))


def term_counts(sample: DataFrame, how: Terms, grades: int) -> DataFrame:
    """(term, n array<long>): in how many sample texts of each grade a hashed term stands."""

    def run(batches):
        look = Lookup(how, None)
        held = {}
        for b in batches:
            for t, g in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                ids, _ = look(t.as_py() or b"")
                for x in np.unique(ids).tolist():
                    held.setdefault(x, [0] * grades)[g] += 1
            if len(held) > 300_000:
                yield from _flush(held, grades)
                held = {}
        yield from _flush(held, grades)

    cols = ", ".join(f"n{g} long" for g in range(grades))
    got = sample.select("text", "grade").mapInArrow(run, f"term int, {cols}")
    return got.groupBy("term").agg(*[F.sum(f"n{g}").alias(f"n{g}") for g in range(grades)])


def _flush(held: dict[int, list[int]], grades: int):
    if held:
        n = np.array(list(held.values()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *[pa.array(n[:, g]) for g in range(grades)]], ["term", *[f"n{g}" for g in range(grades)]])


def _gain(with_it: list, totals: list[int], log, when):
    """Twice the sum over grades, with and without a feature, of observed times log(observed / expected)."""
    n_all, seen, gain = float(max(1, sum(totals))), sum(with_it[1:], with_it[0]), 0.0
    for n, total in zip(with_it, totals, strict=True):
        for o, e in ((n, seen * (total / n_all)), (float(total) - n, (n_all - seen) * (total / n_all))):
            gain = gain + when((o > 0) & (e > 0), o, log(o / e))
    return 2 * gain


def term_gains(n: np.ndarray, totals: list[int]) -> np.ndarray:
    """Gains of features by their counts (features, grades)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return _gain([n[:, g] for g in range(len(totals))], totals, np.log, lambda test, o, x: np.where(test, o * x, 0.0))


def select_terms(counts: DataFrame, totals: list[int], most: int, least_gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the greatest likelihood-ratio gain and their counts by grade; at most ``most``, in order of term."""
    columns = [F.col(f"n{g}").cast("double") for g in range(len(totals))]
    gain = _gain(columns, totals, F.log, lambda test, o, x: F.when(test, o * x).otherwise(0.0))
    return _collected(counts.withColumn("gain", gain).where(F.col("gain") >= least_gain).orderBy(F.desc("gain"), "term").limit(most).drop("gain"), len(totals))


def frequent_terms(counts: DataFrame, totals: list[int], most: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` most frequent terms that at most ``share`` of the texts have, and their counts by grade."""
    seen = sum((F.col(f"n{g}") for g in range(1, len(totals))), F.col("n0"))
    return _collected(counts.withColumn("seen", seen).where(F.col("seen") <= share * sum(totals)).orderBy(F.desc("seen"), "term").limit(most).drop("seen"), len(totals))


def _collected(counts: DataFrame, grades: int) -> tuple[np.ndarray, np.ndarray]:
    got = np.array(sorted(map(tuple, counts.collect())), np.int64).reshape(-1, grades + 1)
    return got[:, 0], got[:, 1:].astype(float)


def select_pairs(features: DataFrame, n: np.ndarray, totals: list[int], most: int, least_gain: float) -> list[tuple]:
    """(a, b, n0, n1) of two-grade pairs of terms whose joint gain exceeds that of either alone by ``least_gain``.

    ``features``: texts as positions of candidate terms (``sample_features``); ``n``: the
    candidates' counts.  Tasks count joint texts and pass on a row for each term and
    grade, which meet in one small group a term.  At most ``most`` pairs are returned.
    """
    size, alone = len(n), term_gains(n, totals)

    def joint(batches):
        total = np.zeros((2, size * size), np.int32)
        for b in batches:
            for grade, ids in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(ids.as_buffer(), "<i4").astype(np.int64)
                total[grade][(x[:, None] * size + x[None, :])[np.triu_indices(len(x), 1)]] += 1
        for first in range(0, size, 128):
            rows = [(a, g, total[g, a * size + a : (a + 1) * size]) for a in range(first, min(first + 128, size)) for g in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].astype("<i4").tobytes() for r in rows], pa.binary())], ["a", "grade", "joint"])

    def gains(table: pa.Table) -> pa.Table:
        a = table.column("a")[0].as_py()
        both = np.zeros((size - a, 2))
        for g, x in zip(table.column("grade").to_pylist(), table.column("joint").to_pylist(), strict=True):
            both[:, g] += np.frombuffer(x, "<i4")
        more = term_gains(both, totals) - np.maximum(alone[a], alone[a:])
        b = np.flatnonzero(more >= least_gain)
        b = b[b > 0]
        return pa.table({"a": pa.array([a] * len(b), pa.int32()), "b": pa.array(a + b, pa.int32()), "n0": both[b, 0], "n1": both[b, 1], "more": more[b]})

    found = features.select("grade", "ids").mapInArrow(joint, "a int, grade int, joint binary").groupBy("a").applyInArrow(_named(gains), "a int, b int, n0 double, n1 double, more double")
    return [tuple(r)[:4] for r in found.orderBy(F.desc("more"), "a", "b").limit(most).collect()]


def _named(f):
    return lambda table: f(table)


def sample_features(sample: DataFrame, how: Terms, chosen: np.ndarray) -> DataFrame:
    """(key, grade int, ids binary int32, words int): the sample as positions of chosen terms."""

    def run(batches):
        look = Lookup(how, chosen)
        for b in batches:
            got = [look(t.as_py() or b"") for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([n for _, n in got], pa.int32())], ["key", "grade", "ids", "words"])

    return sample.select("text", "grade", "key").mapInArrow(run, "key long, grade int, ids binary, words int")


def shards(features: DataFrame, n: int) -> DataFrame:
    """(shard, rows): features dealt by key to ``n`` shards, a row for each, ordered by key and content.

    What a shard holds and in which order depends on the sample alone, not on partitions,
    files or cores.  A shard is bounded as the sample is.
    """
    dealt = features.withColumn("shard", F.pmod("key", F.lit(n)).cast("int"))
    held = F.sort_array(F.collect_list(F.struct("key", "grade", "words", "ids")))
    return dealt.groupBy("shard").agg(held.alias("rows")).repartitionByRange(n, "shard")


def shard_rows(batch: pa.RecordBatch):
    """(shard, grades, words, positions of each row) of every row of a batch of ``shards``."""
    for i in range(batch.num_rows):
        rows = batch.column(1)[i].values
        ids = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.field("ids")]
        yield batch.column(0)[i].as_py(), rows.field("grade").to_numpy(), rows.field("words").to_numpy(), ids
