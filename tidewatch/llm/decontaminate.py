"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

A CGK random walk reads a word sequence and writes three times as many symbols: at each
output step it writes the current word and, by a random bit of (step, word), stays or
moves on.  Two sequences a few edits apart agree on most output steps, so equality on
randomly sampled steps finds them; enough repetitions reach the target recall.  Windows
of a document that are as long as an item are embedded and looked up; what is found is
verified by exact edit distance over words.

Windows that can't be near an item aren't embedded: an item within e edits of some
passage has, cut into e + 1 runs of words, at least one run there unchanged (pigeonhole),
so only windows about such runs go to the embedding.  Which item a window is near, if
any, is found by the embedding's tables.  Items of many words are embedded in pieces of
nearly equal length that leave no word out: edits within the item's limit are at most
floor(limit / pieces) in one piece at least, which is that piece's own limit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A-Z lower-cased, other ASCII but letters and digits to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Numbers of words: 0 is the padding, 1 any word that no item has, 2 ... the items' words.
_PAD, _OTHER = 0, 1
#: Symbols that a task embeds at a time.
_ROOM = 1 << 21


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def step_bits(words: int, steps: int, seed: int) -> np.ndarray:
    """(words, steps / 64 up): 64 random bits in each, the moves of the walk by word and step; padding never moves."""
    blocks = np.arange((steps + 63) // 64, dtype=np.int64)
    bits = _mix(np.arange(words, dtype=np.int64)[:, None] * 0x10001 + blocks[None, :], seed * 1_000_003 + 7)
    bits[_PAD] = 0
    return bits


def cgk(windows: np.ndarray, steps: int, bits: np.ndarray) -> np.ndarray:
    """The walk's output, (rows, steps), of rows of word numbers that end with padding."""
    flat, at = windows.ravel(), np.arange(len(windows)) * windows.shape[1]
    out = np.empty((steps, len(windows)), windows.dtype)
    for j in range(steps):
        now = flat.take(at)
        out[j] = now
        at += (bits[:, j >> 6].take(now) >> np.uint64(j & 63)).astype(np.int64) & 1
    return out.T


def repetitions(recall: float, hit: float, bits: int) -> int:
    """Repetitions of ``bits`` sampled steps for that recall, if a step agrees with probability ``hit``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - hit**bits))


def edit_within(item: np.ndarray, passage: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of ``passage`` nearest to ``item`` by word edits, if within ``most``.

    Of equal distances the shortest, then the first stretch.  Exact dynamic programming,
    free at both ends of the passage; a cell is cost * unit - start, so that the least
    cell has the least cost and, of those, the latest start.
    """
    m, unit = len(item), len(passage) + 1
    ramp = np.arange(m + 1, dtype=np.int64) * unit
    prev = ramp.copy()  # item[:i] against an empty stretch at 0
    best = (m, 0, 0) if m <= most else None
    tmp = np.empty(m + 1, np.int64)
    for j, w in enumerate(passage.tolist(), 1):
        tmp[0] = -j
        np.minimum(prev[:-1] + (item != w) * unit, prev[1:] + unit, out=tmp[1:])
        prev = np.minimum.accumulate(tmp - ramp) + ramp
        cost = int(-(-prev[m] // unit))
        if cost <= most:
            start = int(cost * unit - prev[m])
            if best is None or (cost, j - start, start) < (best[0], best[2] - best[1], best[1]):
                best = (cost, start, j)
    return best


@dataclass
class Index:
    """Benchmark items: runs of words that open a window, and hash tables of sampled embeddings.

    ``units`` are what is embedded: (place of the item, offset, words), an item as a whole
    up to 1.5 times ``piece`` words, else pieces of about that many that cover it.
    """

    items: list[tuple[int, np.ndarray]]
    vocabulary: dict[bytes, int]
    ratio: float
    recall: float
    bits: int
    seed: int
    walks: int = 8
    piece: int = 64
    reps: int = field(init=False)

    def __post_init__(self):
        self.edits = [int(self.ratio * len(w) + 1e-9) for _, w in self.items]
        self.units, limits = [], []
        for k, (_, w) in enumerate(self.items):
            many = 1 if 2 * len(w) <= 3 * self.piece else -(-len(w) // self.piece)
            ends = np.arange(many + 1) * len(w) // many
            self.units += [(k, int(a), w[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
            limits += [self.edits[k] // many] * many
        self.lengths = np.array([len(w) for *_, w in self.units], np.int64)
        self.unit_edits = np.array(limits, np.int64)
        # Starts about a place are tried at this distance from each other.
        self.stride = np.maximum(1, self.unit_edits // 8)
        # An edit moves the walk for a while: about two of three steps a word disagree for each.
        self.reps = repetitions(self.recall, max(0.5, 1 - 2 * self.ratio), self.bits)
        self._index_runs()
        self.moves: dict[tuple[int, int], np.ndarray] = {}
        self.draws = np.random.default_rng(self.seed).random((self.reps, self.bits))
        self.tables: list[dict[int, list[int]]] = [{} for _ in range(self.reps)]
        for rows, keys in self.keys(np.concatenate([w for *_, w in self.units] or [np.empty(0, np.int32)]), np.cumsum(self.lengths) - self.lengths, self.lengths):
            for table, key in zip(self.tables, keys, strict=True):
                for k, x in zip(rows.tolist(), key.tolist(), strict=True):
                    table.setdefault(x, []).append(k)

    def _index_runs(self) -> None:
        runs: dict[tuple[int, ...], set[tuple[int, int]]] = {}
        for k, (*_, w) in enumerate(self.units):
            parts, words = int(self.unit_edits[k]) + 1, w.tolist()
            size = max(1, len(words) // parts)
            for a in range(0, parts * size, size):
                runs.setdefault(tuple(words[a : a + size]), set()).add((k, a))
        self.sizes, self.runs = sorted({len(r) for r in runs}), {}
        for size in self.sizes:
            keys = [r for r in runs if len(r) == size]
            codes = _roll(np.array(keys, np.int64).ravel(), size)[::size]
            order = np.argsort(codes, kind="stable")
            self.runs[size] = (codes[order], [sorted(runs[keys[i]]) for i in order])

    def keys(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Blocks of rows and their keys for each repetition: the embedding of the row's stretch of ``ids`` at sampled steps, and its length.

        Rows of a block have lengths within a factor of two, and a block has a bounded
        number of symbols, so neither a long item nor many windows take much memory.
        """
        padded = np.concatenate((ids, np.full(int(lengths.max(initial=0)) + 1, _OTHER))).astype(np.int32)
        classes = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for c in np.unique(classes).tolist():
            every, width = np.flatnonzero(classes == c), (1 << c) + 1
            for rows in np.array_split(every, -(-len(every) * 3 * width // _ROOM)):
                n, offsets = lengths[rows], np.arange(width)
                at = np.minimum(starts[rows][:, None] + offsets, len(padded) - 1)
                windows = np.where(offsets < n[:, None], padded[at], _PAD)
                made, steps = [], 3 * int(n.max())
                for r in range(self.reps):
                    if r % -(-self.reps // self.walks) == 0:
                        out = cgk(windows, steps, self._moves(r, 3 * (1 << c)))
                    sampled = (self.draws[r][None, :] * (3 * n)[:, None]).astype(np.int64)
                    picked = np.take_along_axis(out, sampled, axis=1).astype(np.int64)
                    key = _mix(n, r)
                    for b in range(self.bits):
                        key = _mix(picked[:, b] ^ key.astype(np.int64), b + 1)
                    made.append(key)
                yield rows, made

    def _moves(self, walk: int, steps: int) -> np.ndarray:
        if (walk, steps) not in self.moves:
            self.moves[walk, steps] = step_bits(len(self.vocabulary) + 2, steps, self.seed + walk)
        return self.moves[walk, steps]

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, distinct, of the windows to embed: those about an unchanged run of an item."""
        found: set[tuple[int, int]] = set()
        known = ids != _OTHER
        for size in self.sizes:
            if len(ids) < size:
                continue
            full = known[: len(ids) - size + 1].copy()
            for k in range(1, size):
                full &= known[k : len(ids) - size + 1 + k]
            starts = np.flatnonzero(full)
            if not len(starts):
                continue
            code = _roll(ids, size)[starts]
            codes, owners = self.runs[size]
            i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            for s, j in zip(starts[codes[i] == code].tolist(), i[codes[i] == code].tolist(), strict=True):
                found.update(((s - a) // int(self.stride[k]) * int(self.stride[k]), k) for k, a in owners[j])
        last, rows = len(ids) - 1, set()
        for s, k in found:
            e, step, n = int(self.unit_edits[k]), int(self.stride[k]), int(self.lengths[k])
            rows.update((min(max(0, s + d), last), n) for d in range(-e, e + 1, step))
        got = np.array(sorted(rows), np.int64).reshape(-1, 2)
        return got[:, 0], got[:, 1]

    def matches(self, words: list[bytes], first: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, start, end, found) in words, the nearest for each item, of one document; ``first``: one item is enough."""
        ids = np.array([self.vocabulary.get(w, _OTHER) for w in words], np.int32)
        if not len(ids) or not self.items:
            return []
        starts, lengths = self.places(ids)
        near: dict[int, set[int]] = {}  # starts that the items would have
        around: dict[int, int] = {}  # how far a window may stand from where its piece does
        for rows, keys in self.keys(ids, starts, lengths):
            at = starts[rows].tolist()
            for table, key in zip(self.tables, keys, strict=True):
                for i, x in enumerate(key.tolist()):
                    for u in table.get(x, ()):
                        k, offset, _ = self.units[u]
                        near.setdefault(k, set()).add(at[i] - offset)
                        around[k] = max(around.get(k, 0), int(self.unit_edits[u] + self.stride[u]))
        out = []
        for k, places in sorted(near.items()):
            n, e = len(self.items[k][1]), self.edits[k]
            slack = e + 1 + n // 512 + around[k]
            best, count, reach = None, 0, -1
            for s in sorted(places):
                if s + slack < reach:
                    continue
                lo, hi = max(0, s - slack), min(len(ids), s + n + e + slack)
                hit = edit_within(self.items[k][1], ids[lo:hi], e)
                if hit:
                    count, reach = count + 1, lo + hit[2]
                    if best is None or (hit[0], lo + hit[1]) < best[:2]:
                        best = (hit[0], lo + hit[1], lo + hit[2])
            if best:
                out.append((self.items[k][0], *best, count))
                if first:
                    break
        return sorted(out)


def _roll(ids: np.ndarray, size: int) -> np.ndarray:
    """A code of every run of ``size`` ids."""
    n = len(ids) - size + 1
    code = np.zeros(n, np.uint64)
    for k in range(size):
        code = code * np.uint64(0x100000001B3) + _mix(ids[k : k + n], 17)
    return code


def build(items: list[tuple[int, str | None]], ratio: float = 0.15, recall: float = 0.999, bits: int = 4, seed: int = 11) -> Index:
    """An index of (item id, text); items without a word, null texts and null ids can't be found.

    Words are numbered, so different words never count as equal.
    """
    number: dict[bytes, int] = {}
    rows = []
    for i, t in items:
        words = words_of((t or "").encode())
        if i is not None and words:
            rows.append((i, np.array([number.setdefault(w, len(number) + 2) for w in words], np.int32)))
    return Index(rows, number, ratio, recall, bits, seed)


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int, words: int = 2_000_000):
    """Lists of at most ``block`` items and about ``words`` words, so that neither the driver nor a task holds more at once."""
    held, size = [], 0
    for r in items.select(id_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") // 4
        if len(held) == block or size >= words:
            yield held
            held, size = [], 0
    if held:
        yield held


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = 20_000, **options) -> DataFrame:
    """(doc_id, item_id, distance, start, end, found): the nearest passage for each document and item it holds.

    distance: word edits, at most ``ratio`` of the item's words; start and end count the
    document's words; found: how many separate passages.  Documents without any have no
    row.  Null texts hold nothing.  Ids may be null or repeat; an item id that repeats has
    a row for each.  Items of any number of words, one or thousands, are searched; those
    shorter than 1 / ``ratio`` words must stand there unchanged.  Items go to the tasks in
    blocks of ``block``: one pass for each.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, distance int, start int, end int, found int"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for part in _blocks(items, item_col, item_text, block):
        sent = spark.sparkContext.broadcast(build(part, **options))

        def run(batches, sent=sent):
            index = sent.value
            for b in batches:
                docs_, hits = [], []
                for i, t in enumerate(b.column(1)):
                    got = index.matches(words_of(t.as_py() or b""))
                    docs_ += [i] * len(got)
                    hits += got
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(docs_, pa.int64())), *[pa.array([h[j] for h in hits], k) for j, k in enumerate(kinds)]], ["doc_id", "item_id", "distance", "start", "end", "found"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = 20_000, **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage of an item, with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for part in _blocks(items, item_col, item_text, block):
        sent = spark.sparkContext.broadcast(build(part, **options))

        def run(batches, sent=sent):
            index = sent.value
            for b in batches:
                yield b.filter(pa.array([not index.matches(words_of(t.as_py() or b""), first=True) for t in b.column(at).cast(pa.binary())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
