"""Periodic runs of words: recursive frequency splitting, then a lag scan of what is left.

A run of period q is a stretch of words in which words q apart are identical, at least
``least`` words and ``times`` periods long, that no neighbouring word extends.  Every word
of a run stands in it ``times`` times or more, so a word that stands less often in its
segment is in no run there and splits the segment.  Segments are split until none changes
(first segments: the texts) and those that survive are scanned lag by lag.

A task works on a slice of texts at a time, as flat arrays: words are numbered, segments
of all its texts are counted by one sort a round, and one scan serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import texts_by_bytes

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
#: (decimal ids, words of each text) -> first repeated word and period of each, 0 for none.
Rewrite = Callable[[list[str], np.ndarray], tuple[np.ndarray, np.ndarray]]


def split_segments(ids: np.ndarray, of: np.ndarray, times: int = 4, least: int = 6, rounds: int = 64) -> list[np.ndarray]:
    """Places, ascending, of the segments that may hold runs.

    ``ids``: word numbers; ``of``: the number of each word's text, ascending.  Words that
    stand fewer than ``times`` times in their segment split it, pieces of fewer than
    ``least`` words go, and pieces that lost words are counted again until none does.
    What is still losing words after ``rounds`` stays as it is: splitting only spares
    work, and the scan is exact on any segments.
    """
    at, seg, done = np.arange(len(ids)), of.astype(np.int64), []
    width = int(ids.max(initial=0)) + 1
    for _ in range(rounds):
        if not len(at):
            break
        # Repeats of a word in a segment: neighbours in the order of (segment, word).
        key = seg * width + ids[at]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.empty(len(at), np.int64)
        counts[order] = np.repeat(np.diff(np.append(first, len(at))), np.diff(np.append(first, len(at))))
        live = counts >= times
        lost = np.bincount(seg[~live], minlength=int(seg[-1]) + 1) > 0
        whole = ~lost[seg]
        done += _stretches(at[whole], seg[whole], least)
        at, seg = at[live & ~whole], seg[live & ~whole]
        if len(at):
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (seg[1:] != seg[:-1])))
            seg = np.cumsum(new) - 1
            long = np.bincount(seg)[seg] >= least
            at, seg = at[long], seg[long]
            if len(seg):
                seg = np.cumsum(np.concatenate(([True], seg[1:] != seg[:-1]))) - 1
    return done + _stretches(at, seg, least)


def _stretches(at: np.ndarray, seg: np.ndarray, least: int) -> list[np.ndarray]:
    cuts = np.flatnonzero(seg[1:] != seg[:-1]) + 1
    return [s for s in np.split(at, cuts) if len(s) >= least]


def _matching(x: np.ndarray, a: int, q: int, step: int) -> int:
    """How many places in a row from ``a`` on, forwards or backwards, have an equal word q places later."""
    n, block = 0, 32
    while True:
        if step > 0:
            lo, hi = a + n, min(a + n + block, len(x) - q)
            bad = np.flatnonzero(x[lo:hi] != x[lo + q : hi + q]) if lo < hi else []
            if len(bad):
                return n + int(bad[0])
            size = max(0, hi - lo)
        else:
            lo, hi = max(0, a - n - block + 1), a - n + 1
            bad = np.flatnonzero(x[lo:hi] != x[lo + q : hi + q]) if lo < hi else []
            if len(bad):
                return n + hi - lo - 1 - int(bad[-1])
            size = max(0, hi - lo)
        n += size
        if size < block:
            return n
        block *= 2


def scan_lags(x: np.ndarray, lengths: np.ndarray, times: int = 4, least: int = 6, room: int = 1 << 20) -> np.ndarray:
    """(start, length, period) rows of the runs of ``x``, by period and start.

    ``x``: word numbers of segments one after another, each followed by a number that
    stands nowhere else; ``lengths``: words of each segment.  A run of period q holds
    ``times`` multiples of q in a row, so at every lag only places a multiple of it apart
    are compared, and what agrees there is compared word by word.  Lags are taken an
    octave at a time, ``room`` places at once.  No period of an octave divides another, and
    two runs overlap by less than the sum of their periods: so a place that is well inside
    a run of an earlier octave is of that run or of none.
    """
    found = np.empty((0, 3), np.int64)  # start, end, period
    starts = np.cumsum(lengths + 1) - lengths - 1
    low, top = 1, int(lengths.max(initial=0)) // times
    while low <= top:
        # Lags of this octave concern only segments of so many words.
        keep = np.flatnonzero(lengths >= max(least, times * low))
        places = np.concatenate([np.arange(starts[k], starts[k] + lengths[k] + 1) for k in keep])
        base = x[places]
        known = found[found[:, 1] - found[:, 0] >= times * low]
        known = known[np.argsort(known[:, 0], kind="stable")]
        ends = np.maximum.accumulate(known[:, 1])
        anchors = np.arange((len(base) - 1) // low + 1)
        many = max(1, room // len(anchors))
        for first in range(low, min(top + 1, 2 * low), many):
            lags = np.arange(first, min(top + 1, 2 * low, first + many))
            at = lags[:, None] * anchors
            values = base[np.minimum(at, len(base) - 1)]
            same = (values[:, 1:] == values[:, :-1]) & (at[:, 1:] < len(base))
            width = same.shape[1] - (times - 2)
            if width <= 0:
                continue
            hit = same[:, :width].copy()
            for t in range(1, times - 1):
                hit &= same[:, t : width + t]
            row, k = np.nonzero(hit)
            q = lags[row]
            a = k * q
            # All of a .. a + (times - 1) q is in the run: a few places more are looked at.
            for t in (1, 1 / 3, 1 / 2, 5 / 4, times - 2 - 1 / 8):
                b = a + (np.minimum(1, q - 1) if t == 1 else (q * t).astype(np.int64))
                true = base[b] == base[b + q]
                q, a = q[true], a[true]
            if len(known) and len(a):
                i = np.searchsorted(known[:, 0], places[a], side="right") - 1
                inside = (i >= 0) & (places[a] + (times - 1) * q < ends[np.maximum(i, 0)])
                q, a = q[~inside], a[~inside]
            now, reach, new = 0, -1, []
            for lag, s in zip(q.tolist(), a.tolist(), strict=True):
                if lag != now:
                    now, reach = lag, -1
                if s < reach:
                    continue
                right, left = _matching(base, s, lag, 1), _matching(base, s - 1, lag, -1) if s else 0
                reach = s + right
                # What agreed by chance at some places only, as across two segments, ends sooner.
                if right > (times - 2) * lag and left + right + lag >= max(least, times * lag):
                    start = int(places[s - left])
                    new.append((start, start + left + right + lag, lag))
            found = np.concatenate((found, np.array(new, np.int64).reshape(-1, 3)))
        low *= 2
    return np.column_stack((found[:, 0], found[:, 1] - found[:, 0], found[:, 2]))


def runs_of(ids: np.ndarray, of: np.ndarray, times: int = 4, least: int = 6) -> np.ndarray:
    """(start, length, period) of all runs of texts that follow one another, by start and period."""
    kept = split_segments(ids, of, times, least)
    if not kept:
        return np.empty((0, 3), np.int64)
    lengths = np.array([len(s) for s in kept], np.int64)
    x = np.empty(int(lengths.sum()) + len(kept), np.int64)
    place = np.empty(len(x), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    x[ends], place[ends] = -1 - np.arange(len(kept)), -1
    words = np.ones(len(x), bool)
    words[ends] = False
    place[words] = np.concatenate(kept)
    x[words] = ids[place[words]]
    runs = scan_lags(x, lengths, times, least)
    runs[:, 0] = place[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _slice(keys: list[str], texts: pa.Array, times: int, least: int, rewrite: Rewrite | None) -> list[pa.Array]:
    """n_words, runs and collapsed texts of one slice of texts."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    docs = len(texts)
    of = np.repeat(np.arange(docs), np.diff(lists.offsets.to_numpy()))[full]
    flat = flat.filter(pa.array(full))
    n = np.bincount(of, minlength=docs)
    first = np.cumsum(n) - n
    coded = flat.dictionary_encode()
    ids, source = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), None
    if rewrite is not None:
        a, p = rewrite(keys, n)
        i = np.arange(len(ids)) - first[of]
        moved = (p[of] > 0) & (i >= a[of])
        source = np.arange(len(ids))
        source[moved] = (first[of] + a[of] + (i - a[of]) % np.maximum(p[of], 1))[moved]
        ids = ids[source]
    runs = runs_of(ids, of, times, least)
    # A place is dropped while any run covers it whose first period is over.
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    kept = coded.dictionary.take(pa.array(ids[keep]))
    left = np.bincount(of[keep], minlength=docs)
    ends = np.concatenate(([0], np.cumsum(left))).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), kept), " ")
    owner = of[runs[:, 0]] if len(runs) else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=docs)))).astype(np.int32)
    parts = [pa.array(runs[:, 0] - first[owner] if len(runs) else np.empty(0, np.int64)), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
    return [pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_RUN))), joined]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 4, least: int = 6, rewrite: Rewrite | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs``.

    runs: array of (start, length, period), all runs by start and period, in words from 0;
    a stretch is given once, by its smallest period.  collapsed: the words joined by one
    space, without those that a run covers after its first period.  Words are what ASCII
    white space separates.  Null and empty texts have no words, no runs and an empty
    collapsed text.  Ids may be null, repeat, or be of any type.

    ``rewrite`` may repeat a stretch of a text before it is read: from word a on, word i is
    word a + (i - a) % p.  No words are exchanged: each text is a row of one task, and a
    task holds ``slice_bytes`` of texts, or one longer text, at a time.
    """
    if times < 3 or least < times:
        raise ValueError("runs must be of three periods and ``times`` words at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts_by_bytes(batches, 2, slice_bytes):
            made = _slice(b.column(1).to_pylist(), b.column(2), times, least, rewrite)
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def longest(runs: str = "runs") -> Column:
    """The run of greatest length, then of least start, then of least period, as (length, start, period); null for none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), (-best["start"]).alias("start"), (-best["period"]).alias("period")))


def as_lines(runs: str = "runs") -> Column:
    """``start,length,period`` and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
