"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints come from word shingles.  Distinct fingerprints are dealt to *cells* by the
population counts of equal parts of the fingerprint, cells are cut into tiles of bounded
size, and only tiles of cells whose counts differ by no more than the radius are compared,
by numpy exclusive-or and bit counts.  No link is lost: the sum over the parts of the
differences of population counts never exceeds the Hamming distance.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace, salted_left_join
from .components import components


def shingle_hashes(text: bytes, k: int, seed: int) -> np.ndarray:
    """XXH64 of every k-word shingle (A-Z lower-cased, repeats kept); fewer words: one shingle; none: empty."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    cut = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    starts = np.concatenate(([0], cut[: len(words) - k] + 1)).tolist()
    ends = np.concatenate((cut[k - 1 :], [len(line)])).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts, ends)), itertools.repeat(seed)), np.uint64, len(starts))


def fingerprint(h: np.ndarray, words: int = 1) -> bytes:
    """64 * ``words`` bits, big-endian by 64-bit word: a bit is 1 if set in over half of the hashes.

    Further words are made from the same hashes by odd multiplication and a shift-xor.
    """
    out = []
    for j in range(words):
        x = h if not j else (h ^ (h >> np.uint64(31 - j))) * np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1) + 2 * j) % 2**64 | 1)
        ones = np.zeros(64, np.int64)
        for a in range(0, len(x), 1 << 14):
            part = x[a : a + (1 << 14)]
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
        out.append(np.packbits(ones * 2 > len(x)).tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """(id, fp binary, n_shingles), a row for each row of ``docs``; null text counts as empty (fingerprint zero)."""

    def run(batches):
        for b in batches:
            fps, sizes = [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py() or b"", k, seed)
                fps.append(fingerprint(h, words))
                sizes.append(len(h))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["id", "fp", "n_shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp binary, n_shingles long")


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, least node of its tree) that connect what the pairs (a, b) connect."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, t) for x in list(up) if (t := top(x)) != x]


def _renamed(tops: np.ndarray, forest: list[tuple[int, int]]) -> np.ndarray:
    """``tops``, each that has a link in ``forest`` replaced by what it is linked to."""
    old, new = np.array(sorted(forest), np.int64).T
    at = np.minimum(np.searchsorted(old, tops), len(old) - 1)
    return np.where(old[at] == tops, new[at], tops)


def near_pairs(x: np.ndarray, y: np.ndarray, radius: int, lead: tuple[int, int] | None = None, block: int = 512):
    """Index arrays of the rows of x and y (n, words of uint64) that differ in at most ``radius`` bits, block by block.

    ``lead`` (words, bits): pairs that differ in more than so many bits of the first so
    many words count as far, and only the others have their other words compared.
    """
    head, most = lead or (x.shape[1], radius)
    for i in range(0, len(x), block):
        for j in range(0, len(y), 4 * block):
            p, q = x[i : i + block], y[j : j + 4 * block]
            far = np.bitwise_count(p[:, None, 0] ^ q[None, :, 0]).astype(np.uint16)
            for w in range(1, head):
                far += np.bitwise_count(p[:, None, w] ^ q[None, :, w])
            r, c = np.nonzero(far <= most)
            for a in range(0, len(r), 1 << 16):
                s, d = r[a : a + (1 << 16)], c[a : a + (1 << 16)]
                if head < x.shape[1]:
                    near = far[s, d] + np.bitwise_count(p[s, head:] ^ q[d, head:]).sum(axis=1, dtype=np.uint16) <= radius
                    s, d = s[near], d[near]
                if len(s):
                    yield s + i, d + j


def _offsets(parts: int, radius: int) -> list[list[int]]:
    """Half of the integer vectors of L1 norm up to ``radius`` (zero, and one of v and -v)."""
    span = range(-radius, radius + 1)
    return [list(v) for v in itertools.product(span, repeat=parts) if sum(map(abs, v)) <= radius and v >= (0,) * parts]


def links(classes: DataFrame, work: Workspace, radius: int, words: int = 1, parts: int = 4, ratio: float | None = None, tile: int = 4096, lead: tuple[int, int] | None = None) -> DataFrame:
    """Links (a, b) between classes (rep long, fp binary, n long) within ``radius`` bits, as spanning forests.

    A tile pair returns links that connect exactly what its near pairs connect, so dense
    groups never give a row per pair.  ``parts`` equal parts have their population counts
    in the cell; 0 takes none, for a radius that counts cannot prune.  ``ratio``: cells
    also hold the logarithm of n to that base, and sizes further apart than the ratio
    aren't compared.  A cell with more than ``tile`` classes is cut by hash into tiles of
    about that size (``lead`` as in ``near_pairs``); the tile pairs of one cell pair are dealt to about as many tasks as the
    root of its tiles, so that no cell stays in one task, and each tile is copied as many times and not to every other tile.
    """
    bits = 64 * words
    cell = []
    if parts:
        size = bits // parts // 8
        cell += [F.bit_count(F.conv(F.hex(F.substring("fp", 1 + p * size, size)), 16, 10).cast("decimal(20,0)").cast("long")) if size < 8 else sum(F.bit_count(F.conv(F.hex(F.substring("fp", 1 + p * size + q, 4)), 16, 10).cast("long")) for q in range(0, size, 4)) for p in range(parts)]
    if ratio:
        cell += [F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / math.log(ratio)).cast("int")]
    offsets = _offsets(parts, radius) if parts else [[]]
    if ratio:
        offsets = [[*v, s] for v in offsets for s in (-1, 0, 1) if (*v, s) >= (0,) * (parts + 1)]
    rows = classes.select("rep", "fp", "n", F.array(*[c.cast("int") for c in cell]).alias("cell"))
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    # Cells are few whatever the input: (bits / parts + 1) ** parts, times the sizes' logarithms.
    dealt = rows.join(F.broadcast(work.save(counts, "cells")), "cell").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    tiles = work.save(dealt.groupBy("cell", "tile", "tiles").agg(F.collect_list("rep").alias("reps"), F.collect_list("fp").alias("fps"), F.collect_list("n").alias("ns")), "tiles")
    left = tiles.select(F.col("cell").alias("home"), F.col("tile").alias("tile_a"), "reps", "fps", "ns", F.explode(F.array(*[F.array(*[F.lit(int(x)) for x in v]) for v in offsets])).alias("step"))
    left = left.select("home", "tile_a", F.col("reps").alias("reps_a"), F.col("fps").alias("fps_a"), F.col("ns").alias("ns_a"), F.zip_with("home", "step", lambda h, s: h + s).alias("cell"))
    # A left tile goes once to each block of right tiles, and meets those of the block there.
    block = lambda tile: F.floor(tile / F.floor(F.sqrt("tiles"))).cast("int")
    left = left.join(F.broadcast(work.spark.read.parquet(f"{work.root}/cells")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), block(F.col("tiles") - 1)))).drop("tiles")
    pairs = left.join(tiles.withColumn("block", block(F.col("tile"))).drop("tiles"), ["cell", "block"]).where((F.col("home") != F.col("cell")) | (F.col("tile_a") <= F.col("tile")))

    def run(batches):
        for b in batches:
            got: list[tuple[int, int]] = []
            for row in range(b.num_rows):
                rep_a, rep_b = (np.array(b.column(c)[row].as_py(), np.int64) for c in (0, 3))
                x, y = (np.frombuffer(b"".join(b.column(c)[row].as_py()), ">u8").astype(np.uint64).reshape(-1, words) for c in (1, 4))
                n_a, n_b = (np.array(b.column(c)[row].as_py(), np.float64) for c in (2, 5))
                top_a, top_b = rep_a, rep_b
                for r, s in near_pairs(x, y, radius, lead):
                    if ratio:
                        keep = np.maximum(n_a[r], n_b[s]) <= ratio * np.minimum(n_a[r], n_b[s])
                        r, s = r[keep], s[keep]
                    # The first pair of each row, then those whose trees these leave apart: few in a dense group.
                    for part in (np.flatnonzero(np.diff(r, prepend=-1)), slice(None)):
                        p, q = top_a[r[part]], top_b[s[part]]
                        if (p != q).any():
                            f = _forest(p[p != q], q[p != q])
                            got += f
                            top_a, top_b = _renamed(top_a, f), _renamed(top_b, f)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([q for _, q in got], pa.int64())], ["a", "b"])

    return pairs.select("reps_a", "fps_a", "ns_a", "reps", "fps", "ns").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, seed: int = 42, words: int = 1, radius: int = 2, parts: int = 4, ratio: float | None = None, tile: int = 4096, lead: tuple[int, int] | None = None) -> DataFrame:
    """(id, fp, n_shingles, component_id), a row for each row of ``docs`` whose id isn't null.

    component_id: the least id reachable over links of at most ``radius`` bits, itself
    included.  Null and empty texts have the fingerprint zero and link like any other.
    Rows with a null id are no documents here and are left out; repeated ids keep a row
    each and the component of their fingerprint.  Other columns of ``docs`` are ignored.
    An empty table gives an empty table.
    """
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.save(fingerprints(docs, id_col, text_col, k, seed, words).where("id is not null"), "fingerprints")
    size = F.col("n_shingles") if ratio else F.lit(0).cast("long")
    keyed = fps.withColumn("n", size)
    classes = work.save(keyed.groupBy("fp", "n").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "classes")
    near = work.save(links(classes.select("rep", "fp", "n"), work, radius, words, parts, ratio, tile, lead), "links")
    found = components(near, work)
    named = classes.join(found, classes["rep"] == found["node"], "left").where("members > 1 or component is not null").select("fp", "n", F.coalesce("component", "rep").alias("component"))
    out = salted_left_join(keyed, work.save(named, "named"), ["fp", "n"], ["id"])
    return out.select("id", "fp", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def radius_for(similarity: float, bits: int, slack: float = 1.0) -> int:
    """Bits by which two texts of that Jaccard similarity of shingles differ, plus ``slack`` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def flip_rate(similarity: Fraction) -> float:
    """The greatest chance that a bit differs between the fingerprints of two sets of at least that Jaccard similarity.

    Each hash sets a bit by a fair coin.  Sets of few hashes are taken size by size, as
    they differ from the limit of large ones, of which the arc cosine is the rate.
    """
    num, den = similarity.numerator, similarity.denominator

    def chances(m):
        return np.array([math.comb(m, y) / 2**m for y in range(m + 1)])

    def over(m, shared):
        tail = np.append(np.cumsum(chances(m - shared)[::-1])[::-1], 0)
        return tail[np.clip(m // 2 + 1 - np.arange(shared + 1), 0, m - shared + 1)]

    most = math.acos(min(1, 2 * similarity / (1 + similarity))) / math.pi
    for a in range(1, 8 * math.ceil(1 / (1 - similarity)) + 1 if similarity < 1 else 1):
        for b in range(a, a * den // num + 1):
            for shared in range(-(-num * (a + b) // (num + den)), a + 1):
                p, q = over(a, shared), over(b, shared)
                most = max(most, float(chances(shared) @ (p * (1 - q) + q * (1 - p))))
    return most


def radius_within(rate: float, bits: int, lost: float) -> int:
    """The least number of bits that more differ with a chance of at most ``lost``, if each differs with the chance ``rate``."""
    if rate <= 0:
        return 0
    k = np.arange(bits + 1)
    log = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in k.tolist()])
    beyond = np.cumsum(np.exp(log + k * math.log(rate) + (bits - k) * math.log(1 - rate))[::-1])[::-1]
    return int(np.argmax(np.append(beyond[1:], 0) <= lost))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less all but one document of each near-duplicate group; same columns.

    Groups are those of ``near_sets.near_groups``: fingerprints of the distinct five-word
    shingles find the pairs, whose exact Jaccard similarity then decides.  The document with the least id of a group stays.
    Rows with a null id stay.  Of rows that repeat an id, those of the least id of a group
    stay.
    """
    from .near_sets import near_groups

    groups = near_groups(docs, id_col, text_col, k=5, similarity=similarity)
    gone = groups.where("component_id <> id").select("id").distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["id"], "left_anti")
