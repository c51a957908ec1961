"""Near-duplicate groups by SimHash, each pair confirmed by the exact Jaccard similarity of sets of word shingles.

Pairs are searched by 1024-bit SimHash fingerprints of the sets, which ``simhash.links``
compares by exclusive-or and bit counts in tiles.  The radius is so wide that a pair at or
above the similarity is beyond it with a chance of at most ``LOST``, for sets of any size.
Within what those links connect, the sets themselves are compared in tiles, so that no
pair below the similarity is joined (up to equal 64-bit hashes).  Before the search, sets
with more shingles that stand in no other set than near sets can differ in are passed
over, which loses none.  Only texts of the sets left are shuffled.  Tables that no later
step reads are deleted at once.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace, lookup, salted_left_join, texts_by_bytes
from .components import components
from .simhash import _forest, fingerprint, flip_rate, links, radius_within, shingle_hashes

#: 64-bit words of a fingerprint, and those by which most pairs are told apart.
WORDS, LEAD = 16, 4
#: The chance that a pair right at the similarity is missed by either of the two radii.
LOST = 1e-12
#: Bytes of texts whose sets a task holds at once.
SLICE = 4 << 20
#: Sampled hashes of a bucket; a task deals out half as many at once.
HASHES = 1 << 19
#: Sets that a task deals out at once, at most; a place among them takes two bytes.
PLACES = 1 << 16
#: Bits of the filter of wanted ids: for each id, and at most.
ID_BITS, MOST_BITS = 16, 1 << 25


def shingle_set(text: bytes, k: int, seed: int) -> tuple[int, np.ndarray]:
    """(a 64-bit name of the set, its distinct shingle hashes in order)."""
    h = np.unique(shingle_hashes(text, k, seed)).view(np.int64)
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63), h


def _sampled(h: np.ndarray) -> np.ndarray:
    """Three in eight of all hashes, the same of every set."""
    return h[(h & 7) < 3]


def _repeated(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each of the pairs (h, d): whether some pair has the same h and another d."""
    if not len(h):
        return np.empty(0, bool)
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    first = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
    last = np.append(first[1:], len(h)) - 1
    out = np.empty(len(h), bool)
    out[order] = np.repeat(d[first] != d[last], last - first + 1)
    return out


def shared_hashes(sets: DataFrame, total: int, most: int = HASHES) -> DataFrame:
    """(d, shared): how many hashes of each set stand in another set too; empty sets are left out.

    ``sets`` (d, some array<long>): rows of one d have one array.  Tasks take them in chunks,
    whose hashes go as packed arrays to buckets of about ``most``, ``total`` being their number.
    Of a hash that several sets of a chunk hold, two stand for all, and the others are counted
    there, so that no hash, however frequent, fills its bucket.  A bucket answers each chunk
    once, with the packed places of the sets and how many hashes of each it found shared, and
    the chunk adds them up: a row for each set of a chunk, however many buckets there are.  A bucket tells its
    hashes apart by 32 bits; two that agree in those count as shared, which passes over fewer sets.
    """
    bits = max(1, (max(total, 1) // most).bit_length())

    def cells(chunk, held):
        d, place = np.fromiter(held, np.int64, len(held)), np.repeat(np.arange(len(held)).astype(np.uint16), [len(h) for h in held.values()])
        h = np.concatenate(list(held.values())).view(np.uint64)
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        inner = np.zeros(len(h), bool)
        inner[1:-1] = (h[1:-1] == h[:-2]) & (h[1:-1] == h[2:])
        counts = np.bincount(place[inner], minlength=len(d))
        h, place = h[~inner], place[~inner]
        low = (h >> np.uint64(3)).astype(np.uint32)  # the last three bits chose the sample
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
        order = np.lexsort((place, bucket))
        low, bucket, place = low[order], bucket[order], place[order]
        # A bucket's hashes of one set stand together, and the set is named once for them.
        first = np.flatnonzero(np.diff(bucket << 16 | place, prepend=-1))
        each, place = np.diff(np.append(first, len(low))).astype(np.uint32), place[first]
        keep = np.unique(bucket)
        cuts = [np.append(np.searchsorted(b, keep), len(b)) for b in (bucket, bucket[first])]
        columns = [[x[lo:hi].tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)] for x, cut in ((low, cuts[0]), (d[place], cuts[1]), (place, cuts[1]), (each, cuts[1]))]
        # What the chunk itself needs goes by one of its buckets, any one.
        via = int(d[0]) % len(keep)
        columns += [[x.tobytes() if b == via else b"" for b in range(len(keep))] for x in (d, counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([chunk] * len(keep), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "chunk", "hashes", "owners", "places", "each", "names", "counts"])

    def deal(batches):
        chunk, held, n = TaskContext.get().partitionId() << 32, {}, 0
        for b in batches:
            ends, flat = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
            for i, d in enumerate(b.column(0).to_pylist()):
                if d not in held and ends[i] < ends[i + 1]:
                    held[d] = flat[ends[i] : ends[i + 1]].copy()
                    n += len(held[d])
                if n >= most // 2 or len(held) == PLACES:
                    yield cells(chunk, held)
                    chunk, held, n = chunk + 1, {}, 0
        if held:
            yield cells(chunk, held)

    def unpack(table, **kinds):
        return [np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in kinds.items()]

    def count(table: pa.Table) -> pa.Table:
        h, d, place, each = unpack(table, hashes=np.uint32, owners=np.int64, places=np.uint16, each=np.uint32)
        shared = np.add.reduceat(_repeated(h, np.repeat(d, each)), np.cumsum(each, dtype=np.int64) - each, dtype=np.uint32)
        ends = np.cumsum([len(x) // 2 for x in table.column("places").to_pylist()])[:-1]
        rows = [(p[n > 0].tobytes(), n[n > 0].tobytes()) for p, n in zip(np.split(place, ends), np.split(shared, ends), strict=True)]
        found = table.select(["chunk", "names", "counts"])
        for i, name in enumerate(("places", "each")):
            found = found.append_column(name, pa.array([r[i] for r in rows], pa.binary()))
        return found

    def add(table: pa.Table) -> pa.Table:
        d, counts, place, each = unpack(table, names=np.int64, counts=np.int64, places=np.uint16, each=np.uint32)
        return pa.table({"d": d, "shared": counts + np.bincount(place, each, len(d)).astype(np.int64)})

    dealt = sets.select("d", "some").mapInArrow(deal, "bucket int, chunk long, hashes binary, owners binary, places binary, each binary, names binary, counts binary")
    found = dealt.groupBy("bucket").applyInArrow(count, "chunk long, names binary, counts binary, places binary, each binary")
    # Every chunk that a set stands in counts the same for it.
    return found.groupBy("chunk").applyInArrow(add, "d long, shared long").groupBy("d").agg(F.max("shared").alias("shared"))


def maybe_among(rows: DataFrame, wanted: DataFrame, id_col: str) -> DataFrame:
    """``rows`` (id, text) whose id may be among the ids of ``wanted``: all that are, and few others.

    A bit for each hashed id decides.  The bits go to all tasks as a table of at most half
    a million words; with over some ten million wanted ids more and more others stay.
    """
    bits = min(MOST_BITS, 1 << max(6, (ID_BITS * wanted.count()).bit_length()))
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    bit = lambda c: F.pmod(at(c), F.lit(64)).cast("int")
    words = wanted.select(F.shiftright(at(id_col), 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(id_col)).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    found = rows.withColumn("word", F.shiftright(at("id"), 6)).join(F.broadcast(words), "word")
    return found.where(F.call_function("shiftleft", F.lit(1).cast("long"), bit("id")).bitwiseAND(F.col("mask")) != 0).select("id", "text")


def near_links(sets: list[np.ndarray], first: int, similarity: Fraction, roots: np.ndarray) -> list[tuple[int, int]]:
    """Links between roots that connect what the pairs of a similarity of at least ``similarity`` connect.

    ``roots``: a name for each set; sets of one name count as connected already.
    ``first``: only pairs of one of the first so many sets and one of the others are
    compared; 0: all pairs.  A set is passed over once its root is linked to every root
    on the other side, so that a dense group costs little more than its size.
    """
    num, den = similarity.numerator, similarity.denominator
    n = np.array([len(s) for s in sets], np.int64)
    flat, of = np.concatenate(sets) if sets else np.empty(0, np.int64), np.repeat(np.arange(len(sets)), n)
    code = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owners, ends = of[order], np.cumsum(np.bincount(code))
    starts, at = np.concatenate(([0], ends[:-1])), np.concatenate(([0], np.cumsum(n)))
    names, group = np.unique(roots, return_inverse=True)
    # apart[g, h]: roots g and h aren't linked yet.
    apart = ~np.eye(len(names), dtype=bool) if first else None
    wanted = np.zeros(len(names), bool)
    wanted[group[first:]] = True
    a, b = [], []
    for i in range(first or len(sets)):
        if first and not apart[group[i], wanted].any():
            continue
        lists = [owners[starts[c] : ends[c]] for c in code[at[i] : at[i + 1]].tolist()]
        if not lists:
            continue
        both = np.bincount(np.concatenate(lists), minlength=len(sets))
        both[: first or i + 1] = 0
        j = np.flatnonzero(both)
        if first:
            j = j[apart[group[i], group[j]]]
        j = j[both[j] * den >= num * (n[i] + n[j] - both[j])]
        if first:
            apart[group[i], group[j]] = False
        g = np.unique(group[j])
        a.append(np.full(len(g), roots[i]))
        b.append(names[g])
    return _forest(np.concatenate(a), np.concatenate(b)) if a else []


def _arrays(b: pa.RecordBatch, row: int, reps: int, sets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Names and sets of one tile, the sets as views of the batch's own buffer."""
    names, lists = b.column(reps)[row].values, b.column(sets)[row].values
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    return names.to_numpy(), [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def _inside(tiles: DataFrame, similarity: Fraction) -> DataFrame:
    """``tiles`` (component, tile, tiles, reps, sets) with ``roots``: for each set the least set that its own tile connects it to."""

    def run(batches):
        for b in batches:
            found = []
            for row in range(b.num_rows):
                names, sets = _arrays(b, row, 3, 4)
                up = dict(near_links(sets, 0, similarity, names))
                found.append([up.get(x, x) for x in names.tolist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, "roots"])

    return tiles.mapInArrow(run, "component long, tile int, tiles int, reps array<long>, sets array<array<long>>, roots array<long>")


def _across(pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (a, b) between the roots of two tiles, of rows (sets, roots, sets, roots)."""

    def run(batches):
        for b in batches:
            got = []
            for row in range(b.num_rows):
                roots_a, sets_a = _arrays(b, row, 1, 0)
                roots_b, sets_b = _arrays(b, row, 3, 2)
                got += near_links(sets_a + sets_b, len(sets_a), similarity, np.concatenate((roots_a, roots_b)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int64()), pa.array([q for _, q in got], pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, seed: int = 42, tile_sets: int = 512, tile_hashes: int = 1 << 18, tile_prints: int = 2048) -> DataFrame:
    """(id, component_id), a row for each row of ``docs`` whose id isn't null.

    component_id: the least id reachable over pairs of texts whose sets of distinct
    ``k``-word shingles have at least that Jaccard similarity, itself included.  Null
    texts, and texts without words, have the empty set and equal each other.  Texts of at
    most ``k`` words are one shingle.  Ids may repeat: rows of one id count as one
    document of several texts.  An empty table gives an empty table.
    """
    work, like = Workspace(docs.sparkSession, "near-sets"), Fraction(str(similarity))
    # How many shingles of a set can be missing from a set that near.
    spare = F.floor(F.col("n") * (like.denominator - like.numerator) / F.lit(like.denominator)).cast("long")

    def narrow(batches):
        for b in texts_by_bytes(batches, 1, SLICE):
            got = [shingle_set(t.as_py(), k, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d for d, _ in got], pa.int64()), pa.array([len(h) for _, h in got], pa.int64()), pa.array([_sampled(h) for _, h in got], pa.list_(pa.int64()))], ["id", "d", "n", "some"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")).where("id is not null")
    made = work.save(rows.mapInArrow(narrow, "id long, d long, n long, some array<long>"), "sets")
    named = work.save(made.select("id", "d"), "named")
    classes = work.save(made.groupBy("d").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max(F.size("some")).alias("sampled"), F.count("*").alias("members")), "classes")
    total = classes.agg(F.sum("sampled")).first()[0] or 0
    lone = F.col("sampled") - F.coalesce("shared", F.lit(0))
    left = work.save(classes.where("n > 0").join(shared_hashes(made, total), "d", "left").where(lone <= spare).select("d", "rep"), "left")
    work.drop("sets")

    def wide(batches):
        for b in texts_by_bytes(batches, 2, SLICE):
            got = [shingle_set(t.as_py(), k, seed) for t in b.column(2)]
            keep = [i for i, (d, _) in enumerate(got) if d == b.column(0)[i].as_py()]
            picked = pa.array(keep, pa.int64())
            sets = [got[i][1] for i in keep]
            prints = [fingerprint(h.view(np.uint64), WORDS) for h in sets]
            yield pa.RecordBatch.from_arrays([b.column(0).take(picked), b.column(1).take(picked), pa.array([len(h) for h in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["d", "rep", "n", "fp", "hashes"])

    near = maybe_among(rows, left, "rep")
    texts = left.join(near, left["rep"] == near["id"]).select("d", "rep", "text")
    made = texts.mapInArrow(wide, "d long, rep long, n long, fp binary, hashes array<long>")
    # Only where an id has one text several times does a set stand twice.
    if not named.groupBy("id", "d").count().where("count > 1").isEmpty():
        made = made.dropDuplicates(["d"])
    sets = work.save(made, "wide")
    rate, search = flip_rate(like), Workspace(docs.sparkSession, "near-sets-search")
    # Near sets' sizes are within that ratio; a little more, so that rounding loses none.
    ratio = max(float(1 / like), 1.05) * (1 + 1e-9)
    found = links(sets.select("rep", "fp", "n"), search, radius_within(rate, 64 * WORDS, LOST), WORDS, parts=0, ratio=ratio, tile=tile_prints, lead=(LEAD, radius_within(rate, 64 * LEAD, LOST)))
    near = components(search.save(found, "links"), search)

    # One row for each set: `near` is unique on its node.
    members = work.save(sets.join(near, sets["rep"] == near["node"]).select("component", "rep", "n", "hashes"), "members")
    search.clear()
    work.drop("wide")
    counts = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / F.lit(tile_sets)), F.ceil(F.sum("n") / F.lit(tile_hashes))).cast("int").alias("tiles")).where("tiles > 1")
    dealt = lookup(members, work.save(counts, "counts"), ["component"], ["rep"]).withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    held = F.collect_list(F.struct("rep", "hashes"))
    tiles = work.save(dealt.groupBy("component", "tile", "tiles").agg(held.alias("x")).select("component", "tile", "tiles", F.col("x.rep").alias("reps"), F.col("x.hashes").alias("sets")), "tiles")
    work.drop("members")
    tiles = work.save(_inside(tiles, like), "rooted")
    work.drop("tiles")
    inner = tiles.select(F.inline(F.arrays_zip(F.col("reps").alias("a"), F.col("roots").alias("b")))).where("a <> b")
    split = tiles.where("tiles > 1").select("component", "tile", "tiles", "sets", "roots")
    ahead = split.where("tile < tiles - 1").select("component", F.col("sets").alias("sets_a"), F.col("roots").alias("roots_a"), F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"))
    pairs = ahead.join(split.drop("tiles").hint("merge"), ["component", "tile"])
    cross = _across(pairs.select("sets_a", "roots_a", "sets", "roots"), like)
    near = work.save(inner.unionByName(cross), "links")
    work.drop("rooted")
    found = components(near, work)
    merged = classes.join(found, classes["rep"] == found["node"], "left").where("members > 1 or component is not null").select("d", F.coalesce("component", "rep").alias("component"))
    out = salted_left_join(named, work.save(merged, "merged"), ["d"], ["id"])
    return out.select("id", F.coalesce("component", "id").alias("component_id"))
