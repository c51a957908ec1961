"""Fill-in-middle transformation by displacement scatter.

A text is cut twice between units (runs of letters, or single other characters) and its
prefix, suffix and middle are written in another order between sentinels.  All texts of a
slice are one array of bytes: a scan finds the cuts, a difference array gives the step of
the output shift where each part begins, its cumulative sum is every byte's shift, and one
scatter writes all outputs.  Restoring finds the sentinels, builds the same differences
from them and gathers the bytes back.

Which cuts and which form a text gets depends on its id alone (SHA-256 of salt and id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import texts_by_bytes

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARK = {k: np.frombuffer(m.encode(), np.uint8) for k, m in (("P", PREFIX), ("S", SUFFIX), ("M", MIDDLE))}
#: The order of the parts in each form.
ORDER = {"psm": "PSM", "spm": "SPM"}
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def shifts(starts: np.ndarray, sizes: np.ndarray, targets: np.ndarray, room: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, the target place of each byte from there) for parts that follow one another, ``room`` bytes at a time.

    ``starts`` ascend, and a part of no bytes shares its start with the next.  The steps of
    the shift stand in a difference array at the starts; sums over it carry on from block
    to block.
    """
    total = int(starts[-1] + sizes[-1]) if len(starts) else 0
    step = np.diff(targets - starts, prepend=0)
    carry = 0
    for low in range(0, total, room):
        n = min(room, total - low)
        difference = np.zeros(n, np.int64)
        i, j = np.searchsorted(starts, [low, low + n])
        np.add.at(difference, starts[i:j] - low, step[i:j])
        difference[0] += carry
        shift = np.cumsum(difference)
        carry = int(shift[-1])
        yield low, shift + np.arange(low, low + n)


def cut_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the bytes at which units start, index of each text's first one and, last, their number)."""
    letter = _LETTER[data]
    start = (data & 0xC0) != 0x80
    inner = letter[1:] & letter[:-1]
    start[1:] &= ~inner
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    places = np.flatnonzero(start)
    return places, np.searchsorted(places, offsets)


def code_points(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code points of stretches of bytes."""
    out = np.zeros(len(starts), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        # Stretches and the gaps between them, summed at once.
        edges = np.column_stack((starts[some], starts[some] + sizes[some])).ravel()
        lead = np.append((data & 0xC0) != 0x80, False)
        out[some] = np.add.reduceat(lead, edges, dtype=np.int64)[::2]
    return out


def _parts(begin: np.ndarray, one: np.ndarray, two: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of three parts a text, a row for each text."""
    return np.column_stack((begin, one, two)), np.column_stack((one - begin, two - one, end - two))


def scatter(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all outputs.  ``first`` and ``second``: where each text's middle begins and ends; ``form``: 0 plain, 1 psm, 2 spm."""
    begin, end = offsets[:-1], offsets[1:]
    ends = np.concatenate(([0], np.cumsum(end - begin + 9 * (form > 0))))
    at = ends[:-1]
    starts, sizes = _parts(begin, first, second, end)
    p, m, s = sizes.T
    psm = np.column_stack((at + 3, at + p + s + 9, at + p + 6))
    spm = np.column_stack((at + s + 6, at + s + p + 9, at + 3))
    plain = np.column_stack((at, at + p, at + p + m))
    targets = np.where((form == 1)[:, None], psm, np.where((form == 2)[:, None], spm, plain))
    out = np.empty(int(ends[-1]), np.uint8)
    for low, to in shifts(starts.ravel(), sizes.ravel(), targets.ravel()):
        out[to] = data[low : low + len(to)]
    for k, part in (("P", 0), ("M", 1), ("S", 2)):
        marked = targets[form > 0, part] - 3
        for i in range(3):
            out[marked + i] = _MARK[k][i]
    return out, ends


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that outputs were made of, from outputs and forms alone.

    An output that isn't plain holds each mark once, in the form's order; else ValueError.
    """
    begin, end = offsets[:-1], offsets[1:]
    marks = {}
    opened = np.flatnonzero((data[:-2] == 0x3C) & (data[2:] == 0x3E)) if len(data) > 2 else np.empty(0, np.int64)
    owner = np.searchsorted(offsets, opened, side="right") - 1
    inside = (opened + 3 <= end[owner]) & (form[owner] > 0) if len(opened) else np.empty(0, bool)
    opened, owner = opened[inside], owner[inside]
    made = np.flatnonzero(form > 0)
    for k in "PSM":
        mine = data[opened + 1] == ord(k)
        if not np.array_equal(owner[mine], made):
            raise ValueError("an output doesn't hold each mark once")
        marks[k] = np.zeros(len(form), np.int64)
        marks[k][made] = opened[mine]
    back = np.flatnonzero(form == 2)
    turned = np.isin(np.arange(len(form)), back)
    lead, middle = np.where(turned, marks["S"], marks["P"]), marks["M"]
    inner = np.where(turned, marks["P"], marks["S"])
    if np.any((lead[made] != begin[made]) | (inner[made] < lead[made]) | (middle[made] < inner[made])):
        raise ValueError("an output has its marks in another order than its form")
    # Where prefix, middle and suffix begin and how long they are, in the outputs.
    plain = form == 0
    size_one, size_two, size_three = inner - lead - 3, middle - inner - 3, end - middle - 3
    prefix = np.where(plain, begin, np.where(turned, inner + 3, lead + 3))
    suffix = np.where(turned, lead + 3, inner + 3)
    p = np.where(plain, end - begin, np.where(turned, size_two, size_one))
    s = np.where(plain, 0, np.where(turned, size_one, size_two))
    m = np.where(plain, 0, size_three)
    sources = np.column_stack((prefix, np.where(plain, end, middle + 3), np.where(plain, end, suffix)))
    ends = np.concatenate(([0], np.cumsum(p + m + s)))
    starts, sizes = _parts(ends[:-1], ends[:-1] + p, ends[:-1] + p + m, ends[1:])
    out = np.empty(int(ends[-1]), np.uint8)
    for low, source in shifts(starts.ravel(), sizes.ravel(), sources.ravel()):
        out[low : low + len(source)] = data[source]
    return out, ends


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets, from 0, of a text column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None else np.empty(0, np.uint8)
    return data, ends - ends[0]


def _text_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def draws(id_col: Column, salt: str = "1") -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first digits of SHA-256 of ``salt:id`` (null id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 90, turned: int = 20, salt: str = "1", slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    n: units of the text; form: ``psm`` or, for ``turned`` of a hundred ids, ``spm``;
    ``plain`` (the text as it is, chars null) for empty texts, those that hold a mark, and
    all but ``rate`` of a hundred ids.  Parts may be empty.  Null texts are empty.  Ids may
    be null (all such texts are cut by the same numbers), repeat, or be of any type.  No
    rows are exchanged; a task holds ``slice_bytes`` of texts, or one longer text, at a time.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), salt), 1)])
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), 0).when(F.col("h4") % 100 < turned, 2).otherwise(1)
    rows = rows.select("doc_id", "text", "h1", "h2", form.cast("int").alias("form"))
    names = pa.array(["plain", "psm", "spm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts_by_bytes(batches, 1, slice_bytes):
            (data, offsets), form = _bytes_of(b.column(1)), b.column(4).to_numpy().astype(np.int64)
            places, of = cut_places(data, offsets)
            n = np.diff(of)
            cuts = np.sort(np.column_stack([b.column(k).to_numpy() % (n + 1) for k in (2, 3)]), axis=1)
            byte = np.append(places, len(data))
            one, two = (np.where(cuts[:, k] < n, byte[np.minimum(of[:-1] + cuts[:, k], len(places))], offsets[1:]) for k in (0, 1))
            out, ends = scatter(data, offsets, one, two, form)
            chars = [pa.array(code_points(data, a, z - a), mask=form == 0) for a, z in ((offsets[:-1], one), (one, two))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), names.take(pa.array(form)), *chars, _text_column(out, ends)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(made: DataFrame, output: str = "output", form: str = "form", slice_bytes: int = 4 << 20) -> DataFrame:
    """``made`` with ``restored``: the texts rebuilt from output and form alone.

    Outputs that don't fit their form end the query.  Null outputs count as empty plain ones.
    """
    clash = {"restored", "__text", "__form"} & set(made.columns)
    if clash:
        raise ValueError(f"columns are there already: {sorted(clash)}")
    names = made.columns
    code = F.when(F.col(output).isNull() | (F.col(form) == "plain"), 0).when(F.col(form) == "psm", 1).when(F.col(form) == "spm", 2)
    checked = F.coalesce(code, F.raise_error(F.concat(F.lit("no such form: "), F.coalesce(form, F.lit("null")))).cast("int"))
    rows = made.select(*names, F.coalesce(F.col(output), F.lit("")).alias("__text"), checked.alias("__form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts_by_bytes(batches, len(names), slice_bytes):
            data, offsets = _bytes_of(b.column(len(names)))
            out, ends = gather(data, offsets, b.column(len(names) + 1).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], _text_column(out, ends)], [*names, "restored"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return rows.mapInArrow(run, f"{schema}, restored string")
