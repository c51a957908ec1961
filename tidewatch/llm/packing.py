"""Bounded-space online packing of token ids into fixed windows.

Each partition keeps at most ``open_windows`` windows open.  A document's whole windows
are closed at once and its remainder goes to the open window that it fits best; when none
fits and no more may be opened, the fullest is emitted.  What partitions leave open is
merged in rounds, groups of partitions at a time, until one group is left.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import Workspace

END_ID = 1
PIECES = "doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, is_open boolean, part long"


class Tokens:
    """Ids of texts by a tokenizer file.

    Byte-level BPE files whose ids are bytes and then merges in order (checked) are run by
    tiktoken from the file's own vocabulary, which gives the same ids several times faster.
    Other files, texts that hold an added token, and texts with very long runs of white
    space go to tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.fast = Tokenizer.from_file(path), None
        spec = json.loads(self.tok.to_str())
        ranks = _ranks(spec)
        added = [t["content"] for t in spec["added_tokens"]]
        self.other = re.compile("|".join([*map(re.escape, added), r"\s{5000}"]))
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.fast is None or self.other.search(text):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


# Fixed value: how byte-level BPE splits a text before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by bytes, if the file is plain byte-level BPE with ids in order of merging; else None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback")
    if not plain or spec.get("normalizer") or spec.get("truncation") or any(model.get(k) for k in odd):
        return None
    vocab = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    plainly = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in plainly} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plainly)))}
    added = {t["content"] for t in spec["added_tokens"]}
    words = {w: i for w, i in vocab.items() if w not in added}
    if sorted(words.values()) != list(range(len(words))) or any(words.get(w) != 256 + k for k, w in enumerate(merged)):
        return None
    return {bytes(map(byte.__getitem__, w)): i for w, i in words.items()}


_TOKENS: dict[str, Tokens] = {}


def tokens_for(path: str) -> Tokens:
    """One tokenizer for each worker process and file."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


class Packer:
    """Open windows of one task; ``closed`` gets (pieces) of each window that is done.

    A piece is (doc_id, start, ids, doc_tokens).  A gap of more than ``slack`` ids in a
    window that must be emitted is filled with the head of the piece in hand.
    """

    def __init__(self, size: int = 2048, most: int = 64, slack: int = 4):
        self.size, self.most, self.slack = size, most, slack
        self.open: list[tuple[int, list]] = []  # (used, pieces)
        self.closed: list[list] = []

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        n, size = len(ids) // 4, self.size
        while n >= size:
            self.closed.append([(doc_id, start, ids[: 4 * size], doc_tokens)])
            start, ids, n = start + size, ids[4 * size :], n - size
        while n:
            fit = min((i for i, (used, _) in enumerate(self.open) if used + n <= size), key=lambda i: -self.open[i][0], default=None)
            if fit is not None:
                used, pieces = self.open[fit]
                pieces.append((doc_id, start, ids, doc_tokens))
                self.open[fit] = (used + n, pieces)
                if used + n == size:
                    self.closed.append(self.open.pop(fit)[1])
                return
            if len(self.open) < self.most:
                self.open.append((n, [(doc_id, start, ids, doc_tokens)]))
                return
            used, pieces = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i][0]))
            gap = size - used
            if gap > self.slack:
                pieces.append((doc_id, start, ids[: 4 * gap], doc_tokens))
                start, ids, n = start + gap, ids[4 * gap :], n - gap
            self.closed.append(pieces)

    def finish(self) -> None:
        """Close all: windows are filled one after another, and the last ids go to windows of powers of two."""
        line = [p for _, pieces in self.open for p in pieces]
        self.open = []
        left = sum(len(p[2]) // 4 for p in line)
        window, room = [], min(self.size, 1 << (left.bit_length() - 1)) if left else 0
        for doc_id, start, ids, total in line:
            while ids:
                part = ids[: 4 * room]
                window.append((doc_id, start, part, total))
                n = len(part) // 4
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    self.closed.append(window)
                    window, room = [], min(self.size, 1 << (left.bit_length() - 1)) if left else 0


def _rows(windows, first: int, is_open: bool, part: int, kind: pa.DataType):
    """Record batches of about 8 MB of the windows' pieces."""
    cols: list[list] = [[] for _ in range(9)]
    size = 0
    for k, pieces in enumerate(windows):
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for c, v in zip(cols, (doc_id, start, n, ids, total, first + k, at, is_open, part), strict=True):
                c.append(v)
            at, size = at + n, size + len(ids)
        if size > 8 << 20:
            yield _batch(cols, kind)
            cols, size = [[] for _ in range(9)], 0
    if cols[0]:
        yield _batch(cols, kind)


def _batch(cols, kind):
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_open", "part"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, open_windows: int = 64, slack: int = 4, fan_in: int = 32) -> DataFrame:
    """(doc_id, start, length, ids binary of little-endian 32-bit ids, doc_tokens, sequence_id, offset).

    Every document is its ids and then the id 1.  Null texts are empty (the id 1 alone).
    Ids may be null, repeat, or be of any type; each row of ``docs`` is a document.  Sequences are padded
    to ``size``, but for those whose length is a power of two.  Pieces are written once,
    to the shared folder, so that what is emitted and what is merged always agree.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    kind = docs.schema[id_col].dataType.simpleString()
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    schema = PIECES.format(kind=kind)
    end = np.array([END_ID], "<u4").tobytes()

    def first(batches):
        encode, packer, part, count = tokens_for(tokenizer), Packer(size, open_windows, slack), TaskContext.get().partitionId(), 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if len(packer.closed) >= 512:
                    yield from _rows(packer.closed, (part << 25) + count, False, part, arrow)
                    count, packer.closed = count + len(packer.closed), []
        yield from _rows(packer.closed, (part << 25) + count, False, part, arrow)
        count += len(packer.closed)
        yield from _rows([p for _, p in packer.open], (part << 25) + count, True, part, arrow)

    made = work.save(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(first, schema), "pieces0")
    done, left = made.where("not is_open"), made.where("is_open")
    parts = left.agg(F.max("part")).first()[0]
    groups, k = (0 if parts is None else parts + 1), 0
    while groups:
        k, last = k + 1, groups <= fan_in
        groups = -(-groups // fan_in)

        def merge(table: pa.Table, k=k, last=last) -> pa.Table:
            packer, part = Packer(size, open_windows, slack), int(table.column("part")[0].as_py()) // fan_in
            rows = sorted(table.select(["sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens", "length"]).to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
            for r in rows:
                packer.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            if last:
                packer.finish()
            base = (k << 57) + (part << 25)
            out = [*_rows(packer.closed, base, False, part, arrow), *_rows([p for _, p in packer.open], base + len(packer.closed), True, part, arrow)]
            return pa.Table.from_batches(out)

        grouped = left.withColumn("group", F.floor(F.col("part") / fan_in)).groupBy("group")
        made = work.save(grouped.applyInArrow(_one_argument(merge), schema), f"pieces{k}")
        done, left = done.unionByName(made.where("not is_open")), made.where("is_open")
        if last:
            break
    return done.select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def _one_argument(f):
    return lambda table: f(table)


def padding(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """One row (sequences, tokens, padded): how much the sequences are padded."""
    n = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, 0).otherwise(size - F.col("n"))
    return n.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(pad).alias("padded"))
