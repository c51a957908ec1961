"""Token ids as files of bit or byte planes.

Ids are dealt into chunks of a fixed number of ids.  A chunk is transposed into planes (the
first bytes of all its ids, then the second bytes ..., or bit by bit), and each plane is
compressed by zstandard, so that planes that hardly vary take hardly any room.  A chunk
index says where each chunk's ids lie among all ids, and which texts they are of.

The chunk rows are written by Spark's own writer, so a lost task leaves nothing behind, and
are kept by shard (a range of text ids) and chunk.  ``to_file`` makes one file of a shard's
rows: the chunks, the index, and where the index begins; ``TokenFile`` reads any stretch of
ids of such a file by its index alone.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Workspace
from .packing import tokens_for

#: Ids of a chunk, but for the last one of a shard.
CHUNK = 1 << 16
#: The first and last bytes of a file.
MAGIC = b"TWPLANES1"
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, form: str) -> list[bytes]:
    """The planes of little-endian 32-bit ids: 4 of bytes or 32 of bits, the lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if form == "byte":
        return [plane.tobytes() for plane in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(plane, bitorder="little").tobytes() for plane in np.ascontiguousarray(bits.T)]


def from_planes(planes: list[bytes], n: int, form: str) -> np.ndarray:
    """The ids of a chunk's planes."""
    if form == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class Encoder:
    """Ids of texts in, chunk rows out: (chunk, n_ids, form, planes, crc32, docs)."""

    def __init__(self, chunk: int = CHUNK, form: str = "byte", level: int = 3):
        self.chunk, self.form, self.zstd = chunk, form, zstandard.ZstdCompressor(level=level)
        self.made, self.held, self.size, self.docs = 0, [], 0, []

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of the chunks that the text ``doc_id`` fills."""
        self.docs.append((doc_id, self.made * self.chunk + self.size, len(ids)))
        at = 0
        while at < len(ids):
            part = ids[at : at + self.chunk - self.size]
            self.held.append(part)
            self.size, at = self.size + len(part), at + len(part)
            if self.size == self.chunk:
                yield self._row()

    def finish(self) -> Iterator[tuple]:
        if self.size or self.docs:
            yield self._row()

    def _row(self) -> tuple:
        ids = np.concatenate([*self.held, np.empty(0, "<u4")]).astype("<u4")
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.form)]
        row = self.made, len(ids), self.form, planes, zlib.crc32(ids.tobytes()), self.docs
        self.made, self.held, self.size, self.docs = self.made + 1, [], 0, []
        return row


def decode(chunk: int, n: int, form: str, planes: Iterable[bytes], crc: int, zstd: zstandard.ZstdDecompressor) -> np.ndarray:
    """The ids of a chunk row; ValueError if they aren't those that were written."""
    size = n if form == "byte" else (n + 7) // 8
    ids = from_planes([zstd.decompress(p, max_output_size=size) for p in planes], n, form)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError(f"chunk {chunk} has other ids than were written")
    return ids


def _rows_schema(kind: str) -> str:
    return f"shard int, chunk bigint, n_ids bigint, form string, planes array<binary>, crc bigint, docs array<struct<doc_id:{kind},start:bigint,length:bigint>>"


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, chunk: int = CHUNK, form: str = "byte", level: int = 3) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to ``path``: ``chunks`` and ``index``.

    Rows are in ascending order of id over all shards (null ids first; rows of one id by
    their text).  Null texts are empty.  Ids may be of any type that Spark can sort.  Texts
    are exchanged once, by range of id, and a task holds a chunk of ids and a batch of
    texts at a time.  ``index``: (shard, chunk, first, n_ids, bytes), where first counts
    ids from the first of all shards.
    """
    if form not in PLANES:
        raise ValueError(f"planes are of bits or bytes, not {form!r}")
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The second key deals rows that share an id to more than one task.
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, made, shard, held, size, schema = tokens_for(tokenizer), Encoder(chunk, form, level), TaskContext.get().partitionId(), [], 0, None
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            schema = schema or _arrow(b.schema.field(0).type)
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                for row in made.add(doc_id.as_py(), np.frombuffer(encode(text.as_py()) + end, "<u4")):
                    held.append((shard, *row))
                    size += sum(map(len, row[3])) + 32 * len(row[5])
                    if size > 4 << 20:
                        yield _batch(held, schema)
                        held, size = [], 0
        held += [(shard, *row) for row in made.finish()]
        if held:
            yield _batch(held, schema)

    dealt.select("doc_id", "text").mapInArrow(run, _rows_schema(kind)).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = read_chunks(spark, path, kind)
    plane_bytes = F.aggregate("planes", F.lit(0).cast("bigint"), lambda a, p: a + F.octet_length(p))
    sizes = chunks.select("shard", "chunk", "n_ids", plane_bytes.alias("bytes"))
    # A row for each shard, of which there are as many as tasks wrote: a small table.
    per = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    index = sizes.join(F.broadcast(before), "shard").select("shard", "chunk", (F.col("before") + F.col("chunk") * chunk).alias("first"), "n_ids", "bytes")
    index.write.parquet(f"{path}/index")


def _arrow(kind: pa.DataType) -> pa.Schema:
    docs = pa.list_(pa.struct([("doc_id", kind), ("start", pa.int64()), ("length", pa.int64())]))
    return pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("n_ids", pa.int64()), ("form", pa.string()), ("planes", pa.list_(pa.binary())), ("crc", pa.int64()), ("docs", docs)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    docs = [[dict(zip(("doc_id", "start", "length"), d, strict=True)) for d in r[6]] for r in rows]
    columns = [*([r[i] for r in rows] for i in range(6)), docs]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def read_chunks(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The chunk rows; ``kind``: the type of the texts' ids."""
    return spark.read.schema(_rows_schema(kind)).parquet(f"{path}/chunks")


def read(spark: SparkSession, path: str, kind: str = "bigint", ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each text, from the files; with ``ids``, also ids as an array.

    start counts ids from the first of all shards, by the index.  A shard's chunks meet in
    one task in order and are decoded one at a time; a text over several chunks is summed
    as they come, so without ``ids`` none is held whole.  Chunks that lack, repeat or hold
    other ids than were written end the query.
    """
    index = spark.read.parquet(f"{path}/index")
    shards = index.where("chunk = 0").select("shard", F.col("first").alias("before"))
    rows = read_chunks(spark, path, kind).join(F.broadcast(shards), "shard", "left").repartition("shard").sortWithinPartitions("shard", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, shard, following, open_docs, id_type = zstandard.ZstdDecompressor(), None, 0, [], None

        def complete():
            if open_docs:
                raise ValueError(f"shard {shard} ends within a text")

        for b in batches:
            done: list[tuple] = []
            id_type = id_type or b.column(6).type.value_type.field(0).type
            for i in range(b.num_rows):
                mine, k, n, form, planes, crc, docs, before = (b.column(c)[i].as_py() for c in range(8))
                if mine != shard:
                    complete()
                    shard, following, place = mine, 0, 0
                if k != following or before is None:
                    raise ValueError(f"shard {shard}: chunk {following} is missing or stands twice")
                following += 1
                got = decode(k, n, form, planes, crc, zstd)
                # Texts that begin here, after the one that an earlier chunk left open.
                open_docs += [[d["doc_id"], d["start"], d["length"], 0, []] for d in docs]
                stop, left = place + n, []
                for d in open_docs:
                    part = got[max(0, d[1] - place) : max(0, d[1] + d[2] - place)]
                    d[3] = zlib.crc32(part.tobytes(), d[3])
                    if ids:
                        d[4].append(part)
                    if d[1] + d[2] <= stop:
                        done.append((d[0], before + d[1], d[2], d[3], np.concatenate(d[4]) if ids else None))
                    else:
                        left.append(d)
                open_docs, place = left, stop
            if done:
                columns = [pa.array([d[0] for d in done], id_type), *[pa.array([d[c] for d in done], pa.int64()) for c in (1, 2, 3)]]
                if ids:
                    columns.append(pa.array([d[4].astype(np.int64) for d in done], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
        complete()

    columns = ["shard", "chunk", "n_ids", "form", "planes", "crc", "docs", "before"]
    return rows.select(*columns).mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint{', ids array<bigint>' if ids else ''}")


def to_file(rows: Iterable, path: str) -> None:
    """One file of a shard's chunk rows, in order of chunk, as ``toLocalIterator`` gives them: a chunk at a time is held."""
    index, at = [], len(MAGIC)
    with open(path, "wb") as f:
        f.write(MAGIC)
        for r in rows:
            sizes = [len(p) for p in r["planes"]]
            for p in r["planes"]:
                f.write(p)
            index.append([at, r["n_ids"], r["form"], sizes, r["crc"], [[d["doc_id"], d["start"], d["length"]] for d in r["docs"]]])
            at += sum(sizes)
        f.write(json.dumps(index).encode())
        f.write(struct.pack("<Q", at) + MAGIC)


class TokenFile:
    """Random access to a file of ``to_file``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            f.seek(-8 - len(MAGIC), 2)
            end = f.tell()
            at, magic = struct.unpack("<Q", f.read(8))[0], f.read()
            if magic != MAGIC:
                raise ValueError(f"{path} isn't a file of token planes")
            f.seek(at)
            self.index = json.loads(f.read(end - at))
        self.path, self.zstd = path, zstandard.ZstdDecompressor()
        self.starts = np.concatenate(([0], np.cumsum([e[1] for e in self.index]))).astype(np.int64)
        self.docs = [tuple(d) for e in self.index for d in e[5]]

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids ``start`` to ``start + length``, of which only the chunks that hold them are read."""
        if start < 0 or length < 0 or start + length > self.starts[-1]:
            raise IndexError(f"no ids {start} to {start + length}")
        first, parts = int(np.searchsorted(self.starts, start, side="right")) - 1, []
        with open(self.path, "rb") as f:
            for k in range(first, int(np.searchsorted(self.starts, start + length))):
                at, n, form, sizes, crc, _ = self.index[k]
                f.seek(at)
                got = decode(k, n, form, [f.read(s) for s in sizes], crc, self.zstd)
                parts.append(got[max(0, start - self.starts[k]) : start + length - self.starts[k]])
        return np.concatenate([*parts, np.empty(0, "<u4")]).astype("<u4")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of all texts to the shared folder and read them back: see ``write`` and ``read``."""
    path = Workspace(docs.sparkSession, "token-planes").root
    write(docs, path, tokenizer, **options)
    return read(docs.sparkSession, path, docs.schema[options.get("id_col", "doc_id")].dataType.simpleString())
