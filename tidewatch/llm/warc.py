"""WARC records as a chunked table.

A record is rows (record_id, chunk, data, prefix_sha1, last, record_key): the data of its rows, in
order, are the bytes of a WARC/1.1 record, so that the rows of a shard in order of
(record_id, record_key, chunk) are the bytes of an archive file.  record_key tells apart the
records of rows that repeat an id.  Chunks are bounded: a payload is
written and read as a stream of slices, with a SHA-1 carried from chunk to chunk, and no
task joins a whole record.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Workspace, salted_left_join

CHUNK = 1 << 20
CHUNK_SCHEMA = "record_id long, chunk int, data binary, prefix_sha1 string, last boolean, record_key long"


def payload_digests(pages: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(record_id, bytes, sha1): what decides who revisits whom; narrow, made in one scan."""
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    return pages.select(F.col(id_col).cast("long").alias("record_id"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body).alias("sha1"))


def plan_revisits(digests: DataFrame, least: int = 1000) -> DataFrame:
    """(record_id, sha1, refers_to), distinct: of equal payloads of ``least`` bytes or more, all but the largest id refer to it.

    Groups are pre-aggregated, and only groups of two or more are joined back, salted:
    a payload that a third of all records share doesn't gather in one task.
    """
    large = digests.where(F.col("bytes") >= least)
    groups = large.groupBy("sha1", "bytes").agg(F.max("record_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = salted_left_join(large, groups, ["sha1", "bytes"], ["record_id"])
    return joined.where(F.col("first").isNotNull() & (F.col("first") != F.col("record_id"))).select("record_id", "sha1", F.col("first").alias("refers_to")).distinct()


def _header(record_id: int, url: str, length: int, sha1: str, refers_to: int | None) -> bytes:
    uid = lambda n: f"<urn:x-record:{n}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {uid(record_id)}", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {uid(refers_to)}"]
    lines += ["Content-Type: application/octet-stream", f"Content-Length: {0 if refers_to is not None else length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record_rows(rows):
    """Chunk rows of records, from rows (record_id, url, bytes, sha1, refers_to, key, chunk, last, part) in order of chunk.

    Chunk 0 becomes the header and the last gets the closing line ends; the digest runs
    from chunk to chunk, and no more than a chunk is held.
    """
    running = hashlib.sha1()
    for record_id, url, length, sha1, refers_to, key, chunk, last, part in rows:
        if chunk == 0:
            running, data = hashlib.sha1(), _header(record_id, url or "", length, sha1, refers_to)
        else:
            data = part.as_buffer().to_pybytes()
            running.update(data)
        yield record_id, chunk, data + (b"\r\n\r\n" if last else b""), running.hexdigest(), last, key


def _emit(rows, most: int = 4 << 20):
    """Record batches of at most about ``most`` bytes of data."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows):
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["record_id", "chunk", "data", "prefix_sha1", "last", "record_key"])


def write_chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, chunk: int = CHUNK, most_broadcast: int = 200_000) -> DataFrame:
    """The chunk rows of one record for each row of ``pages`` whose id isn't null.

    Null payloads are empty and null URLs blank.  Rows with a null id have no record.  Rows
    that repeat an id have a record each: they share its WARC-Record-ID, and their
    record_key tells them apart.
    """
    work = Workspace(pages.sparkSession, "warc-plan")
    named = pages.where(F.col(id_col).isNotNull())
    plan = work.save(plan_revisits(payload_digests(named, id_col, body_col), least), "revisits")
    rows = named.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumns({"sha1": F.sha1("body"), "bytes": F.octet_length("body").cast("long")})
    # The plan is unique on both keys, so a repeated row stays one row.  While it is of a
    # counted, small size it is broadcast, and no payload is exchanged.
    rows = rows.join(F.broadcast(plan) if plan.limit(most_broadcast + 1).count() <= most_broadcast else plan, ["record_id", "sha1"], "left")
    # Payloads are cut before they reach Python: an empty chunk for the header, then slices of what the record holds.
    held = F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(b""))
    rows = rows.select("record_id", "url", "bytes", "sha1", "refers_to", F.monotonically_increasing_id().alias("record_key"), held.alias("body"))
    many = F.ceil(F.octet_length("body") / F.lit(chunk)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), many), lambda i: F.when(i == 0, F.lit(b"")).otherwise(F.substring(F.col("body"), (i - 1) * chunk + 1, F.lit(chunk))))
    rows = rows.select("record_id", "url", "bytes", "sha1", "refers_to", "record_key", many.alias("many"), F.posexplode(cut).alias("chunk", "part"))
    rows = rows.select("record_id", F.when(F.col("chunk") == 0, F.col("url")).alias("url"), "bytes", "sha1", "refers_to", "record_key", "chunk", (F.col("chunk") == F.col("many")).alias("last"), "part")

    def run(batches):
        def each():
            for b in batches:
                head = [b.column(i).to_pylist() for i in range(8)]
                yield from zip(*head, b.column(8), strict=True)

        yield from _emit(record_rows(each()))

    return rows.mapInArrow(run, CHUNK_SCHEMA)


def write(pages: DataFrame, path: str, **options) -> None:
    """Write the chunk table of ``pages`` to ``path``, by Spark's own writer."""
    write_chunks(pages, **options).write.parquet(path)


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields, lower-cased names, and where the payload starts."""
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, at + 4


def read(chunks: DataFrame) -> DataFrame:
    """(record_id, url, payload_bytes, payload_digest, record_type, refers_to), a row for each record.

    Chunks of a record meet in one task in order and are hashed as a stream, a chunk at a
    time.  A missing or repeated chunk, a prefix digest that doesn't hold, or a payload
    that isn't what the header says raises ValueError.  Revisits have the digest and
    length of the payload that they refer to, as their headers carry them.
    """

    def run(batches):
        state: dict = {"id": None}
        for b in batches:
            done = []
            for i in range(b.num_rows):
                rid, k, data, prefix, last, key = (b.column(c)[i] for c in range(6))
                rid, k, prefix, last, key = rid.as_py(), k.as_py(), prefix.as_py(), last.as_py(), key.as_py()
                data = memoryview(data.as_buffer())
                if k == 0:
                    if state["id"] is not None:
                        raise ValueError(f"record {state['id']} has no last chunk")
                    head, start = parse_header(bytes(data))  # the first chunk holds no payload
                    state = {"id": rid, "key": key, "next": 0, "head": head, "sha1": hashlib.sha1(), "bytes": 0}
                    data = data[start:]
                if state["id"] != rid or state["key"] != key or state["next"] != k:
                    raise ValueError(f"record {rid}: chunk {k} out of order")
                part = data[: len(data) - 4] if last else data
                state["sha1"].update(part)
                state["bytes"] += len(part)
                state["next"] += 1
                if state["sha1"].hexdigest() != prefix:
                    raise ValueError(f"record {rid}: chunk {k} has another digest")
                if last:
                    done.append(_closed(state))
                    state = {"id": None}
            if done:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], t) for j, t in enumerate(kinds)], ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if state["id"] is not None:
            raise ValueError(f"record {state['id']} has no last chunk")

    ordered = chunks.select("record_id", "chunk", "data", "prefix_sha1", "last", "record_key").repartition("record_id", "record_key").sortWithinPartitions("record_id", "record_key", "chunk")
    return ordered.mapInArrow(run, "record_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _closed(state: dict) -> tuple:
    head = state["head"]
    kind = head["warc-type"]
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(head["x-payload-length"])
    if int(head["content-length"]) != state["bytes"] or kind == "response" and (digest != state["sha1"].hexdigest() or size != state["bytes"]):
        raise ValueError(f"record {state['id']}: the payload isn't what the header says")
    refers = head.get("warc-refers-to")
    return state["id"], head["warc-target-uri"], size, digest, kind, refers and int(refers.rpartition(":")[2].rstrip(">"))
