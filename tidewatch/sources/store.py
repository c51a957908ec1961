"""Tables that a later session reads and verifies: named by what they were made of, registered all at once."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Mapping
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from ..operators.checks import Violation
from ..operators.compare import frame_fingerprint


def _path(spark: SparkSession, path: str):
    """(file system, path object) of ``path``."""
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def claim(spark: SparkSession, path: str, content: bytes) -> bool:
    """Write a file that isn't there yet, whole or not at all; False if another writer was first.

    The content stands under a name of its own and then gets its place in one step: a link
    on a local file system, a rename, which fails where the place is taken, on others.
    """
    fs, place = _path(spark, path)
    fs.mkdirs(place.getParent())
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    if fs.getScheme() == "file":
        local = lambda p: unquote(urlparse(p).path) if "://" in p or p.startswith("file:") else p
        with open(local(draft), "xb") as f:
            f.write(content)
        try:
            os.link(local(draft), local(path))
        except FileExistsError:
            return False
        finally:
            os.unlink(local(draft))
        return True
    out = fs.create(_path(spark, draft)[1], False)
    out.write(bytearray(content))
    out.close()
    if fs.exists(place) or not fs.rename(_path(spark, draft)[1], place):
        fs.delete(_path(spark, draft)[1], False)
        return False
    return True


def table_key(name: str, inputs: Mapping[str, DataFrame], parameters: Mapping) -> str:
    """What a table is called: a digest of its name, its parameters and the rows of all that it is made of, in any order."""
    rows = {k: list(frame_fingerprint(df).first()) for k, df in sorted(inputs.items())}
    text = json.dumps([name, rows, dict(parameters)], sort_keys=True, default=str)
    return f"{name}-{hashlib.sha256(text.encode()).hexdigest()}"


class Store:
    """A folder of registered tables.

    A table's rows are written under a name of their own, and a record of where they are,
    how many and with which digest is claimed under the table's key: a crash leaves no
    record, and of two sessions that write one key the first wins.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _record(self, key: str) -> dict | None:
        fs, place = _path(self.spark, f"{self.root}/records/{key}.json")
        return json.loads(self.spark.read.text(place.toString(), wholetext=True).first()[0]) if fs.exists(place) else None

    def put(self, key: str, df: DataFrame) -> DataFrame:
        """Register ``df`` as ``key`` and read it, or what is registered already."""
        if self._record(key) is None:
            rows = f"rows/{key}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{rows}")
            written = self.spark.read.schema(df.schema).parquet(f"{self.root}/{rows}")
            count, digest = frame_fingerprint(written).first()
            record = {"rows": rows, "count": count, "digest": digest, "schema": df.schema.json()}
            if not claim(self.spark, f"{self.root}/records/{key}.json", json.dumps(record).encode()):
                fs, place = _path(self.spark, f"{self.root}/{rows}")
                fs.delete(place, True)
        return self.get(key, verify=False)

    def get(self, key: str, verify: bool = True) -> DataFrame:
        """The rows of ``key``; with ``verify``, Violation unless they are those that were registered."""
        record = self._record(key)
        if record is None:
            raise Violation(f"nothing is registered as {key}")
        df = self.spark.read.parquet(f"{self.root}/{record['rows']}")
        if verify and tuple(frame_fingerprint(df).first()) != (record["count"], record["digest"]):
            raise Violation(f"the rows of {key} aren't those that were registered")
        return df
