"""Sources and sinks: cycle files, splits, manifests, ledgers, fitted state and artifact digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import Violation, assert_empty, check_cycles, check_physical_order, check_split_membership
from ..schema import Roles
from .scratch import cut
from .store import _path, claim


def cycle_schema(sensors: int = 21, settings: int = 3) -> T.StructType:
    names = [("engine", T.IntegerType()), ("cycle", T.IntegerType()), *[(f"op{i + 1}", T.DoubleType()) for i in range(settings)], *[(f"sensor_{i + 1}", T.DoubleType()) for i in range(sensors)]]
    return T.StructType([T.StructField(n, t) for n, t in names])


def read_cycles_text(spark: SparkSession, path: str, schema: T.StructType | None = None, check: bool = True, roles: Roles = Roles()) -> DataFrame:
    """Headerless files of numbers separated by white space, by position; blank lines are skipped."""
    schema = schema or cycle_schema()
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    out = lines.select(*[F.get(parts, i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])
    if check:
        assert_empty(check_cycles(out, roles))
    return out


def read_cycles_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, check: bool = True, roles: Roles = Roles()) -> DataFrame:
    """CSV with a header, by an explicit schema."""
    out = spark.read.schema(schema or cycle_schema()).option("header", True).option("enforceSchema", False).csv(path)
    if check:
        assert_empty(check_cycles(out, roles))
    return out


def read_partition_filtered(cycles: DataFrame, allowed: DataFrame, known: DataFrame, rows: int | None = None, roles: Roles = Roles(), in_order: bool = False) -> DataFrame:
    """Rows of allow-listed entities, after checks of the whole table: unknown entities, order, repeats, counts.

    ``in_order``: the files must hold an entity's cycles in ascending order, as they lie
    there (see ``check_physical_order``); ``cycles`` must then be a file scan.
    """
    if in_order:
        assert_empty(check_physical_order(cycles, roles.keys))
    unknown = cycles.select(roles.entity).distinct().join(known.select(roles.entity), roles.entity, "left_anti")
    assert_empty(unknown.select(F.lit("unknown_entity"), F.col(roles.entity).cast("string")))
    assert_empty(check_cycles(cycles, roles))
    kept = cycles.join(allowed.select(roles.entity).distinct(), roles.entity, "left_semi")
    got = kept.agg(F.count("*").alias("n"), F.count_distinct(roles.entity).alias("e")).first()
    if rows is not None and got["n"] != rows:
        raise Violation(f"{got['n']} rows, expected {rows}")
    if got["e"] != allowed.select(roles.entity).distinct().count():
        raise Violation("allow-listed entities without rows")
    return kept


def write_splits(cycles: DataFrame, assignments: DataFrame, path: str, roles: Roles = Roles()) -> DataFrame:
    """Write cycles partitioned by split; (split, rows) that partition the source are returned."""
    joined = cycles.join(assignments.select(roles.entity, roles.split), roles.entity)
    joined.write.partitionBy(roles.split).parquet(path)
    counts = cycles.sparkSession.read.parquet(path).groupBy(roles.split).agg(F.count("*").alias("rows"))
    written, source = counts.agg(F.sum("rows")).first()[0] or 0, cycles.count()
    if written != source:
        raise Violation(f"{written} rows written of {source}")
    return counts


def manifest_json(assignments: DataFrame, seed: int, ratios: Sequence[float], roles: Roles = Roles()) -> DataFrame:
    """One row (manifest): a deterministic JSON document of counts and assignments.

    A manifest is one document by contract; tables of assignments beyond a document's
    size are kept as tables.
    """
    one = F.array_sort(F.collect_list(F.struct(F.col(roles.entity).alias("engine"), F.col(roles.split).alias("split"), "cycle_count", "max_cycle", "stratum")))
    counts = F.map_from_entries(F.array_sort(F.collect_list(F.struct(roles.split, "n"))))
    per = assignments.groupBy(roles.split).agg(F.count("*").alias("n")).agg(counts.alias("counts"))
    doc = F.struct(F.lit(seed).alias("seed"), F.array(*map(F.lit, ratios)).alias("ratios"), F.col("counts"), F.col("engines"))
    return assignments.agg(one.alias("engines")).crossJoin(per).select(F.to_json(doc).alias("manifest"))


MANIFEST = "seed int, ratios array<double>, counts map<string,long>, engines array<struct<engine:long,split:string,cycle_count:long,max_cycle:long,stratum:int>>"


def manifest_memberships(manifest: DataFrame, column: str = "manifest") -> DataFrame:
    """(engine, split, cycle_count, max_cycle, stratum) of a manifest; an entity in two splits is an error."""
    rows = manifest.select(F.inline(F.from_json(column, MANIFEST)["engines"]))
    assert_empty(rows.groupBy("engine").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("in_two_splits"), F.col("engine").cast("string")))
    return rows


def write_window_metadata(cycles: DataFrame, assignments: DataFrame, path: str, roles: Roles = Roles()) -> DataFrame:
    """Check entities of each split, build the windows' metadata, write it by split and read it."""
    from ..operators.windows import window_metadata

    for split in [r[0] for r in assignments.select(roles.split).distinct().collect()]:
        assert_empty(check_split_membership(cycles.where(F.col(roles.split) == split), assignments, split, roles))
    window_metadata(cycles, roles).write.partitionBy(roles.split).parquet(path)
    return cycles.sparkSession.read.parquet(path)


def write_transformed(scaled: DataFrame, source: DataFrame, path: str, identity: Sequence[str], roles: Roles = Roles()) -> DataFrame:
    """Write scaled cycles whose identity columns are those of the source, without null sensors."""
    a, b = scaled.select(*identity), source.select(*identity)
    assert_empty(a.exceptAll(b).unionByName(b.exceptAll(a)).select(F.lit("identity_changed"), F.concat_ws(":", *[F.col(c).cast("string") for c in identity])))
    nulls = scaled.where(" or ".join(f"`{s}` is null" for s in roles.sensors))
    assert_empty(nulls.select(F.lit("null_sensor"), F.col(roles.entity).cast("string")))
    scaled.write.parquet(path)
    return scaled.sparkSession.read.parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Write each named table below ``path``; existing ones are an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").format(form).options(**({"header": True} if form == "csv" else {})).save(f"{path}/{name}")


def write_timeline(timeline: DataFrame, path: str, form: str = "json", nested: str = "top_three") -> None:
    """A timeline as JSON records, or as CSV with its nested column as JSON text."""
    out = timeline if form == "json" else timeline.withColumn(nested, F.to_json(nested)).drop("contributions")
    out.write.mode("errorifexists").format(form).options(**({"header": True} if form == "csv" else {})).save(path)


# Fields that a run record must have.
LEDGER_FIELDS = ("schema_version", "run_id", "source_run_id", "timestamp", "owner", "experiment_name", "model", "parameters", "population", "metric", "evidence_class", "result_classification", "evidence_boundary", "split", "config", "artifact", "notes", "provenance")


def ledger_schema() -> T.StructType:
    nested = {"parameters", "evidence_boundary", "provenance"}
    return T.StructType([T.StructField(f, T.MapType(T.StringType(), T.StringType()) if f in nested else T.StringType()) for f in LEDGER_FIELDS])


def check_ledger(records: DataFrame) -> DataFrame:
    """Violations: a required field missing, or a run id that repeats."""
    missing = records.select("run_id", F.explode(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in LEDGER_FIELDS])).alias("f")).where("f is not null")
    twice = records.groupBy("run_id").count().where("count > 1")
    return missing.select(F.lit("missing_field").alias("check"), F.concat_ws(":", F.coalesce("run_id", F.lit("null")), "f").alias("detail")).unionByName(twice.select(F.lit("duplicate_run").alias("check"), F.col("run_id").alias("detail")))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    out = spark.read.schema(ledger_schema()).json(path)
    assert_empty(check_ledger(out))
    return out


def append_ledger(spark: SparkSession, path: str, record: dict) -> None:
    """Append one record as a JSON file of its own, named by its run id.

    The file is claimed whole and only if it isn't there, so of two writers of one run id
    one wins and the other gets a Violation, as for a missing field or an id that another
    file of the ledger holds.
    """
    text = json.dumps(record, sort_keys=True)
    new = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", ledger_schema()).alias("r")).select("r.*")
    assert_empty(check_ledger(new))
    name = hashlib.sha256(str(record["run_id"]).encode()).hexdigest()
    if not claim(spark, f"{path}/run-{name}.json", f"{text}\n".encode()):
        raise Violation(f"duplicate_run: {record['run_id']}")
    twice = spark.read.schema(ledger_schema()).json(path).where(F.col("run_id") == record["run_id"]).count()
    if twice > 1:
        fs, place = _path(spark, f"{path}/run-{name}.json")
        fs.delete(place, False)
        raise Violation(f"duplicate_run: {record['run_id']}")


def save_state(tables: dict[str, DataFrame], path: str, **lineage: str) -> None:
    """Write parameter tables with lineage ids as columns."""
    for name, df in tables.items():
        df.withColumns({f"lineage_{k}": F.lit(v) for k, v in lineage.items()}).write.mode("errorifexists").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, names: Sequence[str], **lineage: str) -> dict[str, DataFrame]:
    """Read parameter tables; a lineage id that isn't the expected one is an error."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        for k, v in lineage.items():
            assert_empty(df.where(~F.col(f"lineage_{k}").eqNullSafe(F.lit(v))).select(F.lit(f"lineage_{k}"), F.col(f"lineage_{k}")))
        out[name] = df.drop(*[c for c in df.columns if c.startswith("lineage_")])
    return out


def _opened(place: str):
    """A stream of the bytes of a listed file, whose name isn't escaped."""
    scheme, colon, rest = place.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return open("/" + (rest if scheme == "file" else place).lstrip("/"), "rb")
    from pyarrow.fs import FileSystem

    store, inner = FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
    return store.open_input_stream(inner)


def artifact_manifest(spark: SparkSession, path: str, pattern: str = "*", chunk: int = 8 << 20) -> DataFrame:
    """(path, size, sha256) of files of any size; empty files, which Spark's listing leaves out, have no row.

    Files are listed without being read and dealt to tasks by size, and each is hashed as a
    stream, ``chunk`` bytes at a time.  Files of a store that Python workers can't open are
    read by Spark as one cell each, which limits those, and only those, to 2 GB.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    files = listed.select("path", F.col("length").alias("size"))

    def run(batches):
        for b in batches:
            found = []
            for place in b.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    with _opened(place) as f:
                        while part := f.read(chunk):
                            digest.update(part)
                    found.append(digest.hexdigest())
                except (OSError, ValueError, NotImplementedError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], ["path", "size", "sha256"])

    n = max(1, min(files.count(), 10_000))
    made = cut(files.repartitionByRange(n, F.desc("size"), "path").mapInArrow(run, "path string, size long, sha256 string"), "artifacts")
    if made.where("sha256 is null").isEmpty():
        return made
    cells = listed.where(F.col("length") < (1 << 31) - 1).select("path", F.sha2("content", 256).alias("sha256"))
    lacking = F.raise_error(F.concat(F.lit("no worker can open "), "path")).cast("string")
    left = made.where("sha256 is null").select("path", "size").join(cells, "path", "left").withColumn("sha256", F.coalesce("sha256", lacking))
    return made.where("sha256 is not null").unionByName(left)


def verify_artifacts(found: DataFrame, registered: DataFrame) -> DataFrame:
    """(path, problem) of files that are missing, unknown or changed."""
    a = found.select("path", F.col("sha256").alias("__f"))
    b = registered.select("path", F.col("sha256").alias("__r"))
    both = a.join(b, "path", "full_outer")
    problem = F.when(F.col("__f").isNull(), "missing").when(F.col("__r").isNull(), "unknown").when(F.col("__f") != F.col("__r"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def materialize_endpoint_context(windows: DataFrame, cycles: DataFrame, path: str, roles: Roles = Roles()) -> DataFrame:
    """Write windows with their endpoint's mode, refusing to overwrite; one row (rows, digest) is returned."""
    from ..operators.compare import frame_fingerprint
    from ..operators.windows import assign_endpoint_mode

    before = windows.count()
    out = assign_endpoint_mode(windows, cycles, roles)
    assert_empty(out.where(F.col(roles.mode).isNull()).select(F.lit("no_endpoint"), F.col("window_id")))
    out.write.mode("errorifexists").parquet(path)
    back = windows.sparkSession.read.parquet(path)
    if back.count() != before:
        raise Violation("the set of windows changed")
    return frame_fingerprint(back)
