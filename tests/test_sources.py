"""Stores across sessions, ledgers with racing writers, large artifacts, and the order of rows in files."""

import hashlib
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import checks
from tidewatch.operators.checks import Violation
from tidewatch.plans import catalog
from tidewatch.sources import tables
from tidewatch.sources.scratch import cut, sweep
from tidewatch.sources.store import Store, claim, table_key

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LATER = """
import sys
from pyspark.sql import SparkSession
from tidewatch.operators.checks import Violation
from tidewatch.sources.store import Store, table_key
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
rows = s.createDataFrame([(i, i * 0.5) for i in range(40, 0, -1)], "id int, v double").repartition(3)
key = table_key("scores", {"rows": rows}, {"seed": 42, "variance": 0.9})
try:
    print("found", Store(s, sys.argv[1]).get(key).count())
except Violation as e:
    print("violation", e)
"""


def later(root):
    out = subprocess.run([sys.executable, "-c", LATER, root], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.strip().splitlines()[-1]


def test_a_later_session_verifies_what_an_earlier_one_stored(spark, tmp_path):
    rows = spark.createDataFrame([(i, i * 0.5) for i in range(1, 41)], "id int, v double")
    key, store = table_key("scores", {"rows": rows}, {"variance": 0.9, "seed": 42}), Store(spark, str(tmp_path))
    assert key != table_key("scores", {"rows": rows.where("id > 1")}, {"variance": 0.9, "seed": 42}) and key != table_key("scores", {"rows": rows}, {"seed": 42})
    assert store.put(key, rows).count() == 40
    # What is registered stays, also if other rows come under its name.
    assert store.put(key, rows.limit(3)).count() == 40 and len(os.listdir(tmp_path / "rows")) == 1
    assert later(str(tmp_path)) == "found 40"
    place = str(tmp_path / "rows" / os.listdir(tmp_path / "rows")[0])
    changed = rows.withColumn("v", F.when(F.col("id") == 7, 3.6).otherwise(F.col("v")))
    changed.write.mode("overwrite").parquet(place)
    assert later(str(tmp_path)).startswith("violation the rows of scores-")
    with pytest.raises(Violation, match="nothing is registered"):
        store.get("other")


def test_stage_tables_are_written_once_and_swept(spark):
    made = cut(spark.range(5), "once")
    assert cut(made) is made and made.count() == 5
    other = cut(made.where("id > 1"))
    assert other._stage_path != made._stage_path and other.count() == 3 and os.path.isdir(other._stage_path.removeprefix("file:"))
    catalog.forget(spark)
    assert not os.path.isdir(made._stage_path.removeprefix("file:")) and sweep(spark) == 0


def test_of_racing_writers_one_claims_a_file(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: claim(spark, f"{tmp_path}/a/b", str(k).encode()), range(8)))
    assert sum(won) == 1 and (tmp_path / "a" / "b").read_text() == str(won.index(True)) and os.listdir(tmp_path / "a") == ["b"]


def test_ledgers_are_appended_once_for_each_run(spark, tmp_path):
    nested = {"parameters", "evidence_boundary", "provenance"}
    record = lambda i, **more: {f: {"k": "v"} if f in nested else "x" for f in tables.LEDGER_FIELDS} | {"run_id": i} | more
    path = str(tmp_path / "ledger")

    def append(r):
        try:
            tables.append_ledger(spark, path, r)
            return True
        except Violation:
            return False

    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(append, [record("run/1", model=str(k)) for k in range(4)] + [record("run/2"), record("run 3")]))
    assert sum(won[:4]) == 1 and won[4:] == [True, True]
    got = tables.read_ledger(spark, path).collect()
    assert sorted(r.run_id for r in got) == ["run 3", "run/1", "run/2"] and [r.model for r in got if r.run_id == "run/1"] == [str(won.index(True))]
    with pytest.raises(Violation, match="missing_field: late:owner"):
        tables.append_ledger(spark, path, record("late", owner=None))
    with pytest.raises(Violation, match="duplicate_run"):
        tables.append_ledger(spark, path, record("run/2"))


def test_artifacts_over_two_gigabytes_are_hashed_as_streams(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b%.bin").write_bytes(b"small")
    (tmp_path / "empty.bin").write_bytes(b"")
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)
        f.seek((3 << 30) - 1)
        f.write(b"\x01")
    want = hashlib.sha256()
    for _ in range(3 * 64 - 1):
        want.update(bytes(16 << 20))
    want.update(bytes((16 << 20) - 1) + b"\x01")
    got = {r.path.rpartition("/")[2]: (r.size, r.sha256) for r in tables.artifact_manifest(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and got["large.bin"] == (3 << 30, want.hexdigest())  # listings leave the empty file out
    assert (5, hashlib.sha256(b"small").hexdigest()) in got.values()


@pytest.mark.parametrize("form", ["csv", "parquet"])
def test_rows_out_of_order_in_files_are_found(spark, tmp_path, form):
    n = 6000
    rows = [(i // 50, i % 50) for i in range(n)]

    def scan(rows, name):
        path = str(tmp_path / name)
        made = spark.createDataFrame(rows, "engine int, cycle int").coalesce(1)
        (made.write.option("parquet.block.size", 4096).option("header", False) if form == "parquet" else made.write).format(form).save(path)
        return spark.read.schema("engine int, cycle int").format(form).load(path)

    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good = scan(rows, "good")
        assert checks.check_physical_order(good, ["engine", "cycle"]).count() == 0
        if form == "csv":
            starts = sorted(r[0] for r in good.select("_metadata.file_block_start").distinct().collect())
            assert len(starts) > 3
            # Two rows are swapped across the edge of a block: the row before it and the one after it.
            blocks = good.select("_metadata.file_block_start", "engine", "cycle").collect()
            edge = min((r.engine, r.cycle) for r in blocks if r.file_block_start == starts[2])
            at = rows.index(edge)
            swapped = [*rows[: at - 1], rows[at], rows[at - 1], *rows[at + 1 :]]
            found = checks.check_physical_order(scan(swapped, "swapped"), ["engine", "cycle"]).collect()
            assert [r.detail.split(":")[1:] for r in found] == [[str(rows[at - 1][0]), str(rows[at - 1][1])]]
        middle = [*rows[:100], rows[101], rows[100], *rows[102:]]
        found = checks.check_physical_order(scan(middle, "middle"), ["engine", "cycle"]).collect()
        assert [r.detail.split(":")[1:] for r in found] == [[str(rows[100][0]), str(rows[100][1])]]
        twice = checks.check_physical_order(scan([*rows[:10], rows[9], *rows[10:]], "twice"), ["engine", "cycle"]).collect()
        assert len(twice) == 1
        allowed = spark.createDataFrame([(e,) for e in range(n // 50)], "engine int")
        lacking = scan([(e, c + 1) for e, c in middle], "lacking")
        with pytest.raises(Violation, match="not_ascending"):
            tables.read_partition_filtered(lacking, allowed, allowed, in_order=True)
        assert tables.read_partition_filtered(lacking, allowed, allowed).count() == n
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
