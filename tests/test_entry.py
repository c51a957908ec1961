"""The driver contract in odd surroundings."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRATCH = """
from pyspark.sql import SparkSession
from tidewatch.sources.scratch import cut
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
assert cut(s.range(3)).count() == 3
print("written")
"""


def run(code, **env):
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT} | env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout


def test_stage_tables_need_no_checkpoint_setting_in_local_mode(tmp_path):
    assert "written" in run(SCRATCH, SPARK_CONF_DIR=str(tmp_path))


def test_queries_load_without_the_dependencies_of_the_training_data_operators():
    names = run("import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(*e.queries())").split()
    assert "flagship_alerts" in names and not any(n.startswith("op") for n in names)
