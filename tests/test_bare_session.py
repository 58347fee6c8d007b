"""A session that names no checkpoint folder: loops, the scan and row numbers work out of the box."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import glob, sys
sys.path.insert(0, {root!r})
from taintgrid import get_session
from taintgrid.operators.graph import closure
from taintgrid.plans import all_cases
from taintgrid.session import checkpoint, ranked
spark = get_session("bare", 8, 4)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert checkpoint(spark.range(3)).count() == 3
assert [r.rn for r in ranked(spark.range(5), [], ["id"]).orderBy("id").collect()] == [1, 2, 3, 4, 5]
edges = spark.createDataFrame([(1, 2), (2, 3)], "src int, dst int")
assert closure(edges, spark.createDataFrame([(1,)], "node int"), []).count() == 3
assert all_cases()[0]["scan_vulns"](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


def run_bare(tmp_path, code):
    """Run code in a process whose Spark configuration is empty."""
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")}
    return subprocess.run(
        [sys.executable, "-c", code.format(root=ROOT)], env={**env, "SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)},
        capture_output=True, text=True, timeout=600)


def test_nothing_needs_a_named_checkpoint_folder(tmp_path):
    done = run_bare(tmp_path, CODE)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-3000:]
    assert not list(tmp_path.glob("spark-taintgrid-*"))  # removed at exit
