"""Queries whose Python workers are other processes, with this folder on none of their paths."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
import textwrap

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import importlib.util, sys
from pyspark.sql import SparkSession

spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
spark = (
    SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
)
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in sys.argv[4:]:
    print("rows", name, entry.queries()[name](spark, sys.argv[3]).count(), flush=True)
"""


def rows_on_a_cluster(names: tuple[str, ...], sf_dir: str, tmp_path) -> dict[str, int]:  # noqa: ANN001
    """How many rows each query has on two executors, which work in a folder of their own; Spark's home is linked so that they can."""
    home = tempfile.mkdtemp(prefix="spark-")
    for name in os.listdir(where := os.path.dirname(pyspark.__file__)):
        if name != "work":
            os.symlink(os.path.join(where, name), os.path.join(home, name))
    program = tmp_path / "program.py"
    program.write_text(textwrap.dedent(PROGRAM))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_HOME": home, "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, str(program), f"{ROOT}/__spark_entry__.py", str(tmp_path), sf_dir, *names], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=400, check=False)
    found = {line.split()[1]: int(line.split()[2]) for line in run.stdout.splitlines() if line.startswith("rows ")}
    assert set(found) == set(names), run.stderr[-3000:]
    return found


def test_the_package_reaches_the_workers(sf_dir, tmp_path):
    assert all(rows_on_a_cluster(("q26_tree_similarity", "q42_json_map_shards", "q63_lint", "q71b_cells_with_spans"), sf_dir, tmp_path).values())
