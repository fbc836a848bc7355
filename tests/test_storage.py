"""The shared folder in sessions with and without the setting."""

from __future__ import annotations

import subprocess
import sys

CODE = """
import sys
from pyspark.sql import SparkSession
from leadloom.storage import materialize, shared_dir
b = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
spark = (b.config("spark.checkpoint.dir", sys.argv[1]) if len(sys.argv) > 1 else b).getOrCreate()
first = shared_dir(spark)
assert materialize(spark.range(3), "x").count() == 3
assert shared_dir(spark) == first
print("FOLDER", first, spark.conf.get("spark.checkpoint.dir", None))
"""


def folder(tmp_path, *args) -> list[str]:
    env = {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ":".join(p or "." for p in sys.path), "PATH": "/usr/local/bin:/usr/bin:/bin"}
    import os

    env |= {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "HOME"))} | {"PATH": os.environ["PATH"]}
    out = subprocess.run([sys.executable, "-c", CODE, *args], capture_output=True, text=True, timeout=180, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    return next(line for line in out.stdout.splitlines() if line.startswith("FOLDER")).split()[1:]


def test_own_folder_where_none_is_set(tmp_path):
    at, setting = folder(tmp_path)
    assert at.startswith("/tmp/checkpoints/") and setting == "None"


def test_the_setting_is_used(tmp_path):
    at, setting = folder(tmp_path, str(tmp_path / "shared"))
    assert at == setting == str(tmp_path / "shared")
