"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session where it is unset (tests), a folder of our own, removed at the end.

    The session's setting is only read: it can't be changed while a session runs.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir names the folder that driver and executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _OWN:
        Path("/tmp/checkpoints").mkdir(exist_ok=True)
        _OWN[app] = tempfile.mkdtemp(prefix="leadloom-", dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path; all paths of an application lie in one folder, which can be removed when it has ended."""
    return f"{shared_dir(spark)}/leadloom-{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, which cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
