"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # call-site capture triples the round trips of building an expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_LOCAL_DIRS: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "assaykit", **conf: str) -> SparkSession:
    """A session with the defaults above; the cluster's own settings win when ``master`` is None."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, only a session that is one process on one machine (``local[..]``, as in tests)
    gets a folder of its own; ``local-cluster`` and every cluster must name one that all executors
    share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="assaykit-")
    return _LOCAL_DIRS[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing else writes there."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/assaykit/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Remove all work tables of this application, once no DataFrame that reads them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))
