"""Folders for what a query writes on its way."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one in local mode when it is unset."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_root is None or not os.path.isdir(_own_root):
        _own_root = tempfile.mkdtemp(prefix="cohortlake-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def fresh_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/cohortlake/{what}-{uuid.uuid4().hex}"
