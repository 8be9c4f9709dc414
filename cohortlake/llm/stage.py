"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortlake.workdir import shared_root

class Scratch:
    """Tables written by one operator call, under a folder of their own.

    ``keep`` writes a DataFrame and reads it back, which cuts its lineage: a lost executor costs
    a read of the table, not a recomputation. ``drop`` frees a table that no later step reads; the folder goes
    when the driver ends, since results are read from it until then.
    """

    def __init__(self, spark: SparkSession, what: str):
        prepare(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/cohortlake/{what}-{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables, and has the driver collect its garbage: only then does Spark delete the shuffle files of finished writes."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.spark._jvm.System.gc()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the Python worker gives free memory back: workers live on from stage to stage beside each other and the JVM."""

    def run_tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return run_tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


#: Rows of an Arrow batch where the session has Spark's default of 10,000: whole texts can be long.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Sends this package's source to the executors' Python workers and bounds Arrow's batches, once for each SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_cohortlake_prepared", False):
        return
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="cohortlake-src-")) / f"{package.name}_src.zip"
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._cohortlake_prepared = True
