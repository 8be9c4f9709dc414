"""Tables as folders of files. ``fmt`` is any format of Spark's; parquet unless stated.

An appended table is its folder's files. One that is replaced keeps each state in a folder of its own under ``_data``,
and a file under ``_snapshots`` says which folders hold: a new state counts from the moment its file takes its name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = "parquet"
SNAPSHOTS, DATA = "_snapshots", "_data"
#: States that are kept: the one that holds, and the one before it for those who still read that.
KEPT = 2
#: Parts whose names begin so hold rows that their writer needs and readers don't see.
ASIDE = "aside:"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    at, files = _path(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def _rename(files, source, target) -> None:
    """Hadoop's rename says by its result that it failed, and moves into a folder that is already there."""
    if files.exists(target) or not files.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


@dataclass(frozen=True)
class Snapshot:
    """One state of a table. parts: for each part of it (one, without a name, if it isn't divided) the folders that hold it; facts: what its writer kept with it."""

    number: int
    parts: dict[str, list[str]]
    schema: StructType
    facts: dict[str, object] = field(default_factory=dict)

    def folders(self, *parts: str) -> list[str]:
        """Of the parts named, or of all that readers see."""
        return [f for p in (parts or [p for p in self.parts if not p.startswith(ASIDE)]) for f in self.parts.get(p, [])]

    def held(self) -> set[str]:
        return {f for folders in self.parts.values() for f in folders}


def _snapshot_names(spark: SparkSession, path: str) -> list[str]:
    return [n for n in _names(spark, f"{path}/{SNAPSHOTS}") if n.endswith(".json") and n[0] != "."]


def _read_snapshot(spark: SparkSession, path: str, name: str) -> Snapshot:
    at, files = _path(spark, f"{path}/{SNAPSHOTS}/{name}")
    stream = files.open(at)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Snapshot(int(name.removesuffix(".json")), said["parts"], StructType.fromJson(said["schema"]), said["facts"])


def snapshot(spark: SparkSession, path: str) -> Snapshot | None:
    """The state that holds; None for a table that is its folder's files, or isn't there."""
    names = _snapshot_names(spark, path)
    return _read_snapshot(spark, path, names[-1]) if names else None


def _set_aside(spark: SparkSession, path: str) -> bool:
    """Whether the table was found aside, where an overwrite of an earlier release was cut off, and put back."""
    at, files = _path(spark, path.rstrip("/"))
    if files.exists(at) or at.getParent() is None or not files.exists(at.getParent()):
        return False
    aside = sorted(n for n in _names(spark, at.getParent().toString()) if n.startswith(f"{at.getName()}.old-"))
    if len(aside) != 1:
        return False
    _rename(files, spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), aside[0]), at)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    """Only a path that isn't there counts as absent, or a folder in which no state has been completed yet; any other failure is raised."""
    at, files = _path(spark, path)
    if not files.exists(at):
        return _set_aside(spark, path)
    if not files.getFileStatus(at).isDirectory():
        return True
    names = set(_names(spark, path))
    return any(n[0] != "_" or "=" in n or n == "_SUCCESS" for n in names) or not names or bool(_snapshot_names(spark, path))


def read(spark: SparkSession, path: str, schema: StructType | None = None, *, fmt: str = FORMAT, parts: Iterable[str] = ()) -> DataFrame:
    """With the schema, so that partition columns keep their type and place. parts: those of a divided table, all unless given."""
    now = snapshot(spark, path)
    if now is not None:
        schema, folders = schema or now.schema, [f"{path}/{f}" for f in now.folders(*parts)]
        return spark.read.format(fmt).schema(schema).load(folders).select(*schema.names) if folders else empty(spark, schema)
    _set_aside(spark, path)
    if schema is None:
        return spark.read.format(fmt).load(path)
    return spark.read.format(fmt).schema(schema).load(path).select(*schema.names)


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def _written(df: DataFrame, save, observed: Mapping[str, Column] | None = None) -> dict[str, object]:
    """Rows that save() wrote, and what else is to be observed, as they passed."""
    seen = Observation()
    save(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(name) for name, c in (observed or {}).items())))
    return seen.get


def append(df: DataFrame, path: str, *, partition_by: Iterable[str] = (), fmt: str = FORMAT) -> int:
    """Appends and returns the rows written, gathered by partition so that a task writes few files."""
    spark, by, table = df.sparkSession, list(partition_by), path.rstrip("/")
    now = snapshot(spark, table)
    if now is None:
        _set_aside(spark, table)
    elif len(now.folders()) != 1:
        raise ValueError(f"{path} is divided into parts: rows can't be appended to it as a whole")
    folder = f"{table}/{now.folders()[0]}" if now else table
    if by:
        # a hint that adaptive execution can split, so that one large day isn't one task
        df = df.hint("rebalance", *by)

    def save(x: DataFrame) -> None:
        writer = x.write.format(fmt).mode("append")
        (writer.partitionBy(*by) if by else writer).save(folder)

    rows = _written(df, save)["rows"]
    if now is not None:  # what was observed of the rows before doesn't hold for all any more
        publish(spark, table, now, now.parts, now.schema, {k: v for k, v in now.facts.items() if k != "observed"})
    return rows


def partition_marks(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Files and bytes of each partition folder of an appended table: a partition whose mark is as before has nothing new."""
    at, files = _path(spark, path)
    marks = {}
    for name in _names(spark, path) if files.exists(at) else []:
        if "=" in name:
            size = files.getContentSummary(spark._jvm.org.apache.hadoop.fs.Path(at, name))
            marks[name] = [size.getFileCount(), size.getLength()]
    return marks


def write_folder(df: DataFrame, path: str, after: Snapshot | None, *, partition_by: Iterable[str] = (), fmt: str = FORMAT, observed: Mapping[str, Column] | None = None) -> tuple[str, dict[str, object]]:
    """Writes df for the state that is to follow, where no reader looks yet: the folder's name and what was observed."""
    by, folder = list(partition_by), f"{DATA}/{(after.number if after else 0) + 1:020d}-{uuid.uuid4().hex}"

    def save(x: DataFrame) -> None:
        writer = x.write.format(fmt).mode("error")
        (writer.partitionBy(*by) if by else writer).save(f"{path}/{folder}")

    return folder, _written(df, save, observed)


def publish(spark: SparkSession, path: str, after: Snapshot | None, parts: Mapping[str, list[str]], schema: StructType, facts: Mapping[str, object]) -> Snapshot:
    """The state of these parts, in one step. Fails, and changes nothing, if another writer followed ``after`` first."""
    new = Snapshot((after.number if after else 0) + 1, {p: list(f) for p, f in parts.items() if f}, schema, dict(facts))
    temporary, files = _path(spark, f"{path}/{SNAPSHOTS}/.{uuid.uuid4().hex}")
    target, _ = _path(spark, f"{path}/{SNAPSHOTS}/{new.number:020d}.json")
    files.mkdirs(target.getParent())
    stream = files.create(temporary, False)
    try:
        stream.write(bytearray(json.dumps({"parts": new.parts, "schema": schema.jsonValue(), "facts": new.facts}, default=str).encode()))
    finally:
        stream.close()
    try:
        _rename(files, temporary, target)
    except OSError:
        files.delete(temporary, False)
        raise
    return new


def tidy(spark: SparkSession, path: str) -> None:
    """Deletes what no kept state holds: older states' folders, those of writers that were cut off, and files from before there were states.

    Folders for a state that is still to come stay: somebody may be writing them.
    """
    names = _snapshot_names(spark, path)
    kept = [_read_snapshot(spark, path, n) for n in names[-KEPT:]]
    held = set().union(*(s.held() for s in kept))
    gone = sorted({f for n in names[:-KEPT] for f in _read_snapshot(spark, path, n).held()} - held)
    gone += [f"{DATA}/{n}" for n in _names(spark, f"{path}/{DATA}") if int(n.split("-")[0]) <= kept[-1].number and not any(f.split("/")[1] == n for f in held)]
    gone += [f"{SNAPSHOTS}/{n}" for n in names[:-KEPT]] + [n for n in _names(spark, path) if n[0] != "_" or "=" in n or n == "_SUCCESS"]
    for name in gone:
        at, files = _path(spark, f"{path}/{name}")
        files.delete(at, True)


def overwrite(df: DataFrame, path: str, *, partition_by: Iterable[str] = (), replace_schema: bool = False, fmt: str = FORMAT, observed: Mapping[str, Column] | None = None, facts: Mapping[str, object] | None = None) -> int:
    """Replaces the table and returns the rows written. df may read the table it replaces.

    Wherever it is cut off, the table is the old one or the new one, whole. What is observed is kept with the new
    state, and so are facts. Without replace_schema, columns have to be those that the table has.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    now = snapshot(spark, path)
    if now is None:
        _set_aside(spark, path)
    elif not replace_schema and (was := {f.name: f.dataType for f in now.schema}) != (new := {f.name: f.dataType for f in df.schema}):
        raise ValueError(f"{path} has other columns: {sorted(set(map(str, was.items())) ^ set(map(str, new.items())))}")
    folder, seen = write_folder(df, path, now, partition_by=partition_by, fmt=fmt, observed=observed)
    publish(spark, path, now, {"": [folder]}, df.schema, {"observed": seen, **(facts or {})})
    tidy(spark, path)
    return seen["rows"]
