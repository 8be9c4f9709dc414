"""Raw JSON files with explicit schemas. Unknown fields are dropped and mistyped ones are null."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, schema: StructType, *, file_format: str = "json", options: Mapping[str, object] | None = None, corrupt: bool = False) -> DataFrame:
    """Any format Spark reads. With corrupt, a further column holds lines that don't parse."""
    wanted = StructType([*schema.fields]).add(CORRUPT, StringType()) if corrupt else schema
    reader = spark.read.format(file_format).schema(wanted).options(**dict(options or {}))
    return (reader.option("columnNameOfCorruptRecord", CORRUPT) if corrupt else reader).load(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return read_raw(spark, path, schema)


#: Bytes at the beginning of an array from which its layout is taken.
HEAD_BYTES = 1 << 16
#: Bytes up to which an array whose layout has no lines to cut at is read by one task.
MOST_IN_ONE_TASK = 128 << 20


def _head(spark: SparkSession, path: str) -> tuple[str, int]:
    """The beginning of the file, or of the largest file of a folder, and that file's size."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    largest = max((s for s in files.globStatus(at) for s in files.listStatus(s.getPath()) if s.isFile() and s.getPath().getName()[0] not in "._"), key=lambda s: s.getLen())
    stream = files.open(largest.getPath())
    try:
        bounded = spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD_BYTES)
        return spark._jvm.org.apache.commons.io.IOUtils.toString(bounded, "UTF-8"), largest.getLen()
    finally:
        stream.close()


def record_end(head: str) -> str | None:
    """What ends each record but the last of an array laid out in lines: a line's end, or a line of a brace with the records' indent; None for other layouts.

    A line end within a string is written as an escape, so that neither can be part of a value.
    """
    found = re.match(r"\s*\[[ \t]*\r?\n([ \t]*)\{", head)
    if found is None:
        return None
    indent, lines = found[1], head[found.end() - 1:].split("\n")
    if re.search(r"\}[ \t\r]*,?[ \t\r]*$", lines[0]):
        return "\n"
    return f"\n{indent}}}" if any(line.startswith(f"{indent}}}") for line in lines) else None


def read_json_array(spark: SparkSession, path: str, schema: StructType, *, most_in_one_task: int = MOST_IN_ONE_TASK) -> DataFrame:
    """Files that are one JSON array each.

    Where each record has lines of its own, records are cut there and any number of tasks read a file; a record that
    doesn't parse is then an error, while one with a value of another type has null for it, as elsewhere. Other layouts are read by one task for each file, and refused above
    most_in_one_task bytes: written as JSON lines, such data can be read by many.
    """
    head, size = _head(spark, path)
    end = record_end(head)
    if end is None:
        if size > most_in_one_task:
            raise ValueError(f"{path}: an array of {size} bytes without a line for each record is more than the {most_in_one_task} that one task reads")
        return read_raw(spark, path, schema, options={"multiLine": True})
    records = spark.read.option("lineSep", end).text(path)
    # a record begins and ends with a brace; before it are brackets, commas and spaces, and behind it where that isn't the cut
    record = F.regexp_replace("value", r"^[\s,\[\]]+", "")
    record = F.regexp_replace(record, r"[\s,\]]+$", "") if end == "\n" else F.when(record != "", F.concat(record, F.lit("\n}")))
    record = F.nullif(record, F.lit(""))
    broken = F.raise_error(F.concat(F.lit("a record of the array doesn't parse: "), F.substring(record, 1, 200)))
    parsed = F.when(record.isNotNull() & F.try_parse_json(record).isNull(), broken.cast(schema)).otherwise(F.from_json(record, schema))
    return records.select(parsed.alias("r")).filter("r IS NOT NULL").select("r.*")


def write_json_array(df: DataFrame, path: str) -> None:
    """A folder of files that are one JSON array each, with a line for each record: as many as df has partitions, of which a task holds a batch at a time."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comma = ""
        yield pa.RecordBatch.from_arrays([pa.array(["["], pa.string())], names=["value"])
        for batch in batches:
            records = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([(comma if i == 0 else ",") + r for i, r in enumerate(records)], pa.string())], names=["value"])
            comma = "," if records else comma
        yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(lines, "value string").write.text(path)
