"""Gates around tables: schema, presence, size, keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from cohortlake.sources import tables
from cohortlake.sources.raw import CORRUPT, read_raw


class SchemaValidationError(Exception):
    """Columns are missing or of another type."""


class DataValidationError(Exception):
    """A table is absent, too small, or holds bad rows."""


def check_schema(df: DataFrame, expected: StructType, table: str) -> None:
    """Every expected column is there with its type; more columns and nullability don't matter. No job runs."""
    found = {f.name: f.dataType for f in df.schema.fields}
    if missing := sorted({f.name for f in expected.fields} - found.keys()):
        raise SchemaValidationError(f"{table}: Missing columns: {', '.join(missing)}")
    if wrong := [f"{f.name} is {found[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in expected.fields if found[f.name] != f.dataType]:
        raise SchemaValidationError(f"{table}: type mismatch: {'; '.join(wrong)}")


def observed(keys: Sequence[str]) -> dict[str, Column]:
    """What tables.overwrite is to observe for check_table to know of the keys without reading."""
    return {"null_keys": F.coalesce(F.count_if(_any_null(keys)), F.lit(0))} if keys else {}


def check_table(spark: SparkSession, path: str, expected: StructType, table: str, *, min_rows: int = 1, keys: Sequence[str] = (), partition_by: Sequence[str] = (), fmt: str = tables.FORMAT) -> int:
    """Rows of a table that exists, has the schema and at least min_rows; with keys, that they are neither null nor repeated.

    The values of partition columns are text in folder names; a column in partition_by that is to be a string is one whatever its values look like.
    What was observed as the table was written isn't read again: without keys nothing is read then, and with them the
    key columns alone, to find repeated ones.
    """
    if not tables.exists(spark, path):
        raise DataValidationError(f"{table}: not found at {path}")
    now = tables.snapshot(spark, path)
    try:
        # without the expected schema, so that it is the files' own that is checked
        found = tables.read(spark, path, fmt=fmt)
        text = [f.name for f in expected.fields if f.name in partition_by and isinstance(f.dataType, StringType) and f.name in found.columns]
        check_schema(found.withColumns({c: F.col(c).cast("string") for c in text}), expected, table)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        raise DataValidationError(f"{table}: no files at {path}") from e
    seen = now.facts.get("observed", {}) if now else {}
    df, rows = tables.read(spark, path, expected, fmt=fmt), seen.get("rows")
    if keys:
        if seen.get("null_keys"):  # without a look for repeated ones
            raise DataValidationError(f"{table}: {seen['null_keys']} null keys in {', '.join(keys)}")
        counted = null_and_duplicate_keys(df.select(*keys), keys).first()
        rows = counted["n_rows"]
        if counted["n_null_keys"] or counted["n_duplicate_keys"]:
            raise DataValidationError(f"{table}: {counted['n_null_keys']} null and {counted['n_duplicate_keys']} duplicate keys in {', '.join(keys)}")
    if rows is None:
        rows = df.count()
    if rows < min_rows:
        raise DataValidationError(f"{table}: has {rows} rows, expected at least {min_rows} rows")
    return rows


def check_raw(spark: SparkSession, path: str, expected: StructType, table: str, *, file_format: str = "json", options: Mapping[str, object] | None = None, max_corrupt: int | None = None) -> int:
    """Records of a raw file that is there and not empty; with max_corrupt, that no more of them fail to parse."""
    if not tables.exists(spark, path):
        raise DataValidationError(f"{table}: not found at {path}")
    df = read_raw(spark, path, expected, file_format=file_format, options=options, corrupt=file_format == "json")
    check_schema(df, expected, table)
    # a file that has no bytes has no records; the corrupt column alone can't be asked for
    rows, bad = df.agg(F.count("*"), F.count_if(F.col(CORRUPT).isNotNull()) if CORRUPT in df.columns else F.lit(0), *(F.count(f.name) for f in expected.fields[:1])).first()[:2]
    if not rows:
        raise DataValidationError(f"{table}: {path} is empty")
    if max_corrupt is not None and bad > max_corrupt:
        raise DataValidationError(f"{table}: {bad} of {rows} records don't parse")
    return rows


def _any_null(keys: Sequence[str]) -> Column:
    null = F.lit(False)
    for c in keys:
        null = null | F.col(c).isNull()
    return null


def null_and_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, rows with a null in the key, and rows beyond the first of their key (null keys aside)."""
    each = df.groupBy(*keys).agg(F.count("*").alias("__n")).withColumn("__null", _any_null(keys))
    return each.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("__null"), F.col("__n"))), F.lit(0)).alias("n_null_keys"),
                    F.coalesce(F.sum(F.when(~F.col("__null"), F.col("__n") - 1)), F.lit(0)).alias("n_duplicate_keys"))
