"""Raw records into the append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.columns import day, event_time, natural_id


#: Equal rows that one task lays out again.
RUN_ROWS = 100_000


def with_ingestion_timestamp(df: DataFrame) -> DataFrame:
    return df.withColumn("ingestion_timestamp", F.current_timestamp())


def with_stable_id(df: DataFrame, natural: Sequence[str], *, id_col: str = "event_id") -> DataFrame:
    """An id from the natural columns and, among equal rows, their number: the same file gets the same ids in every run.

    If the natural columns are all there are, equal rows can't be told apart: they are counted, which adds up
    before anything moves, and laid out again in runs of RUN_ROWS, so that one record repeated without end fills no
    task. With further columns, rows of one natural key are numbered by a window.
    """
    if set(natural) == set(df.columns):
        return _laid_out(df.groupBy(*natural).agg(F.count("*").alias("__rows")), natural, id_col).select(*df.columns, id_col)
    number = F.row_number().over(Window.partitionBy(*natural).orderBy(F.lit(0))).cast("long")
    return df.withColumn("__n", number).withColumn(id_col, F.xxhash64(natural_id(*natural), "__n")).drop("__n")


def with_id_by_file(df: DataFrame, natural: Sequence[str], file: str, *, id_col: str = "event_id") -> DataFrame:
    """Rows of several files with the ids that with_stable_id gives those of each alone: what several files have is taken as often as one of them has it."""
    of_file = df.groupBy(*natural, file).agg(F.count("*").alias("__rows"))
    return _laid_out(of_file.groupBy(*natural).agg(F.max("__rows").alias("__rows")), natural, id_col)


def _laid_out(counted: DataFrame, natural: Sequence[str], id_col: str) -> DataFrame:
    """Each natural row __rows times, numbered, in runs that one task lays out."""
    runs = counted.withColumn("__from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"), F.lit(RUN_ROWS).cast("long"))))
    runs = runs.withColumn("__to", F.least(F.col("__from") + (RUN_ROWS - 1), F.col("__rows"))).hint("rebalance")
    rows = runs.withColumn("__n", F.explode(F.sequence("__from", "__to")))
    return rows.select(*natural, F.xxhash64(natural_id(*natural), "__n").alias(id_col))


def feature_releases(raw: DataFrame) -> DataFrame:
    return with_ingestion_timestamp(raw.withColumnsRenamed({"id": "feature_id", "name": "feature_name"}))


def user_signups(raw: DataFrame) -> DataFrame:
    return with_ingestion_timestamp(raw)


def conversions(raw: DataFrame) -> DataFrame:
    return with_ingestion_timestamp(raw)


# fixed values: the table's columns in their order
EVENT_COLUMNS = ("event_id", "user_id", "feature_id", "feature_name", "event_type", "event_timestamp", "event_date", "ingestion_timestamp")


def typed_events(ids: DataFrame) -> DataFrame:
    """Events with their times; a timestamp that doesn't parse is null, and so is its date."""
    typed = ids.withColumn("event_timestamp", event_time("timestamp"))
    return with_ingestion_timestamp(typed.withColumn("event_date", day("event_timestamp"))).select(*EVENT_COLUMNS)


def feature_usage_events(raw: DataFrame) -> DataFrame:
    return typed_events(with_stable_id(raw, raw.columns))


def partitions_of(new: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The rows of table in the partitions that new has rows in, from those partitions' files alone. The driver holds new's values of the column."""
    values = [r[0] for r in new.select(column).distinct().collect()]
    found = F.col(column).isin([v for v in values if v is not None])
    return table.filter(found | F.col(column).isNull() if None in values else found)


def unseen(new: DataFrame, table: DataFrame, natural: Sequence[str]) -> DataFrame:
    """The rows of new whose natural columns aren't in the table yet, each once: what makes a re-run harmless."""
    key = natural_id(*natural)
    known = table.select(key.alias("__known_key"), *(F.col(c).alias(f"__known_{c}") for c in natural))
    # by the key first, then by the columns themselves: records whose hashes are equal by chance stay
    same = F.col("__key") == F.col("__known_key")
    for c in natural:
        same = same & F.col(c).eqNullSafe(F.col(f"__known_{c}"))
    # merged: a broadcast would send the table's records through the driver
    fresh = new.withColumn("__key", key).join(known.hint("merge"), same, "left_anti")
    return fresh.drop("__key").dropDuplicates([*natural])
