"""Usage events and histories from a stream of files. Each micro-batch is merged into a table, so that nothing is too late and nothing counts twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlake.operators import ingest
from cohortlake.schemas import RAW, TABLES
from cohortlake.sources import idfilter
from cohortlake.sources.history import History

FILE, EVENTS = "__file", TABLES["feature_usage_events"]


def records(spark: SparkSession, raw: str, schema: StructType, *, files_at_once: int = 1000) -> DataFrame:
    """Lines of JSON as a stream of files, with the file that each is from."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(raw)
    return read.select(*schema.names, F.col("_metadata.file_path").alias(FILE))


def run_available(stream: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], object]) -> None:
    """Gives what is there to take(batch, number) and stops. The checkpoint remembers the files; a batch that was cut off comes again with its number."""
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_available(spark: SparkSession, raw: str, path: str, checkpoint: str, *, files_at_once: int = 1000) -> None:
    """Events of new files into the table at path, partitioned by their day; ids are those of a batch ingest of each file.

    Equal events of one file are told apart by their number. An event that is in several files, or in a file and the
    table already, is taken as often as the file has it that has it most often: whichever files come together, the
    table is the same. However old, and also without a time, events are taken. Only days in which the table may have
    some of them are read to compare with.
    """
    natural = RAW["feature_usage_events"].names

    def take(batch: DataFrame, number: int) -> None:
        events = ingest.typed_events(ingest.with_id_by_file(batch, natural, FILE)).select(*EVENTS.names)
        idfilter.append_noted(events, path, [c for c in EVENTS.names if c != "ingestion_timestamp"], "event_date", only_unseen=True)

    run_available(records(spark, raw, RAW["feature_usage_events"], files_at_once=files_at_once), checkpoint, take)


def history_available(spark: SparkSession, raw: str, schema: StructType, history: History, checkpoint: str, versions: Callable[[DataFrame], DataFrame], *, feed: str, tie_break: Sequence[str] = (), files_at_once: int = 1000) -> None:
    """New files' records into a history, by versions(records). Files in any order, and batches that come twice, give the history of all at once."""
    stream = records(spark, raw, schema, files_at_once=files_at_once)
    run_available(stream, checkpoint, lambda batch, number: history.merge_late(versions(batch.drop(FILE)), batch=(feed, number), tie_break=tie_break))


def daily_counts(events: DataFrame, *, late: str = "2 days") -> DataFrame:
    """Events by day and type, of a stream or a table; on a stream a day closes once the watermark has passed it."""
    marked = events.withWatermark("event_timestamp", late) if events.isStreaming else events
    return marked.groupBy(F.window("event_timestamp", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("event_date"), "event_type", "n")
