"""Which records a table surely lacks: blocked bit filters of its partitions' records, beside the table.

A record's hash says in which block of 512 bits of its partition it is noted, by one bit in each of eight words. All
eight set, the table may have it, and an exact comparison follows; else it can't. Every append adds a generation of
blocks for the partitions it touches, sized by its records, and is looked up with all others of the partition. Notes
are written before the records: one without a record costs a comparison, a record without a note would be taken twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.columns import natural_id
from cohortlake.operators.ingest import partitions_of, unseen
from cohortlake.sources import tables

FOLDER = "_ids"
WORDS = 8
#: Records of a block: 32 bits each, so that one in some hundred thousand that a partition lacks is compared.
RECORDS = 16
_WORDS = [f"w{i}" for i in range(WORDS)]


def _bits(key: str) -> list[Column]:
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 58).cast("int")) for i in range(WORDS)]


def _keyed(df: DataFrame, natural: Sequence[str], partition: str) -> DataFrame:
    return df.select(natural_id(*natural).alias("key"), F.col(partition).cast("string").alias("part"))


def note(new: DataFrame, path: str, natural: Sequence[str], partition: str) -> None:
    """Notes the records that are about to be appended. The driver holds how many each partition gets."""
    keyed = _keyed(new, natural, partition)
    sizes = [(r["part"], -(-r["count"] // RECORDS)) for r in keyed.groupBy("part").count().collect()]
    if not sizes:
        return
    sized = F.broadcast(new.sparkSession.createDataFrame(sizes, "other string, n_blocks long"))  # a row for each partition of the batch
    placed = keyed.join(sized, F.col("part").eqNullSafe(F.col("other"))).withColumn("block", F.pmod(F.col("key"), F.col("n_blocks")))
    blocks = placed.groupBy("part", "n_blocks", "block").agg(*(F.bit_or(b).alias(w) for b, w in zip(_bits("key"), _WORDS, strict=True)))
    blocks.withColumn("generation", F.lit(uuid.uuid4().hex)).write.mode("append").parquet(f"{path}/{FOLDER}")


def _noted(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(f"{path}/{FOLDER}") if tables.exists(spark, f"{path}/{FOLDER}") else None


def marked(new: DataFrame, noted: DataFrame, natural: Sequence[str], partition: str) -> DataFrame:
    """new with __maybe: whether the table may have the record.

    Notes and hits grow with the records, so that they are merged: broadcasts would send them through the driver with every batch.
    """
    keyed = new.withColumns({"__key": natural_id(*natural), "__part": F.col(partition).cast("string")})
    sized = noted.select(F.col("part").alias("__of"), "generation", "n_blocks").distinct()
    asked = keyed.select("__key", "__part").distinct().join(sized, F.col("__part").eqNullSafe(F.col("__of"))).withColumn("__block", F.pmod(F.col("__key"), F.col("n_blocks")))
    found = asked.join(noted.drop("n_blocks").withColumnsRenamed({"generation": "__generation", "block": "__b"}).hint("merge"),
                       F.col("__part").eqNullSafe(F.col("part")) & (F.col("generation") == F.col("__generation")) & (F.col("__block") == F.col("__b")))
    for bit, w in zip(_bits("__key"), _WORDS, strict=True):
        found = found.filter(F.col(w).bitwiseAND(bit) != 0)
    hits = found.select(F.col("__key").alias("__hit"), F.col("__part").alias("__in")).distinct().withColumn("__maybe", F.lit(True))
    joined = keyed.join(hits.hint("merge"), (F.col("__key") == F.col("__hit")) & F.col("__part").eqNullSafe(F.col("__in")), "left")
    return joined.select(*new.columns, F.coalesce("__maybe", F.lit(False)).alias("__maybe"))


def unseen_records(new: DataFrame, table: DataFrame, path: str, natural: Sequence[str], partition: str, *, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """ingest.unseen(new, table, natural), which reads of the table the partitions of those records alone that the filter can't rule out.

    Appends have to note their records; a table whose appends haven't so far is noted as a whole. Marked records are
    used several times: keep can persist them.
    """
    noted = _noted(new.sparkSession, path)
    if noted is None:
        note(table, path, natural, partition)
        noted = _noted(new.sparkSession, path)
    if noted is None:  # of no records
        return unseen(new, table.limit(0), natural)
    both = keep(marked(new, noted, natural, partition))
    maybe = both.filter("__maybe").drop("__maybe")
    sure = both.filter("NOT __maybe").drop("__maybe").dropDuplicates([*natural])
    return sure.unionByName(unseen(maybe, partitions_of(maybe, table, partition), natural))


def append_noted(new: DataFrame, path: str, natural: Sequence[str], partition: str, *, only_unseen: bool, fmt: str = tables.FORMAT) -> int:
    """Appends new, or with only_unseen those of its records that the table at path lacks, and notes them; the rows written."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist())
        return kept[-1]

    try:
        if only_unseen and tables.exists(new.sparkSession, path):
            new = unseen_records(new, tables.read(new.sparkSession, path, new.schema, fmt=fmt), path, natural, partition, keep=keep)
        new = keep(new)  # once for the notes, once for the table
        if only_unseen or _noted(new.sparkSession, path) is not None:
            note(new, path, natural, partition)
        return tables.append(new, path, partition_by=[partition], fmt=fmt)
    finally:
        for df in kept:
            df.unpersist()
