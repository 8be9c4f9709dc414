"""A Type 2 history on disk, laid out so that a batch rewrites what it changes.

Rows lie in buckets by a hash of the key, current and closed ones apart. A batch finds the buckets in which it changes
something, reads their current rows, and writes these anew; rows that it closes are added to their bucket's closed
ones, which no batch rewrites. Which folders hold a bucket is said by the table's snapshot, so a batch counts as a whole
or not at all, and the number of the last batch of a feed is kept with it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortlake.operators import scd2
from cohortlake.sources import tables

CURRENT, CLOSED, REPEATED = "current", "closed", "repeated"
STATE, BUCKET = "__state", "__bucket"
#: Folders of a bucket's closed rows after which the next batch that changes the bucket puts them into one.
MOST_FOLDERS = 16


def _folder(state: str, bucket: int) -> str:
    return f"{STATE}={state}/{BUCKET}={bucket}"


def _part(state: str, bucket: int) -> str:
    return (tables.ASIDE if state == REPEATED else "") + _folder(state, bucket)


@dataclass(frozen=True)
class History:
    """A history at path. With n_buckets well above the keys of a usual batch, few buckets hold any of them."""

    spark: SparkSession
    path: str
    key: str
    schema: StructType
    n_buckets: int = 256
    fmt: str = tables.FORMAT

    def bucket(self) -> Column:
        """A null key has a bucket like any other."""
        return F.pmod(F.hash(self.key), F.lit(self.n_buckets))

    def read(self) -> DataFrame:
        return tables.read(self.spark, self.path, self.schema, fmt=self.fmt)

    def current(self) -> DataFrame:
        """From the files of current rows alone."""
        return self._rows(CURRENT, range(self.n_buckets))

    def _rows(self, state: str, buckets: Iterable[int]) -> DataFrame:
        now = tables.snapshot(self.spark, self.path)
        named = [p for b in buckets if now and (p := _part(state, b)) in now.parts]
        return tables.read(self.spark, self.path, self.schema, fmt=self.fmt, parts=named) if named else tables.empty(self.spark, self.schema)

    def last_batch(self, feed: str) -> int | None:
        """The number of the last batch of a feed that is in the history."""
        now = tables.snapshot(self.spark, self.path)
        return now.facts["batches"].get(feed) if now else None

    def _seen(self, batch: tuple[str, int] | None) -> bool:
        return batch is not None and (last := self.last_batch(batch[0])) is not None and batch[1] <= last

    def _touched(self, rows: DataFrame) -> list[int]:
        """Buckets of rows: n_buckets numbers at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def _write(self, rows: DataFrame, replaced: Iterable[tuple[str, int]], batch: tuple[str, int] | None) -> int:
        """Publishes a state in which rows take the place of the parts replaced and are added to the others."""
        now = tables.snapshot(self.spark, self.path)
        parts = {} if now is None else {p: list(f) for p, f in now.parts.items()}
        for state, bucket in replaced:
            parts.pop(_part(state, bucket), None)
        batches = dict(now.facts["batches"]) if now else {}
        if batch is not None:
            batches[batch[0]] = batch[1]
        state = F.when(F.col("is_current"), CURRENT).otherwise(CLOSED)
        state = F.when(F.col("repeats"), REPEATED).otherwise(state) if "repeats" in rows.columns else state
        laid = rows.select(*self.schema.names, state.alias(STATE), self.bucket().alias(BUCKET))
        # a hint that gathers a bucket's rows and that adaptive execution can split where they are many
        laid = laid.hint("rebalance", STATE, BUCKET)
        folder, seen = tables.write_folder(laid, self.path, now, partition_by=[STATE, BUCKET], fmt=self.fmt, observed={"parts": F.collect_set(F.struct(STATE, BUCKET))})
        for state, bucket in seen["parts"]:
            name = _part(state, bucket)
            parts[name] = [*parts.get(name, []), f"{folder}/{_folder(state, bucket)}"]
        tables.publish(self.spark, self.path, now, parts, self.schema, {"batches": batches, "n_buckets": self.n_buckets})
        tables.tidy(self.spark, self.path)
        return seen["rows"]

    def create(self, rows: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """The history of these rows, in place of what there was; the rows written."""
        return self._write(rows, [(s, b) for s in (CURRENT, CLOSED, REPEATED) for b in range(self.n_buckets)], batch)

    def _checked(self) -> None:
        now = tables.snapshot(self.spark, self.path)
        if now is not None and now.facts["n_buckets"] != self.n_buckets:
            raise ValueError(f"{self.path} has {now.facts['n_buckets']} buckets")

    def merge(self, incoming: DataFrame, *, batch: tuple[str, int] | None = None) -> int:
        """scd2.apply of a batch of versions to the history on disk; the rows written, 0 if it changes nothing.

        batch names the feed and the batch's number in it: one that is in the history already does nothing. Late
        versions are left out, as by apply; merge_late takes them in.
        """
        self._checked()
        if self._seen(batch):
            return 0
        asked = self._touched(incoming)
        before = self._rows(CURRENT, asked)
        # keys whose last version was ended have closed rows alone, and stay as they are
        wanted = incoming.select(self.key).distinct()
        same = F.col(self.key).eqNullSafe(F.col("__other"))
        with_key = lambda rows: rows.select(F.col(self.key).alias("__other")).distinct()
        ended = wanted.join(with_key(self._rows(CLOSED, asked)), same, "left_semi").join(with_key(before), same, "left_anti")
        incoming = incoming.join(ended.select(F.col(self.key).alias("__other")), same, "left_anti")
        now = before.select(F.col(self.key).alias("__other"), F.col("effective_from").alias("__from"), F.col("record_hash").alias("__hash"))
        newer = incoming.join(now, same, "left").filter("__from IS NULL OR effective_from > __from AND NOT (record_hash <=> __hash)")
        # a version equal to the current one can still follow one that differs: its key is among these through that one
        touched = self._touched(newer)
        if not touched:
            return self._note(batch)
        rows = scd2.apply(self._rows(CURRENT, touched), incoming.filter(self.bucket().isin(touched)), self.key)
        return self._write(*self._compacted(rows, touched), batch)

    def _compacted(self, rows: DataFrame, touched: list[int]) -> tuple[DataFrame, list[tuple[str, int]]]:
        """rows, and the parts that they replace: closed ones too where they lie in many folders."""
        now = tables.snapshot(self.spark, self.path)
        many = [b for b in touched if now and len(now.parts.get(_part(CLOSED, b), [])) >= MOST_FOLDERS]
        if many:
            rows = rows.unionByName(self._rows(CLOSED, many))
        return rows, [(CURRENT, b) for b in touched] + [(CLOSED, b) for b in many]

    def _note(self, batch: tuple[str, int] | None) -> int:
        """Notes a batch that changes nothing."""
        now = tables.snapshot(self.spark, self.path)
        if batch is not None:
            facts = {"n_buckets": self.n_buckets, **(now.facts if now else {})}
            tables.publish(self.spark, self.path, now, now.parts if now else {}, self.schema, facts | {"batches": {**(now.facts["batches"] if now else {}), batch[0]: batch[1]}})
            tables.tidy(self.spark, self.path)
        return 0

    def merge_late(self, incoming: DataFrame, *, batch: tuple[str, int] | None = None, tie_break: Iterable[str] = ()) -> int:
        """A batch whose versions can be late: batches in any order give the history of all at once (scd2.replayed). The rows written.

        All rows of the batch's buckets are written anew. Versions that repeat the one before them are kept aside,
        since a late one can still come between. A history that merge has written lacks those; use one of both.
        """
        self._checked()
        if self._seen(batch):
            return 0
        touched = self._touched(incoming)
        if not touched:
            return self._note(batch)
        states = (CURRENT, CLOSED, REPEATED)
        before = [self._rows(s, touched).withColumn("repeats", F.lit(s == REPEATED)) for s in states]
        before = before[0].unionByName(before[1]).unionByName(before[2])
        keys, same = incoming.select(F.col(self.key).alias("__other")).distinct(), F.col(self.key).eqNullSafe(F.col("__other"))
        columns = [c for c in self.schema.names if c not in scd2.ADDED or c in ("effective_from", "record_hash")]
        known = before.join(keys, same, "left_semi").select(*columns).unionByName(incoming.select(*columns))
        rows = scd2.replayed(known, self.key, tie_break=list(tie_break)).select(*self.schema.names, "repeats")
        return self._write(rows.unionByName(before.join(keys, same, "left_anti")), [(s, b) for s in states for b in touched], batch)
