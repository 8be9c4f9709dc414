"""Type 2 history: one row for each version of a key, valid from its start up to the next one's.

Columns of a history: the key, the payload, is_enabled, effective_from, effective_to (9999-12-31 for
the version that still holds), is_current, record_hash. Every window here is partitioned by the key,
so a batch is shuffled once.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from cohortlake.functions.columns import record_hash
from cohortlake.schemas import END_OF_TIME

ADDED = ("is_enabled", "effective_from", "effective_to", "is_current", "record_hash")


def versions(df: DataFrame, key: str, start: Column, tracked: Sequence[str], *, payload: Sequence[str] | None = None, tie_break: Sequence[str] = ()) -> DataFrame:
    """Key, payload (the tracked columns unless given), effective_from and record_hash; the last row by tie_break of each key and day.

    Rows whose start is null can't be placed in time and are left out.
    """
    payload = list(payload if payload is not None else tracked)
    ties = [c for c in tie_break if c not in payload and c != key]
    rows = df.withColumns({"effective_from": start, "record_hash": record_hash(*tracked)}).select(key, *payload, *ties, "effective_from", "record_hash").filter("effective_from IS NOT NULL")
    in_time = Window.partitionBy(key).orderBy("effective_from", *(F.col(c).asc_nulls_first() for c in tie_break), "record_hash")
    last_of_day = ~F.lead("effective_from").over(in_time).eqNullSafe(F.col("effective_from"))
    return rows.withColumn("__last", last_of_day).filter("__last").select(key, *payload, "effective_from", "record_hash")


def _in_time(key: str):
    return Window.partitionBy(key).orderBy("effective_from")


def _chained(found: DataFrame, key: str) -> DataFrame:
    """Each version ends where the key's next one begins."""
    following = F.lead("effective_from").over(_in_time(key))
    payload = [c for c in found.columns if c not in ("effective_from", "record_hash")]
    return found.withColumn("__next", following).select(
        *payload, F.lit(True).alias("is_enabled"), "effective_from", F.coalesce("__next", F.lit(END_OF_TIME)).alias("effective_to"), F.col("__next").isNull().alias("is_current"), "record_hash")


def _changed(found: DataFrame, key: str, before: Column | None = None) -> DataFrame:
    """Without versions equal to the one before them (for a key's first: to ``before``)."""
    previous = F.lag("record_hash").over(_in_time(key))
    previous = F.coalesce(previous, before) if before is not None else previous
    return found.withColumn("__previous", previous).filter("NOT (record_hash <=> __previous)").drop("__previous")


def initial(df: DataFrame, key: str, start: Column, tracked: Sequence[str], *, payload: Sequence[str] | None = None, tie_break: Sequence[str] = (), collapse_unchanged: bool = False) -> DataFrame:
    """The history of all rows of df."""
    found = versions(df, key, start, tracked, payload=payload, tie_break=tie_break)
    return _chained(_changed(found, key) if collapse_unchanged else found, key)


def current(history: DataFrame) -> DataFrame:
    return history.filter("is_current")


def as_of(history: DataFrame, date: datetime.date | Column) -> DataFrame:
    """Versions valid on a date: from their start, up to but not on their end."""
    at = date if isinstance(date, Column) else F.lit(date)
    return history.filter((F.col("effective_from") <= at) & (F.col("effective_to") > at) & F.col("is_enabled"))


def ordered(history: DataFrame, key: str) -> DataFrame:
    return history.orderBy(key, "effective_from")


def _version_at(points: DataFrame, begun: DataFrame) -> DataFrame:
    """points (__key, __at) with __version, the last one begun: one pass over both in the order of time.

    Of days, a key has no more than a calendar. Of times it can have any number: its time is then cut into days, so
    that it isn't one task's, and what a day begins with is carried over from those before it, by a pass over a row for each.
    """
    by = ["__key"]
    carried = None
    if not isinstance(points.schema["__at"].dataType, DateType):
        by, day = ["__key", "__slice"], F.to_date("__at")
        points, begun = points.withColumn("__slice", day), begun.withColumn("__slice", day)
        ends = begun.groupBy(*by).agg(F.max_by("__version", F.struct("__at", "__version.effective_to")).alias("__version"))
        slices = points.select(*by).distinct().unionByName(ends, allowMissingColumns=True).groupBy(*by).agg(F.first("__version", ignorenulls=True).alias("__version"))
        before = Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select(*by, F.last("__version", ignorenulls=True).over(before).alias("__version")).filter("__version IS NOT NULL")
    both = points.withColumn("__asked", F.lit(True)).unionByName(begun, allowMissingColumns=True)
    both = both if carried is None else both.unionByName(carried, allowMissingColumns=True)
    # what is carried over has no time and comes first; at one time, versions come before what is asked, and the one that goes on comes last
    in_time = Window.partitionBy(*by).orderBy(F.asc_nulls_first("__at"), F.asc_nulls_first("__asked"), "__version.effective_to").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__version", F.last("__version", ignorenulls=True).over(in_time)).filter("__asked").select("__key", "__at", "__version")


def as_of_join(facts: DataFrame, history: DataFrame, key: str, date: Column, *, history_key: str | None = None, how: str = "inner") -> DataFrame:
    """Facts with the version of their key valid on their date; ``how`` is inner or left.

    All facts of a key and a date have one version. So versions are looked up for distinct keys and dates alone, which
    any number of facts of one key hardly adds to, and facts are joined to what was found by both: a join that adaptive
    execution can split. Where versions begin on days, times of facts count as their days. A fact without a key or
    date has no version, and takes no part in the join.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    of_key = history_key or key
    payload = [c for c in history.columns if c != of_key]
    kind = history.schema["effective_from"].dataType
    lines = facts.withColumns({"__key": F.col(key), "__at": date.cast(kind)})
    known = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    begun = history.filter(F.col(of_key).isNotNull() & F.col("effective_from").isNotNull()).select(F.col(of_key).alias("__key"), F.col("effective_from").alias("__at"), F.struct(*payload).alias("__version"))
    found = _version_at(lines.filter(known).select("__key", "__at").distinct(), begun).filter(F.col("__version.effective_to") > F.col("__at"))
    joined = lines.filter(known).join(found, ["__key", "__at"], how)
    if how == "left":
        joined = joined.unionByName(lines.filter(~known), allowMissingColumns=True)
    return joined.select(*facts.columns, *(F.col(f"__version.{c}").alias(c) for c in payload))


def _against(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """incoming (as versions gives it) with the start and hash of its key's current version."""
    now = current(history).select(key, F.col("effective_from").alias("__from"), F.col("record_hash").alias("__hash"))
    return incoming.join(now, key, "left")


def changes(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming versions newer than their key's current one that differ from the version before them."""
    newer = _against(history, incoming, key).filter("__from IS NOT NULL AND effective_from > __from")
    return _changed(newer, key, F.col("__hash")).drop("__from", "__hash")


def new_keys(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming versions of keys that the whole history doesn't have, without repeats of the version before."""
    return _changed(incoming.join(history.select(key), key, "left_anti"), key)


def late(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming versions not newer than their key's current one and not yet in its history. apply leaves them out."""
    older = _against(history, incoming, key).filter("__from IS NOT NULL AND effective_from <= __from").drop("__from", "__hash")
    return older.join(history.select(key, "effective_from", "record_hash"), [key, "effective_from", "record_hash"], "left_anti")


def stage(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """What a batch does to a history, with merge_key: the key for the current row to be closed, null for a row to be added.

    Several new versions of one key are chained; the first of them closes the current one. A row without a key is
    added, and closes none.
    """
    done = _continued(history, incoming, key)
    closed = ~F.col("__new") & F.col("__chain") & F.col("__next").isNotNull() & F.col(key).isNotNull()
    return done.filter(F.col("__new") | closed).select(F.when(~F.col("__new"), F.col(key)).alias("merge_key"), *history.columns)


def apply_staged(history: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """The history with the staged rows merged in. A key staged twice for closing is an error."""
    one = F.when(F.count("*") > 1, F.raise_error(F.lit("a current row is closed twice"))).otherwise(F.min("effective_to"))
    closes = staged.filter("merge_key IS NOT NULL").groupBy(F.col("merge_key").alias(key)).agg(one.cast("date").alias("__closes"))
    closing = F.col("is_current") & F.col("__closes").isNotNull()
    kept = history.join(closes, key, "left").withColumns({"effective_to": F.when(closing, F.col("__closes")).otherwise(F.col("effective_to")), "is_current": F.col("is_current") & ~closing})
    return kept.select(*history.columns).unionByName(staged.filter("merge_key IS NULL").select(*history.columns))


def _continued(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """History and batch in one pass: they meet once, by the key, and every window below goes by the same key.

    Columns of the history with __new, __chain (the row is part of the chain that goes on) and __next (its end there).
    """
    payload = [c for c in history.columns if c not in ADDED and c != key]
    both = history.withColumn("__new", F.lit(False)).unionByName(incoming.select(key, *payload, "effective_from", "record_hash").withColumn("__new", F.lit(True)), allowMissingColumns=True)
    of_key = Window.partitionBy(key)
    known = both.withColumns({"__from": F.max(F.when(~F.col("__new") & F.col("is_current"), F.col("effective_from"))).over(of_key), "__known": F.max(~F.col("__new")).over(of_key)})
    # the current version and the batch's newer ones form the chain that is to be continued; other rows of the history stay as they are
    takes = F.when(F.col("__new"), ~F.col("__known") | F.coalesce(F.col("effective_from") > F.col("__from"), F.lit(False))).otherwise(F.col("is_current"))
    chain = known.withColumn("__chain", takes).filter("__chain OR NOT __new")
    in_time = Window.partitionBy(key, "__chain").orderBy("effective_from", "__new")
    changed = ~F.col("record_hash").eqNullSafe(F.lag("record_hash").over(in_time))
    kept = chain.withColumn("__kept", ~F.col("__new") | changed).filter("__kept")
    following = F.when(F.col("__chain"), F.lead("effective_from").over(in_time))
    return kept.withColumn("__next", following).withColumns({
        "is_enabled": F.coalesce("is_enabled", F.lit(True)),
        "effective_to": F.coalesce("__next", "effective_to", F.lit(END_OF_TIME)),
        "is_current": F.col("__chain") & F.col("__next").isNull()})


def apply(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The history after a batch of versions, as staging and merging it gives. A batch already in it changes nothing.

    A null key is a key like others here.
    """
    return _continued(history, incoming, key).select(*history.columns)


def replayed(known: DataFrame, key: str, *, tie_break: Sequence[str] = ()) -> DataFrame:
    """The history of all versions known (key, payload, effective_from, record_hash), in whatever order they came, with ``repeats``.

    Of a key's versions of one day the last by tie_break and record_hash holds. A version equal to the one before it
    has repeats true and no time of its own: a late version between both can part them later.
    """
    w = Window.partitionBy(key).orderBy("effective_from", *(F.col(c).asc_nulls_first() for c in tie_break), "record_hash")
    last = known.withColumn("__last", ~F.lead("effective_from").over(w).eqNullSafe(F.col("effective_from"))).filter("__last").drop("__last")
    marked = last.withColumn("repeats", F.coalesce(F.lag("record_hash").over(_in_time(key)).eqNullSafe(F.col("record_hash")), F.lit(False)))
    # versions that don't repeat the one before end where the next such one begins
    following = F.min(F.when(~F.col("repeats"), F.col("effective_from"))).over(_in_time(key).rowsBetween(1, Window.unboundedFollowing))
    payload = [c for c in known.columns if c not in ADDED]
    return marked.withColumn("__next", following).select(
        *payload, F.lit(True).alias("is_enabled"), "effective_from", F.when(F.col("repeats"), F.col("effective_from")).otherwise(F.coalesce("__next", F.lit(END_OF_TIME))).alias("effective_to"),
        (F.col("__next").isNull() & ~F.col("repeats")).alias("is_current"), "record_hash", "repeats")


def rebuild(history: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The history from all versions known, late ones included; a late version replaces one of the same day."""
    payload = [c for c in history.columns if c not in ADDED]
    old = history.select(*payload, "effective_from", "record_hash", F.lit(0).alias("__turn"))
    both = old.unionByName(incoming.select(*payload, "effective_from", "record_hash", F.lit(1).alias("__turn")))
    w = Window.partitionBy(key).orderBy("effective_from", "__turn", "record_hash")
    last = both.withColumn("__last", ~F.lead("effective_from").over(w).eqNullSafe(F.col("effective_from"))).filter("__last").drop("__last", "__turn")
    return _chained(_changed(last, key), key).select(*history.columns)
