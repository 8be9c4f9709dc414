"""Usage facts: one row for each user and item."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = ("first_used_date", "last_used_date", "total_usage_count")


def usage_state(events: DataFrame, *, user: str = "user_id", item: str = "feature_id", date: str = "event_date") -> DataFrame:
    """First and last day and count of each user and item. States of parts of the events can be merged."""
    return events.groupBy(user, item).agg(F.min(date).alias("first_used_date"), F.max(date).alias("last_used_date"), F.count("*").alias("total_usage_count"))


def merged(old: DataFrame, new: DataFrame, *, user: str = "user_id", item: str = "feature_id") -> DataFrame:
    """The state of two parts together."""
    both = old.select(user, item, *STATE).unionByName(new.select(user, item, *STATE))
    return both.groupBy(user, item).agg(F.min("first_used_date").alias("first_used_date"), F.max("last_used_date").alias("last_used_date"), F.sum("total_usage_count").alias("total_usage_count"))


def facts_of(state: DataFrame, snapshot: datetime.date | None, *, user: str = "user_id", item: str = "feature_id") -> DataFrame:
    """With the count for each day between first and last, both included, and the day of the snapshot, today unless given."""
    days = F.datediff("last_used_date", "first_used_date") + 1
    as_of = F.current_date() if snapshot is None else F.lit(snapshot)
    return state.select(user, item, *STATE, (F.col("total_usage_count") / days).cast("double").alias("avg_daily_usage"), as_of.alias("as_of_date"))


def usage_facts(events: DataFrame, *, user: str = "user_id", item: str = "feature_id", date: str = "event_date", as_of: datetime.date | None = None, up_to_as_of: bool = False) -> DataFrame:
    """First and last day, count, and count for each day between them, both included.

    Events without a date count in the total only; the daily rate is null where all lack one.
    as_of is today unless given; up_to_as_of leaves later events (and those without a date) out.
    """
    if up_to_as_of:
        events = events.filter(F.col(date) <= (F.current_date() if as_of is None else F.lit(as_of)))
    return facts_of(usage_state(events, user=user, item=item, date=date), as_of, user=user, item=item)
