"""Distinct users of any range of days from sketches of each day, which are small and can be united."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the number of registers of a sketch: 4,096, in some kB.
LG_K = 12


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """The relative error that an estimate stays within but for few cases in a thousand."""
    return deviations * 1.04 / math.sqrt(1 << lg_k)


def daily_users(events: DataFrame, *, user: str = "user_id", item: str = "feature_id", date: str = "event_date", lg_k: int = LG_K) -> DataFrame:
    """(item, date, users, n_events): a HyperLogLog sketch of each item's users of each day. Null users aren't counted; a null item or day is one like others."""
    return events.groupBy(item, date).agg(F.hll_sketch_agg(user, lg_k).alias("users"), F.count("*").alias("n_events"))


def united(one: DataFrame, other: DataFrame, *, item: str = "feature_id", date: str = "event_date") -> DataFrame:
    """The daily sketches of two parts of the events, such as those there were and those of a new batch."""
    both = one.unionByName(other)
    return both.groupBy(item, date).agg(F.hll_union_agg("users").alias("users"), F.sum("n_events").alias("n_events"))


def users_between(daily: DataFrame, first: datetime.date, last: datetime.date, *, item: str = "feature_id", date: str = "event_date") -> DataFrame:
    """(item, n_users, n_events): the estimated distinct users of each item from first to last, both included, without a look at events."""
    days = daily.filter(F.col(date).between(F.lit(first), F.lit(last)))
    return days.groupBy(item).agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("n_users"), F.sum("n_events").alias("n_events"))
