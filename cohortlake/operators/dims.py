"""One row a key: latest, first, and the user dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlake.functions.columns import iso_date, or_default


def _top(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str, *, tie_break: Sequence[str] = ()) -> DataFrame:
    """The row of the greatest order (nulls last), then of the greatest tie_break columns."""
    return _top(df, keys, [F.col(c).desc_nulls_last() for c in (order, *tie_break)])


def dedupe_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first row of each key by order; any row without one."""
    return _top(df, keys, [F.col(c).asc_nulls_last() for c in order]) if order else df.dropDuplicates([*keys])


def user_dim(signups: DataFrame, conversions: DataFrame, *, default_plan: str = "free") -> DataFrame:
    """Users with the plan of their latest conversion. The email stays behind."""
    users = dedupe_by_key(signups, ["user_id"], ["signup_date", "company_size", "industry"])
    plans = latest_per_key(conversions, ["user_id"], "conversion_date", tie_break=["mrr", "plan"]).select("user_id", "plan")
    return users.join(plans, "user_id", "left").select(
        "user_id", iso_date("signup_date").alias("signup_date"), "company_size", "industry", or_default("plan", default_plan).alias("current_plan"))
