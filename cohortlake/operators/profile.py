"""Counts and summaries that describe a dataset, each one Spark job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, n): the rows of each value of each column, by grouping sets in one pass."""
    named = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    sets = named.groupingSets([[c] for c in columns], *columns).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"__{c}") for c in columns))
    dimension = F.coalesce(*(F.when(F.col(f"__{c}") == 0, c) for c in columns))
    value = F.coalesce(*(F.when(F.col(f"__{c}") == 0, F.col(c)) for c in columns))
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n")


def feature_adoption(events: DataFrame, n_users: DataFrame, *, feature: Sequence[str] = ("feature_id",)) -> DataFrame:
    """Events, distinct users, and their share of all users in per cent, by feature. n_users: one row, one number."""
    total = n_users.select(F.col(n_users.columns[0]).alias("__total"))
    used = events.groupBy(*feature).agg(F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"))
    return used.crossJoin(F.broadcast(total)).withColumn("percent_of_users", 100.0 * F.col("n_users") / F.nullif(F.col("__total"), F.lit(0))).drop("__total")


def mrr_summary(conversions: DataFrame, users: DataFrame) -> DataFrame:
    """Least, greatest, mean and total revenue, and the share of users that converted."""
    money = conversions.agg(F.count("*").alias("n_conversions"), F.min("mrr").alias("min_mrr"), F.max("mrr").alias("max_mrr"), F.avg("mrr").alias("avg_mrr"), F.sum("mrr").alias("total_mrr"),
                            F.countDistinct("user_id").alias("__converted"))
    everyone = users.agg(F.countDistinct("user_id").alias("n_users"))
    return money.crossJoin(everyone).withColumn("conversion_rate", F.col("__converted") / F.nullif(F.col("n_users"), F.lit(0))).drop("__converted")


def with_without_feature(users: DataFrame, users_of_feature: DataFrame, conversions: DataFrame) -> DataFrame:
    """One row: conversion rates of users with and without a feature, their difference in points, mean days to convert (0 without any)."""
    has = users_of_feature.select("user_id").distinct().withColumn("__has", F.lit(True))
    people = users.select("user_id", "signup_date").join(has, "user_id", "left").join(conversions.select("user_id", "conversion_date"), "user_id", "left")
    uses, converted, days = F.coalesce("__has", F.lit(False)), F.col("conversion_date").isNotNull(), F.datediff("conversion_date", "signup_date")

    def rate(group):
        return F.coalesce(F.avg(F.when(group, converted.cast("double"))), F.lit(0.0))

    def mean_days(group):
        return F.coalesce(F.avg(F.when(group & converted, days)), F.lit(0.0))

    return people.agg(
        F.count_if(uses).alias("n_with"), F.count_if(~uses).alias("n_without"), rate(uses).alias("rate_with"), rate(~uses).alias("rate_without"),
        mean_days(uses).alias("days_with"), mean_days(~uses).alias("days_without")).withColumn("lift_points", 100 * (F.col("rate_with") - F.col("rate_without")))


def raw_profile(df: DataFrame, *, corrupt: str | None = None) -> DataFrame:
    """One row: records, records that don't parse, and nulls of each column."""
    columns = [c for c in df.columns if c != corrupt]
    broken = F.count_if(F.col(corrupt).isNotNull()) if corrupt else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("n_records"), broken.alias("n_corrupt"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def preview(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*order).limit(n)


def summary(df: DataFrame) -> DataFrame:
    """One row: how many rows df has, and its columns with their types; what a preview says above its rows."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(columns))
