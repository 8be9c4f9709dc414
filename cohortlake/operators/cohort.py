"""Does using a feature go with converting? Cohorts of users for each feature.

users: user_id, signup_date. features: feature_id, feature_name, effective_from. usage: user_id,
feature_id, first_used_date. conversions: user_id, conversion_date, mrr; at most one row a user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the labels of the result
USED, AVAILABLE, ABSENT = COHORTS = ("used_feature", "available_not_used", "not_available")


def first_releases(history: DataFrame) -> DataFrame:
    """Features as of their first version: for asking whether any version was out at signup."""
    return history.groupBy("feature_id", "feature_name").agg(F.min("effective_from").alias("effective_from"))


def with_conversions(users: DataFrame, conversions: DataFrame) -> DataFrame:
    return users.select("user_id", "signup_date").join(conversions.select("user_id", "conversion_date", "mrr"), "user_id", "left")


def with_each(rows: DataFrame, few: DataFrame, spread: str) -> DataFrame:
    """Every row with every row of few, by an equality join: each of as many slots as there are shuffle partitions has all of few, and rows are dealt to them by a hash of ``spread``.

    No size has to be known when this is planned: adaptive execution broadcasts few if it turns out small, and else
    each slot is a task that holds it once.
    """
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__slot", F.pmod(F.xxhash64(spread), F.lit(slots)))
    return dealt.join(few.withColumn("__slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))), "__slot").drop("__slot")


def grid(users: DataFrame, features: DataFrame) -> DataFrame:
    """Every user with every feature."""
    return with_each(users, features.select("feature_id", "feature_name", "effective_from"), "user_id")


def _available() -> Column:
    return F.col("effective_from") <= F.col("signup_date")


def assign(users: DataFrame, features: DataFrame, usage: DataFrame, *, require_before_conversion: bool = False) -> DataFrame:
    """grid with ``cohort``. Used if there is a usage row with a first day; else by whether the feature was out at signup.

    With require_before_conversion, use after the conversion doesn't count.
    """
    used = usage.select("user_id", "feature_id", "first_used_date")
    rows = grid(users, features).join(used, ["user_id", "feature_id"], "left")
    uses = F.col("first_used_date").isNotNull()
    if require_before_conversion:
        uses = uses & (F.col("conversion_date").isNull() | (F.col("first_used_date") <= F.col("conversion_date")))
    return rows.withColumn("cohort", F.when(uses, USED).when(_available(), AVAILABLE).otherwise(ABSENT))


def impact(users: DataFrame, features: DataFrame, usage: DataFrame, conversions: DataFrame, **options: bool) -> DataFrame:
    """Users, conversions, conversion rate, mean days to convert and mean revenue by feature name and cohort.

    The literal form over the grid of users and features; impact_rewrite gives the same without it.
    """
    labelled = assign(with_conversions(users, conversions), features, usage, **options)
    converted = F.col("conversion_date").isNotNull()
    return labelled.groupBy("feature_name", "cohort").agg(
        F.count("*").alias("total_users"),
        F.count_if(converted).alias("converted_users"),
        F.avg(F.when(converted, 1.0).otherwise(0.0)).alias("conversion_rate"),
        F.avg(F.when(converted, F.datediff("conversion_date", "signup_date"))).alias("avg_days_to_convert"),
        F.avg(F.when(converted, F.col("mrr"))).alias("avg_mrr"))


_SUMS = ("n", "converted", "days", "n_days", "mrr", "n_mrr")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums from which the rates follow, exact in integers."""
    converted = F.col("conversion_date").isNotNull()
    days = F.when(converted, F.datediff("conversion_date", "signup_date")).cast("long")
    mrr = F.when(converted, F.col("mrr")).cast("decimal(38,6)")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(converted).alias("converted"), F.coalesce(F.sum(days), F.lit(0)).alias("days"), F.count(days).alias("n_days"),
        F.coalesce(F.sum(mrr), F.lit(0)).alias("mrr"), F.count(mrr).alias("n_mrr"))


def impact_rewrite(users: DataFrame, features: DataFrame, usage: DataFrame, conversions: DataFrame, *, require_before_conversion: bool = False) -> DataFrame:
    """impact from a histogram of signup days: its cost follows days * features + usage, not users * features.

    With require_before_conversion, users who used a feature only after their conversion stay in the histogram's cohort.

    Needs one row a user in users and conversions, one a (user, feature) in usage, one a feature_id.
    """
    people = with_conversions(users, conversions)
    catalogue = features.select("feature_id", "feature_name", "effective_from")
    without_use = F.when(_available(), AVAILABLE).otherwise(ABSENT)
    by_day = _summed(people, "signup_date")
    everyone = with_each(by_day, catalogue, "signup_date").select("feature_name", without_use.alias("cohort"), *_SUMS)
    users_of = usage.filter("first_used_date IS NOT NULL").select("user_id", "feature_id", "first_used_date").join(catalogue, "feature_id").join(people, "user_id")
    if require_before_conversion:
        users_of = users_of.filter("conversion_date IS NULL OR first_used_date <= conversion_date")
    used = _summed(users_of.withColumn("cohort", without_use), "feature_name", "cohort")
    taken = used.select("feature_name", "cohort", *((-F.col(c)).alias(c) for c in _SUMS))
    given = used.select("feature_name", F.lit(USED).alias("cohort"), *_SUMS)
    total = everyone.unionByName(taken).unionByName(given).groupBy("feature_name", "cohort").agg(*(F.sum(c).alias(c) for c in _SUMS)).filter("n > 0")

    def mean(total: str, count: str) -> Column:
        return F.when(F.col(count) > 0, F.col(total).cast("double") / F.col(count))

    return total.select("feature_name", "cohort", F.col("n").alias("total_users"), F.col("converted").alias("converted_users"), (F.col("converted") / F.col("n")).alias("conversion_rate"),
                        mean("days", "n_days").alias("avg_days_to_convert"), mean("mrr", "n_mrr").alias("avg_mrr"))


def ranked(impact: DataFrame) -> DataFrame:
    return impact.orderBy(F.asc("feature_name"), F.desc("conversion_rate"))


def pivot(impact: DataFrame) -> DataFrame:
    """A row for each feature, a column of conversion rates for each cohort; null where it has no users."""
    return impact.groupBy("feature_name").pivot("cohort", [*COHORTS]).agg(F.first("conversion_rate"))


def lift(impact: DataFrame, *, baseline: str = AVAILABLE) -> DataFrame:
    """Users' rate against the baseline cohort's: in per cent, and as a ratio; infinite over a baseline of 0. Features lacking either cohort are left out."""
    both = pivot(impact).select("feature_name", F.col(USED).alias("used_rate"), F.col(baseline).alias("baseline_rate")).filter("used_rate IS NOT NULL AND baseline_rate IS NOT NULL")
    infinite = F.lit(float("inf"))
    over = F.col("baseline_rate") > 0
    return both.withColumns({
        "lift_percent": F.when(over, (F.col("used_rate") - F.col("baseline_rate")) / F.nullif(F.col("baseline_rate"), F.lit(0.0)) * 100).otherwise(infinite),
        "lift_ratio": F.when(over, F.col("used_rate") / F.nullif(F.col("baseline_rate"), F.lit(0.0))).otherwise(infinite)})
