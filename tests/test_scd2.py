import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlake.functions.columns import iso_date
from cohortlake.operators import scd2
from cohortlake.schemas import END_OF_TIME, TABLES

D = datetime.date.fromisoformat
SCHEMA = "feature_id int, feature_name string, release_date string, version string"
TRACKED = ["feature_name", "version"]


def releases(spark, *rows):
    return spark.createDataFrame([(k, f"f{k}", d, v) for k, d, v in rows], SCHEMA)


def initial(spark, *rows, **options):
    return scd2.initial(releases(spark, *rows), "feature_id", iso_date("release_date"), TRACKED, tie_break=["version"], **options)


def versions(spark, *rows):
    return scd2.versions(releases(spark, *rows), "feature_id", iso_date("release_date"), TRACKED, tie_break=["version"])


def rows_of(history):
    return sorted((r.feature_id, r.version, r.effective_from, r.effective_to, r.is_current) for r in history.collect())


def test_initial_load(spark):
    history = initial(spark, (1, "2024-03-01", "v1.0"), (2, "2024-05-01", "v1.0"))
    assert rows_of(history) == [(1, "v1.0", D("2024-03-01"), END_OF_TIME, True), (2, "v1.0", D("2024-05-01"), END_OF_TIME, True)]
    assert {f.name: f.dataType for f in history.schema} == {f.name: f.dataType for f in TABLES["feature_states"]}
    assert {len(r.record_hash) for r in history.collect()} == {32} and all(r.is_enabled for r in history.collect())


def test_new_version_closes_the_old_one(spark):
    history = scd2.apply(initial(spark, (1, "2024-03-01", "v1.0")), versions(spark, (1, "2024-06-01", "v2.0")), "feature_id")
    assert rows_of(history) == [(1, "v1.0", D("2024-03-01"), D("2024-06-01"), False), (1, "v2.0", D("2024-06-01"), END_OF_TIME, True)]


def test_batch_with_all_versions_again_changes_nothing(spark):
    everything = [(1, "2024-01-15", "v1.0"), (1, "2024-07-01", "v2.0"), (2, "2024-03-01", "v1.0")]
    history = initial(spark, *everything)
    assert rows_of(scd2.apply(history, versions(spark, *everything, *everything), "feature_id")) == rows_of(history)


def test_new_key_with_two_versions_is_chained(spark):
    history = scd2.apply(initial(spark, (1, "2024-01-01", "v1.0")), versions(spark, (2, "2024-02-01", "v1.0"), (2, "2024-03-01", "v2.0")), "feature_id")
    assert [r for r in rows_of(history) if r[0] == 2] == [(2, "v1.0", D("2024-02-01"), D("2024-03-01"), False), (2, "v2.0", D("2024-03-01"), END_OF_TIME, True)]


def test_late_versions_are_kept_apart_or_rebuilt(spark):
    history = initial(spark, (1, "2024-03-01", "v1.0"))
    batch = versions(spark, (1, "2024-01-01", "v0.9"))
    assert rows_of(scd2.apply(history, batch, "feature_id")) == rows_of(history)
    assert [r.version for r in scd2.late(history, batch, "feature_id").collect()] == ["v0.9"]
    assert rows_of(scd2.rebuild(history, batch, "feature_id")) == [(1, "v0.9", D("2024-01-01"), D("2024-03-01"), False), (1, "v1.0", D("2024-03-01"), END_OF_TIME, True)]


def test_same_day_tie_and_bad_dates(spark):
    history = initial(spark, (1, "2024-03-01", "v1.0"), (1, "2024-03-01", "v1.1"), (2, "soon", "v1.0"), (3, None, "v1.0"))
    assert rows_of(history) == [(1, "v1.1", D("2024-03-01"), END_OF_TIME, True)]


def test_as_of_is_half_open(spark):
    history = initial(spark, (1, "2024-03-01", "v1.0"), (1, "2024-06-01", "v2.0"))
    at = lambda d: [r.version for r in scd2.as_of(history, D(d)).collect()]
    assert (at("2024-02-29"), at("2024-03-01"), at("2024-05-31"), at("2024-06-01")) == ([], ["v1.0"], ["v1.0"], ["v2.0"])


def test_as_of_join(spark):
    history = initial(spark, (1, "2024-03-01", "v1.0"), (1, "2024-06-01", "v2.0"))
    uses = spark.createDataFrame([(1, D("2024-04-01")), (1, D("2024-06-01")), (1, D("2024-01-01"))], "feature_id int, used date")
    assert sorted(r.version for r in scd2.as_of_join(uses, history, "feature_id", F.col("used")).collect()) == ["v1.0", "v2.0"]


def test_as_of_join_equals_the_range_join(spark):
    history = initial(spark, *((k, str(D("2024-01-01") + datetime.timedelta(7 * n * k)), f"v{n}") for k in (1, 2) for n in range(9)), (None, "2024-01-01", "v0"))
    closed = history.filter("version <> 'v4'")  # a gap in which no version holds
    uses = spark.createDataFrame([(k, D("2023-12-25") + datetime.timedelta(3 * n), f"use {n}") for k in (1, 2, 3, None) for n in range(50)] + [(1, None, "no day")], "feature_id int, used date, version string").withColumnRenamed("version", "what")
    on = (F.col("feature_id") == F.col("k")) & (F.col("effective_from") <= F.col("used")) & (F.col("effective_to") > F.col("used"))
    for how in ("inner", "left"):
        wanted = uses.join(closed.withColumnRenamed("feature_id", "k"), on, how).drop("k")
        found = scd2.as_of_join(uses, closed, "feature_id", F.col("used"), how=how)
        assert found.columns == wanted.columns and sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    with pytest.raises(ValueError):
        scd2.as_of_join(uses, history, "feature_id", F.col("used"), how="right")


def test_apply_equals_staging_and_merging(spark):
    history = initial(spark, (1, "2024-03-01", "a"), (1, "2024-04-01", "b"), (2, "2024-03-01", "a"), (4, "2024-03-01", "a"), (5, "2024-03-01", "a"))
    history = history.withColumn("is_current", F.col("is_current") & (F.col("feature_id") != 5))  # a key whose last version was ended
    batch = versions(spark, (1, "2024-02-01", "late"), (1, "2024-04-01", "same day"), (1, "2024-05-01", "b"), (1, "2024-06-01", "c"), (1, "2024-07-01", "c"), (2, "2024-04-01", "x"), (2, "2024-05-01", "y"),
                     (3, "2024-04-01", "n"), (3, "2024-05-01", "n"), (3, "2024-06-01", "m"), (5, "2024-09-01", "z"))
    once = scd2.apply(history, batch, "feature_id")
    assert once.columns == history.columns and once.dtypes == history.dtypes
    assert sorted(map(repr, once.collect())) == sorted(map(repr, scd2.apply_staged(history, scd2.stage(history, batch, "feature_id"), "feature_id").collect()))
    assert rows_of(scd2.apply(once, batch, "feature_id")) == rows_of(once)
    assert rows_of(scd2.apply(history.limit(0), batch, "feature_id")) == rows_of(scd2.apply_staged(history.limit(0), scd2.stage(history.limit(0), batch, "feature_id"), "feature_id"))


def test_closing_a_row_twice_is_an_error(spark):
    history = initial(spark, (1, "2024-03-01", "v1.0"))
    staged = scd2.stage(history, versions(spark, (1, "2024-06-01", "v2.0")), "feature_id")
    with pytest.raises(Exception, match="closed twice"):
        scd2.apply_staged(history, staged.unionAll(staged), "feature_id").collect()


DAYS = st.lists(st.tuples(st.integers(1, 3), st.integers(0, 20), st.sampled_from(["a", "b"])), min_size=1, max_size=12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(DAYS)
def test_batches_in_order_give_the_one_shot_history(spark, events):
    rows = [(k, str(D("2024-01-01") + datetime.timedelta(n)), v) for k, n, v in events]
    cut = sorted(r[1] for r in rows)[len(rows) // 2]
    early, rest = [r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]
    whole = rows_of(initial(spark, *rows, collapse_unchanged=True))
    history = scd2.apply(initial(spark, *early, collapse_unchanged=True), versions(spark, *rest), "feature_id")
    assert rows_of(history) == whole
    for key in {r[0] for r in whole}:
        own = sorted(r for r in whole if r[0] == key)
        own.sort(key=lambda r: r[2])
        assert [r[4] for r in own] == [False] * (len(own) - 1) + [True]
        assert all(a[3] == b[2] for a, b in zip(own, own[1:]))


def test_as_of_join_of_a_hot_key(spark):
    """Half of all facts are of one key and a quarter of one day; others lack a key or a date. Times count as their days."""
    history = initial(spark, *((k, str(D("2020-01-01") + datetime.timedelta(200 * n + k)), f"v{n}") for k in range(1, 5) for n in range(12)))
    closed = history.filter("NOT (feature_id = 1 AND version IN ('v3', 'v4', 'v5'))")
    n = F.col("id")
    uses = spark.range(4_000).select(
        F.when(n % 2 == 0, 1).when(n % 11 != 0, n % 7).cast("int").alias("feature_id"),
        F.when(n % 4 == 0, F.lit("2023-03-03 10:00:00")).when(n % 13 != 0, F.timestamp_seconds(n * 86_000 + 1_560_000_000).cast("string")).cast("timestamp").alias("used"), n.alias("fact"))
    on = (F.col("feature_id") == F.col("k")) & (F.col("effective_from") <= F.col("used")) & (F.col("effective_to") > F.col("used"))
    for how in ("inner", "left"):
        wanted = uses.join(closed.withColumnRenamed("feature_id", "k"), on, how).drop("k")
        found = scd2.as_of_join(uses, closed, "feature_id", F.col("used"), how=how)
        assert found.columns == wanted.columns and sorted(map(repr, found.collect())) == sorted(map(repr, wanted.collect()))
    # histories that begin at a time of day
    begun = closed.withColumns({"effective_from": F.col("effective_from").cast("timestamp") + F.expr("INTERVAL 10 HOURS"), "effective_to": F.col("effective_to").cast("timestamp") + F.expr("INTERVAL 10 HOURS")})
    wanted = uses.join(begun.withColumnRenamed("feature_id", "k"), on, "inner").drop("k")
    assert sorted(map(repr, scd2.as_of_join(uses, begun, "feature_id", F.col("used")).collect())) == sorted(map(repr, wanted.collect()))


def test_no_task_of_the_as_of_join_holds_a_hot_key(spark):
    history = initial(spark, *((k, f"202{n}-01-01", f"v{n}") for k in range(1, 300) for n in range(4)))
    n = F.col("id")
    uses = spark.range(40_000).select(F.when(n % 2 == 0, 1).otherwise(n % 300).cast("int").alias("feature_id"), F.date_add(F.lit("2020-01-01").cast("date"), (n % 1460).cast("int")).alias("used"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = sorted(r["count"] for r in scd2.as_of_join(uses, history, "feature_id", F.col("used")).groupBy(F.spark_partition_id()).count().collect())
    finally:
        for name, value in {"spark.sql.shuffle.partitions": "2"}.items():
            spark.conf.set(name, value)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 16 and sizes[-1] < 2 * sizes[8]
