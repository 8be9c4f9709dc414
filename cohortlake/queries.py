"""The registered queries of the analytics operators, on the given tables, with their SQL.

``events`` becomes users, features, usage and conversions: a feature for each k of props, named by its
last digit and released on that day after New Year; a user's signup is their first signup event; views
and clicks are usage; the latest purchase over 150 is the conversion. ``orders`` becomes a history of
customers: status and priority of their latest order of a day.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.functions.columns import day, event_time, iso_date, natural_id, or_default, record_hash
from cohortlake.operators import cohort, dims, facts, ingest, profile, quality, scd2, sketches
from cohortlake.plans import registry
from cohortlake.schemas import TABLES
from cohortlake.sources import tables
from cohortlake.sources.history import History
from cohortlake.sources.raw import CORRUPT, read_json_array, read_raw, write_json_array
from cohortlake.streaming import bronze
from cohortlake.workdir import fresh_folder

AS_OF = datetime.date(2024, 1, 31)
MID_JANUARY = datetime.date(2024, 1, 15)
SPLIT = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events as users, features, usage and conversions


def events_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").withColumns({"feature_id": k, "event_date": day("ts")})


def features_of(spark: SparkSession, d: str) -> DataFrame:
    k = events_of(spark, d).select("feature_id").filter("feature_id IS NOT NULL").distinct()
    digit = F.col("feature_id") % 10
    return k.select("feature_id", F.concat(F.lit("feature_"), digit.cast("string")).alias("feature_name"), F.date_add(F.lit("2024-01-01").cast("date"), digit).alias("effective_from"))


def users_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "signup", day("ts"))).alias("signup_date"))


def usage_events_of(spark: SparkSession, d: str) -> DataFrame:
    return events_of(spark, d).filter(F.col("event_type").isin("view", "click")).select("user_id", "feature_id", "event_date")


def conversions_of(spark: SparkSession, d: str) -> DataFrame:
    bought = table(spark, d, "events").filter("event_type = 'purchase' AND value > 150")
    latest = dims.latest_per_key(bought, ["user_id"], "ts", tie_break=["event_id"])
    return latest.select("user_id", day("ts").alias("conversion_date"), F.round("value").cast("int").alias("mrr"))


def q_usage_facts(spark, d):
    return facts.usage_facts(usage_events_of(spark, d), as_of=AS_OF)


def q_usage_facts_as_of(spark, d):
    return facts.usage_facts(usage_events_of(spark, d), as_of=MID_JANUARY, up_to_as_of=True)


def _cohort_inputs(spark, d):
    return users_of(spark, d), features_of(spark, d), q_usage_facts(spark, d), conversions_of(spark, d)


def q_cohort_impact(spark, d):
    return cohort.impact(*_cohort_inputs(spark, d))


def q_cohort_impact_rewrite(spark, d):
    return cohort.impact_rewrite(*_cohort_inputs(spark, d))


def q_cohort_assign(spark, d):
    users, features, usage, conversions = _cohort_inputs(spark, d)
    labelled = cohort.assign(cohort.with_conversions(users, conversions), features, usage)
    return labelled.groupBy("feature_id", "cohort").agg(F.count("*").alias("n"), F.sum("user_id").alias("user_ids"))


def q_user_feature_grid(spark, d):
    return cohort.grid(users_of(spark, d), features_of(spark, d)).groupBy("feature_id", "feature_name").agg(F.count("*").alias("n_users"))


def q_cohort_before_conversion(spark, d):
    return cohort.impact_rewrite(*_cohort_inputs(spark, d), require_before_conversion=True)


def q_cohort_ranked(spark, d):
    return cohort.ranked(q_cohort_impact_rewrite(spark, d))


def q_cohort_ranked_rows(spark, d):
    """The ranked result, a few rows for each feature name, with the place of each row in it."""
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    return q_cohort_ranked(spark, d).withColumn("place", place.cast("long")).select("place", "feature_name", "conversion_rate")


def q_cohort_lookup(spark, d):
    return q_cohort_impact_rewrite(spark, d).filter("feature_name = 'feature_3' AND cohort = 'used_feature'")


def q_cohort_pivot(spark, d):
    return cohort.pivot(q_cohort_impact_rewrite(spark, d))


def q_conversion_lift(spark, d):
    return cohort.lift(q_cohort_impact_rewrite(spark, d))


def q_feature_adoption(spark, d):
    users = users_of(spark, d).agg(F.count("*").alias("n"))
    return profile.feature_adoption(usage_events_of(spark, d), users)


def q_users_by_sketch(spark, d):
    """Users of each feature in mid-January, exactly, and whether the estimate from daily sketches is within its bound."""
    first, last, usage = datetime.date(2024, 1, 8), MID_JANUARY, usage_events_of(spark, d)
    estimated = sketches.users_between(sketches.daily_users(usage), first, last)
    exact = usage.filter(F.col("event_date").between(F.lit(first), F.lit(last))).groupBy("feature_id").agg(F.countDistinct("user_id").alias("n_exact"))
    within = F.abs(F.col("n_users") - F.col("n_exact")) <= F.ceil(sketches.error_bound() * F.col("n_exact"))
    return exact.join(estimated, exact.feature_id.eqNullSafe(estimated.feature_id)).select(exact.feature_id, "n_exact", "n_events", within.alias("within_bound"))


def q_json_array(spark, d):
    """Orders as JSON arrays with a line for each record, read by records; each task writes one array."""
    path, lines = fresh_folder(spark, "array"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    write_json_array(lines, path)
    return read_json_array(spark, path, lines.schema)


def q_mrr_summary(spark, d):
    return profile.mrr_summary(conversions_of(spark, d), users_of(spark, d))


def q_with_without_feature(spark, d):
    named = usage_events_of(spark, d).filter("feature_id % 10 = 3 AND feature_id < 30")
    return profile.with_without_feature(users_of(spark, d), named, conversions_of(spark, d))


def q_dedupe_by_key(spark, d):
    return dims.dedupe_by_key(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


def q_parse_event_time(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    # every seventh text is broken, and must give null
    text = F.when(F.col("event_id") % 7 == 0, F.concat(text, F.lit("?"))).otherwise(text)
    parsed = table(spark, d, "events").select("event_id", event_time(text).alias("event_timestamp"))
    return parsed.withColumn("event_date", day("event_timestamp")).select("event_id", F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_date")


def q_stable_event_id(spark, d):
    natural = ["user_id", "event_type", "props"]
    ids = ingest.with_stable_id(table(spark, d, "events").select(*natural), natural, id_col="stable_id")
    return ids.agg(F.count("*").alias("n_rows"), F.countDistinct("stable_id").alias("n_ids"))


def q_natural_keys(spark, d):
    return table(spark, d, "events").agg(F.countDistinct(natural_id("user_id", "event_type", "props")).alias("n_keys"))


def q_null_and_duplicate_keys(spark, d):
    keyed = table(spark, d, "orders").withColumn("urgent_key", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey")))
    return quality.null_and_duplicate_keys(keyed, ["urgent_key"])


# --- orders as a history of customers

TRACKED = ["o_orderstatus", "o_orderpriority"]
HISTORY = ["o_custkey", *TRACKED, "effective_from", "effective_to", "is_current", "record_hash"]


def _initial(orders: DataFrame, **options: bool) -> DataFrame:
    return scd2.initial(orders, "o_custkey", day("o_orderdate"), TRACKED, tie_break=["o_orderkey"], **options)


def _first_part(spark, d):
    return table(spark, d, "orders").filter(f"o_orderdate < '{SPLIT}' AND o_custkey % 10 <> 0")


def _batch(spark, d):
    rest = table(spark, d, "orders").filter(f"NOT (o_orderdate < '{SPLIT}' AND o_custkey % 10 <> 0)")
    return scd2.versions(rest, "o_custkey", day("o_orderdate"), TRACKED, tie_break=["o_orderkey"])


def _old_history(spark, d):
    return _initial(_first_part(spark, d), collapse_unchanged=True)


VERSION = ["o_custkey", *TRACKED, "effective_from", "record_hash"]


def q_record_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", record_hash(*TRACKED).alias("record_hash"))


def q_scd2_initial(spark, d):
    return _initial(table(spark, d, "orders")).select(*HISTORY)


def q_scd2_current(spark, d):
    return scd2.current(q_scd2_initial(spark, d))


def q_scd2_as_of(spark, d):
    return scd2.as_of(_initial(table(spark, d, "orders")), datetime.date(1998, 1, 1)).select(*HISTORY)


def q_scd2_history(spark, d):
    return scd2.ordered(_initial(table(spark, d, "orders"), collapse_unchanged=True), "o_custkey").select(*HISTORY)


def q_scd2_changes(spark, d):
    return scd2.changes(_old_history(spark, d), _batch(spark, d), "o_custkey").select(*VERSION)


def q_scd2_new_keys(spark, d):
    return scd2.new_keys(_old_history(spark, d), _batch(spark, d), "o_custkey").select(*VERSION)


def q_scd2_stage(spark, d):
    return scd2.stage(_old_history(spark, d), _batch(spark, d), "o_custkey").select("merge_key", *HISTORY)


def q_scd2_apply(spark, d):
    once = scd2.apply(_old_history(spark, d), _batch(spark, d), "o_custkey")
    return once.select(*HISTORY)


def q_scd2_merge(spark, d):
    """The batch merged into a history on disk, of which it rewrites the buckets that it changes."""
    table = History(spark, fresh_folder(spark, "history"), "o_custkey", _old_history(spark, d).schema, n_buckets=16)
    table.create(_old_history(spark, d))
    table.merge(_batch(spark, d), batch=("orders", 1))
    return table.read().select(*HISTORY)


def q_scd2_current_files(spark, d):
    """Current versions, from the files of current ones alone."""
    table = History(spark, fresh_folder(spark, "history"), "o_custkey", _old_history(spark, d).schema, n_buckets=16)
    table.create(_old_history(spark, d))
    table.merge(_batch(spark, d))
    return table.current().select(*HISTORY)


def q_stream_history(spark, d):
    """Orders as files that come a few at a time, in no order, into a history; the same files once more change nothing."""
    raw, path = fresh_folder(spark, "orders"), fresh_folder(spark, "history")
    lines = table(spark, d, "orders").select("o_orderkey", "o_custkey", *TRACKED, day("o_orderdate").cast("string").alias("o_orderdate"))
    lines.repartition(6, "o_orderkey").write.json(raw)
    versions = lambda df: scd2.versions(df, "o_custkey", iso_date("o_orderdate"), TRACKED, payload=[*TRACKED, "o_orderkey"], tie_break=["o_orderkey"])
    of_none = scd2.initial(lines.limit(0), "o_custkey", iso_date("o_orderdate"), TRACKED, payload=[*TRACKED, "o_orderkey"])
    history = History(spark, f"{path}/table", "o_custkey", of_none.schema, n_buckets=8)
    for checkpoint in ("one", "two"):
        bronze.history_available(spark, raw, lines.schema, history, f"{path}/{checkpoint}", versions, feed="orders", tie_break=["o_orderkey"], files_at_once=2)
    return history.read().select(*HISTORY)


def q_as_of_join_left(spark, d):
    """Half of all lines of one customer, some of no customer or day."""
    n = F.col("l_orderkey")
    lines = table(spark, d, "lineitem").select(F.when(n % 2 == 0, F.lit(7)).when(n % 13 != 0, n % 150).cast("long").alias("o_custkey"), F.when(n % 11 != 0, F.col("l_shipdate")).alias("shipped"))
    history = _initial(table(spark, d, "orders"), collapse_unchanged=True).select("o_custkey", "o_orderstatus", "effective_from", "effective_to")
    joined = scd2.as_of_join(lines, history, "o_custkey", F.col("shipped"), how="left")
    return joined.groupBy("o_custkey", "effective_from", F.col("o_orderstatus").alias("status_then")).agg(F.count("*").alias("n_lines"))


def q_as_of_join(spark, d):
    history = _initial(table(spark, d, "orders"), collapse_unchanged=True).withColumnRenamed("o_orderstatus", "status_then")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    joined = scd2.as_of_join(lines, history, "o_custkey", day("l_shipdate"))
    return joined.groupBy("o_custkey", "effective_from", "status_then").agg(F.count("*").alias("n_lines"))


def q_latest_per_key(spark, d):
    return dims.latest_per_key(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", tie_break=["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def q_user_dim(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
    latest = dims.latest_per_key(urgent, ["o_custkey"], "o_orderdate", tie_break=["o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return table(spark, d, "customer").join(latest, "c_custkey", "left").select("c_custkey", "c_mktsegment", "c_nationkey", or_default("o_orderpriority", "free").alias("current_plan"))


def q_profile_counts(spark, d):
    return profile.counts_by(q_user_dim(spark, d), ["c_mktsegment", "c_nationkey", "current_plan"])


def q_partition_pruned_scan(spark, d):
    """Orders are written by year and read back for the last two; only those partitions are listed."""
    path = fresh_folder(spark, "pruned")
    by_year = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
    tables.append(by_year, path, partition_by=["o_year"])
    return tables.read(spark, path, by_year.schema).filter("o_year >= 2000").groupBy("o_year").agg(F.count("*").alias("n_orders"), F.sum("o_custkey").alias("custkeys"))


def q_preview_limit(spark, d):
    return profile.preview(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 20)


def q_table_summary(spark, d):
    return profile.summary(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


def q_raw_profile(spark, d):
    """Events written as JSON lines, some of them broken, and profiled as raw records."""
    path = fresh_folder(spark, "raw-profile")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    broken = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    table(spark, d, "events").select(broken.alias("value")).write.text(path)
    schema = table(spark, d, "events").select("event_id", "user_id", "event_type", "value").schema
    return profile.raw_profile(read_raw(spark, path, schema, corrupt=True), corrupt=CORRUPT)


# --- whole runs over raw files made from the tables


def _event_lines(used: DataFrame) -> DataFrame:
    return used.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "user_id", "feature_id", F.concat(F.lit("feature_"), (F.col("feature_id") % 10).cast("string")).alias("feature_name"), "event_type")


def _raw_files(spark, d, *, second_versions: bool = False) -> str:
    """Raw files of the events; with second_versions, every third feature has another version 12 days after its first."""
    raw = fresh_folder(spark, "raw")
    features = features_of(spark, d).select(F.col("feature_id").alias("id"), F.col("feature_name").alias("name"), F.col("effective_from").cast("string").alias("release_date"), F.lit("v1.0").alias("version"))
    if second_versions:
        later = features.filter("id % 3 = 0").withColumns({"release_date": F.date_add(F.col("release_date").cast("date"), 12).cast("string"), "version": F.lit("v2.0")})
        features = features.unionByName(later)
    catalogue = features.agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "name", "release_date", "version")))).alias("value"))  # a release file is one JSON array
    catalogue.write.text(f"{raw}/feature_releases.json")
    users_of(spark, d).select("user_id", F.lit("someone@example.com").alias("email"), F.coalesce(F.col("signup_date").cast("string"), F.lit("unknown")).alias("signup_date"), F.lit("1-10").alias("company_size"), F.lit("retail").alias("industry")).write.json(f"{raw}/user_signups.jsonl")
    used = events_of(spark, d).filter(F.col("event_type").isin("view", "click"))
    _event_lines(used).write.json(f"{raw}/feature_usage_events.jsonl")
    conversions_of(spark, d).select("user_id", F.col("conversion_date").cast("string").alias("conversion_date"), F.lit("pro").alias("plan"), "mrr").write.json(f"{raw}/conversions.jsonl")
    return raw


def _ran(spark, d) -> registry.Workspace:
    ws = registry.Workspace(spark, _raw_files(spark, d), fresh_folder(spark, "tables"), as_of=AS_OF)
    registry.run_all(ws)
    return ws


def q_pipeline_gold(spark, d):
    return _ran(spark, d).read("feature_conversion_impact")


def q_pipeline_rerun(spark, d):
    """All tables twice with dedupe: nothing may change."""
    ws = registry.Workspace(spark, _raw_files(spark, d), fresh_folder(spark, "tables"), as_of=AS_OF, dedupe=True)
    registry.run_all(ws)
    registry.run_all(ws)
    return ws.read("feature_states").select("feature_id", "feature_name", "effective_from", "effective_to", "is_current")


def q_pipeline_new_versions(spark, d):
    """The history of features, then again from raw files with new versions of some."""
    base = fresh_folder(spark, "tables")
    for raw in (_raw_files(spark, d), _raw_files(spark, d, second_versions=True)):
        ws = registry.Workspace(spark, raw, base, as_of=AS_OF, dedupe=True)
        for name in ("feature_releases", "feature_states"):
            registry.run_gated(ws, name)
    return ws.read("feature_states").select("feature_id", "feature_name", "version", "effective_from", "effective_to", "is_current")


def q_stream_daily_counts(spark, d):
    raw, path = _raw_files(spark, d), fresh_folder(spark, "stream")
    for _ in range(2):  # the second run finds nothing new
        bronze.ingest_available(spark, f"{raw}/feature_usage_events.jsonl", f"{path}/events", f"{path}/checkpoint")
    return bronze.daily_counts(spark.read.parquet(f"{path}/events"))


def q_stream_event_ids(spark, d):
    """Events streamed from files, and ingested in one batch: how many ids either has, and both."""
    raw, path = _raw_files(spark, d), fresh_folder(spark, "stream")
    for _ in range(2):
        bronze.ingest_available(spark, f"{raw}/feature_usage_events.jsonl", f"{path}/events", f"{path}/checkpoint", files_at_once=3)
    ws = registry.Workspace(spark, raw, f"{path}/tables")
    registry.run_gated(ws, "feature_usage_events")
    streamed = tables.read(spark, f"{path}/events", TABLES["feature_usage_events"]).groupBy("event_id").agg(F.count("*").alias("n_streamed"))
    batch = ws.read("feature_usage_events").groupBy("event_id").agg(F.count("*").alias("n_batch"))
    both = streamed.join(batch, "event_id", "full")
    return both.agg(F.sum("n_streamed").alias("n_streamed"), F.sum("n_batch").alias("n_batch"), F.count_if(F.col("n_streamed").eqNullSafe(F.col("n_batch"))).alias("n_equal"))


def q_usage_facts_refreshed(spark, d):
    """Facts after three ingests of events, the last of which are the earliest days; each refresh reads the days that grew."""
    base, events = fresh_folder(spark, "tables"), events_of(spark, d).filter(F.col("event_type").isin("view", "click"))
    third = F.when(F.col("ts") < F.lit("2024-01-08").cast("timestamp"), 2).otherwise(F.col("event_id") % 2)
    for turn in range(3):
        raw = fresh_folder(spark, "raw")
        _event_lines(events.filter(third == turn)).write.json(f"{raw}/feature_usage_events.jsonl")
        ws = registry.Workspace(spark, raw, base, as_of=AS_OF)
        for name in ("feature_usage_events", "feature_usage_facts"):
            registry.run_gated(ws, name)
    return ws.read("feature_usage_facts")


def q_gate_outcomes(spark, d):
    """What gates say of the orders as a table, as they are and spoiled."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    expected, outcomes = orders.schema, []
    made = {
        "as it is": orders, "a column less": orders.drop("o_custkey"), "another type": orders.withColumn("o_custkey", F.col("o_custkey").cast("string")), "no rows": orders.limit(0),
        "null keys": orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey"))), "repeated keys": orders.withColumn("o_orderkey", F.col("o_custkey")), "absent": None,
    }
    for case, df in made.items():
        path, rows = fresh_folder(spark, "gate"), None
        if df is not None:
            tables.overwrite(df, path, observed=quality.observed(["o_orderkey"]) if "o_orderkey" in df.columns else {})
        try:
            rows, outcome = quality.check_table(spark, path, expected, "orders", keys=["o_orderkey"]), "passed"
        except (quality.SchemaValidationError, quality.DataValidationError) as e:
            outcome = type(e).__name__
        outcomes.append((case, outcome, rows))
    return spark.createDataFrame(outcomes, "gate string, outcome string, n_rows long")


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}

_E = r"""e AS (
  SELECT *, CAST(regexp_extract(props, '"k": *(\d+)', 1) AS INTEGER) AS feature_id, CAST(ts AS DATE) AS event_date FROM events
), features AS (
  SELECT DISTINCT feature_id, 'feature_' || (feature_id % 10) AS feature_name, CAST(DATE '2024-01-01' + CAST(feature_id % 10 AS INTEGER) AS DATE) AS effective_from FROM e
), users AS (
  SELECT user_id, min(CASE WHEN event_type = 'signup' THEN event_date END) AS signup_date FROM e GROUP BY user_id
), used AS (
  SELECT user_id, feature_id, event_date FROM e WHERE event_type IN ('view', 'click')
), conv AS (
  SELECT user_id, event_date AS conversion_date, CAST(round(value) AS INTEGER) AS mrr FROM e WHERE event_type = 'purchase' AND value > 150
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
)"""
_LABELLED = _E + """, labelled AS (
  SELECT u.user_id, f.feature_id, f.feature_name, u.signup_date, c.conversion_date, c.mrr,
    CASE WHEN g.user_id IS NOT NULL THEN 'used_feature' WHEN f.effective_from <= u.signup_date THEN 'available_not_used' ELSE 'not_available' END AS cohort
  FROM users u CROSS JOIN features f LEFT JOIN (SELECT DISTINCT user_id, feature_id FROM used) g ON g.user_id = u.user_id AND g.feature_id = f.feature_id
  LEFT JOIN conv c ON c.user_id = u.user_id
)"""
_IMPACT = _LABELLED + """, impact AS (
  SELECT feature_name, cohort, count(*) AS total_users, count(conversion_date) AS converted_users,
    avg(CASE WHEN conversion_date IS NOT NULL THEN 1.0 ELSE 0.0 END) AS conversion_rate,
    avg(CASE WHEN conversion_date IS NOT NULL THEN date_diff('day', signup_date, conversion_date) END) AS avg_days_to_convert,
    avg(CASE WHEN conversion_date IS NOT NULL THEN mrr END) AS avg_mrr
  FROM labelled GROUP BY ALL
)"""
_FACTS = """SELECT user_id, feature_id, min(event_date) AS first_used_date, max(event_date) AS last_used_date, count(*) AS total_usage_count,
  CAST(count(*) AS DOUBLE) / (date_diff('day', min(event_date), max(event_date)) + 1) AS avg_daily_usage, DATE '{day}' AS as_of_date FROM used {where} GROUP BY user_id, feature_id"""
_V = """{name} AS (
  SELECT o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS effective_from, md5(concat_ws('|', o_orderstatus, o_orderpriority)) AS record_hash
  FROM orders WHERE {where} QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1
)"""
_CHANGED = """{name} AS (SELECT * FROM {of} QUALIFY record_hash IS DISTINCT FROM lag(record_hash) OVER (PARTITION BY o_custkey ORDER BY effective_from))"""
_CHAIN = """SELECT o_custkey, o_orderstatus, o_orderpriority, effective_from,
  coalesce(lead(effective_from) OVER w, DATE '9999-12-31') AS effective_to, lead(effective_from) OVER w IS NULL AS is_current, record_hash
  FROM {of} WINDOW w AS (PARTITION BY o_custkey ORDER BY effective_from)"""
_FIRST = f"o_orderdate < TIMESTAMP '{SPLIT}' AND o_custkey % 10 <> 0"
_BATCHED = "WITH " + ", ".join([
    _V.format(name="v0", where=_FIRST), _CHANGED.format(name="c0", of="v0"), f"old AS ({_CHAIN.format(of='c0')})", _V.format(name="incoming", where=f"NOT ({_FIRST})"),
    """newer AS (SELECT i.*, o.record_hash AS old_hash FROM incoming i JOIN old o ON o.o_custkey = i.o_custkey AND o.is_current WHERE i.effective_from > o.effective_from)""",
    """changes AS (SELECT * EXCLUDE (old_hash) FROM newer QUALIFY record_hash <> coalesce(lag(record_hash) OVER (PARTITION BY o_custkey ORDER BY effective_from), old_hash))""",
    """fresh AS (SELECT * FROM incoming WHERE o_custkey NOT IN (SELECT o_custkey FROM old) QUALIFY record_hash IS DISTINCT FROM lag(record_hash) OVER (PARTITION BY o_custkey ORDER BY effective_from))""",
]) + "\n"
_WITH_V = "WITH " + _V.format(name="v", where="true")
_WITH_C = _WITH_V + ", " + _CHANGED.format(name="c", of="v")
_DIM = """dim AS (
  SELECT c_custkey, c_mktsegment, c_nationkey, coalesce(o_orderpriority, 'free') AS current_plan FROM customer LEFT JOIN (
    SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey
)"""
_LIFT = """SELECT used_rate, baseline_rate, feature_name,
  CASE WHEN baseline_rate > 0 THEN (used_rate - baseline_rate) / baseline_rate * 100 ELSE CAST('inf' AS DOUBLE) END AS lift_percent,
  CASE WHEN baseline_rate > 0 THEN used_rate / baseline_rate ELSE CAST('inf' AS DOUBLE) END AS lift_ratio
  FROM (SELECT u.feature_name, u.conversion_rate AS used_rate, b.conversion_rate AS baseline_rate FROM impact u JOIN impact b ON b.feature_name = u.feature_name AND b.cohort = 'available_not_used' WHERE u.cohort = 'used_feature')"""

ORACLE_SQL = {
    "q_usage_facts": f"WITH {_E} " + _FACTS.format(day="2024-01-31", where=""),
    "q_usage_facts_as_of": f"WITH {_E} " + _FACTS.format(day="2024-01-15", where="WHERE event_date <= DATE '2024-01-15'"),
    "q_cohort_impact": f"WITH {_IMPACT} SELECT * FROM impact",
    "q_cohort_impact_rewrite": f"WITH {_IMPACT} SELECT * FROM impact",
    "q_cohort_assign": f"WITH {_LABELLED} SELECT feature_id, cohort, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS user_ids FROM labelled GROUP BY ALL",
    "q_user_feature_grid": f"WITH {_E} SELECT feature_id, feature_name, count(*) AS n_users FROM users CROSS JOIN features GROUP BY ALL",
    "q_cohort_before_conversion": "WITH " + _IMPACT.replace("SELECT DISTINCT user_id, feature_id FROM used", "SELECT user_id, feature_id, min(event_date) AS first_day FROM used GROUP BY ALL").replace("WHEN g.user_id IS NOT NULL THEN", "WHEN g.user_id IS NOT NULL AND (c.conversion_date IS NULL OR g.first_day <= c.conversion_date) THEN") + " SELECT * FROM impact",
    "q_users_by_sketch": f"WITH {_E} SELECT feature_id, count(DISTINCT user_id) AS n_exact, count(*) AS n_events, true AS within_bound FROM used WHERE event_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-15' GROUP BY feature_id",
    "q_json_array": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "q_cohort_ranked": f"WITH {_IMPACT} SELECT * FROM impact ORDER BY feature_name, conversion_rate DESC",
    "q_cohort_ranked_rows": f"WITH {_IMPACT} SELECT row_number() OVER (ORDER BY feature_name, conversion_rate DESC) AS place, feature_name, conversion_rate FROM impact",
    "q_cohort_lookup": f"WITH {_IMPACT} SELECT * FROM impact WHERE feature_name = 'feature_3' AND cohort = 'used_feature'",
    "q_cohort_pivot": f"WITH {_IMPACT} SELECT feature_name, " + ", ".join(f"max(CASE WHEN cohort = '{c}' THEN conversion_rate END) AS {c}" for c in cohort.COHORTS) + " FROM impact GROUP BY feature_name",
    "q_conversion_lift": f"WITH {_IMPACT} {_LIFT}",
    "q_feature_adoption": f"WITH {_E} SELECT feature_id, count(*) AS n_events, count(DISTINCT user_id) AS n_users, 100.0 * CAST(count(DISTINCT user_id) AS DOUBLE) / (SELECT count(*) FROM users) AS percent_of_users FROM used GROUP BY feature_id",
    "q_mrr_summary": f"""WITH {_E} SELECT count(*) AS n_conversions, min(mrr) AS min_mrr, max(mrr) AS max_mrr, avg(mrr) AS avg_mrr, CAST(sum(mrr) AS BIGINT) AS total_mrr,
      (SELECT count(*) FROM users) AS n_users, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM users) AS conversion_rate FROM conv""",
    "q_with_without_feature": f"""WITH {_E}, p AS (
      SELECT u.user_id, u.signup_date, c.conversion_date, u.user_id IN (SELECT user_id FROM used WHERE feature_id % 10 = 3 AND feature_id < 30) AS uses FROM users u LEFT JOIN conv c ON c.user_id = u.user_id
    ), r AS (
      SELECT count(*) FILTER (uses) AS n_with, count(*) FILTER (NOT uses) AS n_without,
        coalesce(avg(CASE WHEN uses THEN CAST(conversion_date IS NOT NULL AS INTEGER) END), 0) AS rate_with, coalesce(avg(CASE WHEN NOT uses THEN CAST(conversion_date IS NOT NULL AS INTEGER) END), 0) AS rate_without,
        coalesce(avg(CASE WHEN uses THEN date_diff('day', signup_date, conversion_date) END), 0) AS days_with, coalesce(avg(CASE WHEN NOT uses THEN date_diff('day', signup_date, conversion_date) END), 0) AS days_without FROM p
    ) SELECT *, 100 * (rate_with - rate_without) AS lift_points FROM r""",
    "q_dedupe_by_key": "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "q_parse_event_time": """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS event_time, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS event_date FROM events""",
    "q_stable_event_id": "SELECT count(*) AS n_rows, count(*) AS n_ids FROM events",
    "q_natural_keys": "SELECT count(*) AS n_keys FROM (SELECT DISTINCT user_id, event_type, props FROM events)",
    "q_null_and_duplicate_keys": """WITH k AS (SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS k FROM orders)
      SELECT count(*) AS n_rows, count(*) - count(k) AS n_null_keys, count(k) - count(DISTINCT k) AS n_duplicate_keys FROM k""",
    "q_record_hash": "SELECT o_orderkey, md5(concat_ws('|', o_orderstatus, o_orderpriority)) AS record_hash FROM orders",
    "q_scd2_initial": f"{_WITH_V} {_CHAIN.format(of='v')}",
    "q_scd2_current": f"{_WITH_V} SELECT * FROM ({_CHAIN.format(of='v')}) WHERE is_current",
    "q_scd2_as_of": f"{_WITH_V} SELECT * FROM ({_CHAIN.format(of='v')}) WHERE effective_from <= DATE '1998-01-01' AND effective_to > DATE '1998-01-01'",
    "q_scd2_history": f"{_WITH_C} {_CHAIN.format(of='c')} ORDER BY o_custkey, effective_from",
    "q_scd2_changes": _BATCHED + "SELECT * FROM changes",
    "q_scd2_new_keys": _BATCHED + "SELECT * FROM fresh",
    "q_scd2_stage": _BATCHED + f""", added AS (SELECT * FROM changes UNION ALL SELECT * FROM fresh), firsts AS (SELECT o_custkey, min(effective_from) AS closes FROM changes GROUP BY o_custkey)
      SELECT old.o_custkey AS merge_key, old.* EXCLUDE (effective_to, is_current), closes AS effective_to, false AS is_current FROM old JOIN firsts USING (o_custkey) WHERE is_current
      UNION ALL BY NAME SELECT NULL AS merge_key, * FROM ({_CHAIN.format(of='added')})""".lstrip(),
    "q_scd2_apply": f"{_WITH_C} {_CHAIN.format(of='c')}",
    "q_scd2_merge": f"{_WITH_C} {_CHAIN.format(of='c')}",
    "q_scd2_current_files": f"{_WITH_C} SELECT * FROM ({_CHAIN.format(of='c')}) WHERE is_current",
    "q_stream_history": f"{_WITH_C} {_CHAIN.format(of='c')}",
    "q_as_of_join_left": f"""{_WITH_C}, h AS ({_CHAIN.format(of='c')}), lines AS (
        SELECT CASE WHEN l_orderkey % 2 = 0 THEN 7 WHEN l_orderkey % 13 <> 0 THEN l_orderkey % 150 END AS o_custkey, CASE WHEN l_orderkey % 11 <> 0 THEN l_shipdate END AS shipped FROM lineitem)
      SELECT l.o_custkey, h.effective_from, h.o_orderstatus AS status_then, count(*) AS n_lines FROM lines l
      LEFT JOIN h ON h.o_custkey = l.o_custkey AND h.effective_from <= CAST(l.shipped AS DATE) AND h.effective_to > CAST(l.shipped AS DATE) GROUP BY ALL""",
    "q_as_of_join": f"""{_WITH_C}, h AS ({_CHAIN.format(of='c')})
      SELECT o.o_custkey, h.effective_from, h.o_orderstatus AS status_then, count(*) AS n_lines FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
      JOIN h ON h.o_custkey = o.o_custkey AND h.effective_from <= CAST(l.l_shipdate AS DATE) AND h.effective_to > CAST(l.l_shipdate AS DATE) GROUP BY ALL""",
    "q_latest_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "q_user_dim": f"WITH {_DIM} SELECT * FROM dim",
    "q_profile_counts": f"""WITH {_DIM} SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value, count(*) AS n FROM dim GROUP BY c_mktsegment
      UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM dim GROUP BY c_nationkey UNION ALL SELECT 'current_plan', current_plan, count(*) FROM dim GROUP BY current_plan""",
    "q_partition_pruned_scan": "SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, count(*) AS n_orders, CAST(sum(o_custkey) AS BIGINT) AS custkeys FROM orders WHERE year(o_orderdate) >= 2000 GROUP BY ALL",
    "q_preview_limit": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20",
    "q_table_summary": "SELECT count(*) AS n_rows, 'o_orderkey bigint, o_custkey bigint, o_orderstatus string' AS columns FROM orders",
    "q_raw_profile": """SELECT count(*) AS n_records, count(*) FILTER (event_id % 11 = 0) AS n_corrupt, count(*) FILTER (event_id % 11 = 0) AS null_event_id, count(*) FILTER (event_id % 11 = 0) AS null_user_id,
      count(*) FILTER (event_id % 11 = 0) AS null_event_type, count(*) FILTER (event_id % 11 = 0) AS null_value FROM events""",
    "q_pipeline_gold": f"WITH {_IMPACT} SELECT * FROM impact",
    "q_pipeline_rerun": f"WITH {_E} SELECT feature_id, feature_name, effective_from, DATE '9999-12-31' AS effective_to, true AS is_current FROM features",
    "q_pipeline_new_versions": f"""WITH {_E}, v AS (
      SELECT feature_id, feature_name, 'v1.0' AS version, effective_from FROM features UNION ALL SELECT feature_id, feature_name, 'v2.0', CAST(effective_from + 12 AS DATE) FROM features WHERE feature_id % 3 = 0
    ) SELECT *, coalesce(lead(effective_from) OVER w, DATE '9999-12-31') AS effective_to, lead(effective_from) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY feature_id ORDER BY effective_from)""",
    "q_gate_outcomes": """SELECT 'as it is' AS gate, 'passed' AS outcome, count(*) AS n_rows FROM orders
      UNION ALL SELECT 'a column less', 'SchemaValidationError', NULL UNION ALL SELECT 'another type', 'SchemaValidationError', NULL UNION ALL SELECT 'no rows', 'DataValidationError', NULL
      UNION ALL SELECT 'null keys', CASE WHEN count(*) FILTER (o_orderkey % 10 = 0) > 0 THEN 'DataValidationError' ELSE 'passed' END, NULL FROM orders
      UNION ALL SELECT 'repeated keys', CASE WHEN count(*) > count(DISTINCT o_custkey) THEN 'DataValidationError' ELSE 'passed' END, NULL FROM orders
      UNION ALL SELECT 'absent', 'DataValidationError', NULL""",
    "q_stream_event_ids": f"WITH {_E} SELECT count(*) AS n_streamed, count(*) AS n_batch, count(*) AS n_equal FROM used",
    "q_usage_facts_refreshed": f"WITH {_E} " + _FACTS.format(day="2024-01-31", where=""),
    "q_stream_daily_counts": f"""WITH {_E} SELECT event_date, event_type, count(*) AS n FROM (
      SELECT DISTINCT strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, user_id, feature_id, event_type, event_date FROM e WHERE event_type IN ('view', 'click')) GROUP BY ALL""",
}
