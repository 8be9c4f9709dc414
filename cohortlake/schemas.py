"""Column types of the eight tables, as they are read raw and as they are written."""

from __future__ import annotations

import datetime

from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructType, TimestampType

#: The end of a version that is still valid.
END_OF_TIME = datetime.date(9999, 12, 31)


_TYPES = {"int": IntegerType, "bigint": LongType, "double": DoubleType, "string": StringType, "boolean": BooleanType, "date": DateType, "timestamp": TimestampType}


def _schema(columns: str) -> StructType:
    """From ``name type, ...``; Spark's own parser needs a session, and importing this module must not."""
    schema = StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        schema.add(name, _TYPES[kind]())
    return schema


RAW = {
    "feature_releases": _schema("id int, name string, release_date string, version string"),
    "user_signups": _schema("user_id int, email string, signup_date string, company_size string, industry string"),
    "feature_usage_events": _schema("timestamp string, user_id int, feature_id int, feature_name string, event_type string"),
    "conversions": _schema("user_id int, conversion_date string, plan string, mrr int, signup_date string, days_to_convert int, used_real_time_collab boolean"),
}

TABLES = {
    "feature_releases": _schema("feature_id int, feature_name string, release_date string, version string, ingestion_timestamp timestamp"),
    "user_signups": _schema("user_id int, email string, signup_date string, company_size string, industry string, ingestion_timestamp timestamp"),
    "feature_usage_events": _schema("event_id bigint, user_id int, feature_id int, feature_name string, event_type string, event_timestamp timestamp, event_date date, ingestion_timestamp timestamp"),
    "conversions": _schema("user_id int, conversion_date string, plan string, mrr int, signup_date string, days_to_convert int, used_real_time_collab boolean, ingestion_timestamp timestamp"),
    "feature_states": _schema("feature_id int, feature_name string, version string, is_enabled boolean, effective_from date, effective_to date, is_current boolean, record_hash string"),
    "user_dim": _schema("user_id int, signup_date date, company_size string, industry string, current_plan string"),
    "feature_usage_facts": _schema("user_id int, feature_id int, first_used_date date, last_used_date date, total_usage_count bigint, avg_daily_usage double, as_of_date date"),
    "feature_conversion_impact": _schema("feature_name string, cohort string, total_users bigint, converted_users bigint, conversion_rate double, avg_days_to_convert double, avg_mrr double"),
}
