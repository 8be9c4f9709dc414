"""The eight tables: what each is made of, in which order, and the gates around each.

A table is run as input gate, process, output gate. Raw inputs are JSON files in one folder; tables
live in one folder each, ``<base>/<layer>/<name>``.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlake.functions.columns import iso_date
from cohortlake.operators import cohort, dims, facts, ingest, quality, scd2
from cohortlake.schemas import RAW, TABLES
from cohortlake.sources import idfilter, tables
from cohortlake.sources.history import History
from cohortlake.sources.raw import read_json_array, read_raw

LAYERS = {
    "feature_releases": "bronze", "user_signups": "bronze", "feature_usage_events": "bronze", "conversions": "bronze",
    "feature_states": "silver", "user_dim": "silver", "feature_usage_facts": "silver", "feature_conversion_impact": "gold",
}
RAW_FILES = {"feature_releases": "feature_releases.json", "user_signups": "user_signups.jsonl", "feature_usage_events": "feature_usage_events.jsonl", "conversions": "conversions.jsonl"}
RAW_OPTIONS = {"feature_releases": {"multiLine": True}}
PARTITIONS = {"user_signups": ("signup_date",), "feature_usage_events": ("event_date",)}
#: The folder of rows whose partition column is null (fixed value).
NO_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Buckets of the history of features, which are thousands at most.
HISTORY_BUCKETS = 16
KEYS = {"feature_states": ("feature_id", "effective_from"), "user_dim": ("user_id",), "feature_usage_facts": ("user_id", "feature_id"), "feature_conversion_impact": ("feature_name", "cohort")}


@dataclass(frozen=True)
class Workspace:
    """Where raw files and tables are. ``dedupe`` makes bronze skip records it has; ``as_of`` dates the facts."""

    spark: SparkSession
    raw: str
    base: str
    fmt: str = tables.FORMAT
    dedupe: bool = False
    as_of: datetime.date | None = None

    def path(self, name: str) -> str:
        return f"{self.base}/{LAYERS[name]}/{name}"

    def read(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.path(name), TABLES[name], fmt=self.fmt)


@dataclass(frozen=True)
class Table:
    name: str
    process: Callable[[Workspace], int]
    depends_on: tuple[str, ...] = field(default=())


def _bronze(name: str, shape: Callable[[DataFrame], DataFrame]) -> Table:
    def process(ws: Workspace) -> int:
        path = f"{ws.raw}/{RAW_FILES[name]}"
        new = shape(read_json_array(ws.spark, path, RAW[name]) if name in RAW_OPTIONS else read_raw(ws.spark, path, RAW[name]))
        new, to = new.select(*TABLES[name].names), ws.path(name)
        natural = [c for c in TABLES[name].names if c != "ingestion_timestamp"]
        if name in PARTITIONS:
            return idfilter.append_noted(new, to, natural, *PARTITIONS[name], only_unseen=ws.dedupe, fmt=ws.fmt)
        if ws.dedupe and tables.exists(ws.spark, to):
            new = ingest.unseen(new, ws.read(name), natural)
        return tables.append(new, to, fmt=ws.fmt)

    return Table(name, process)


def feature_history(ws: Workspace) -> History:
    return History(ws.spark, ws.path("feature_states"), "feature_id", TABLES["feature_states"], n_buckets=HISTORY_BUCKETS, fmt=ws.fmt)


def _feature_states(ws: Workspace) -> int:
    """A batch rewrites the buckets in which it changes something; the rows that the table then has."""
    history, found = feature_history(ws), scd2.versions(ws.read("feature_releases"), "feature_id", iso_date("release_date"), ["feature_name", "version"], tie_break=["version"])
    if not tables.exists(ws.spark, history.path):
        history.create(scd2.initial(ws.read("feature_releases"), "feature_id", iso_date("release_date"), ["feature_name", "version"], tie_break=["version"]))
    else:
        if tables.snapshot(ws.spark, history.path) is None:  # written by an earlier release
            history.create(history.read())
        history.merge(found)
    return history.read().count()


def _replace(ws: Workspace, name: str, df: DataFrame, **options: object) -> int:
    """Gates find what they need of the rows beside the table."""
    return tables.overwrite(df, ws.path(name), fmt=ws.fmt, observed=quality.observed(KEYS.get(name, ())), **options)


def _user_dim(ws: Workspace) -> int:
    return _replace(ws, "user_dim", dims.user_dim(ws.read("user_signups"), ws.read("conversions")))


def new_events(ws: Workspace) -> tuple[DataFrame, dict[str, list[int]], datetime.datetime | None] | None:
    """Events that the usage facts don't have yet, all partitions' marks, and the time up to which events had been taken; None without facts to add to.

    Read are only the days whose folder has grown since; in them, rows of later appends. Appends have the time they
    began at, so one should end before the facts are refreshed: run_table does so, and _usage_facts(afresh) takes all.
    """
    now = tables.snapshot(ws.spark, ws.path("feature_usage_facts"))
    if now is None or "marks" not in now.facts:
        return None
    marks, before = tables.partition_marks(ws.spark, ws.path("feature_usage_events")), now.facts["marks"]
    days = [m.partition("=")[2] for m, size in marks.items() if before.get(m) != size]
    dated = [datetime.date.fromisoformat(d) for d in days if d != NO_PARTITION]
    grown = F.col("event_date").isin(dated) | (F.lit(NO_PARTITION in days) & F.col("event_date").isNull())
    taken = datetime.datetime.fromisoformat(now.facts["taken"]) if now.facts["taken"] else None
    events = ws.read("feature_usage_events").filter(grown)
    return events if taken is None else events.filter(F.col("ingestion_timestamp") > F.lit(taken)), marks, taken


def _usage_facts(ws: Workspace, *, afresh: bool = False) -> int:
    """Facts of what was there before and of new events alone."""
    found = None if afresh else new_events(ws)
    events, marks, taken = found or (ws.read("feature_usage_events"), tables.partition_marks(ws.spark, ws.path("feature_usage_events")), None)
    last = events.agg(F.max("ingestion_timestamp")).first()[0]  # from one column
    # rows that come meanwhile are the next run's
    state = facts.usage_state(events.filter(F.col("ingestion_timestamp") <= F.lit(last)) if last else events)
    if found:
        state = facts.merged(ws.read("feature_usage_facts"), state)
    kept = {"marks": marks, "taken": (last or taken) and (last or taken).isoformat()}
    return _replace(ws, "feature_usage_facts", facts.facts_of(state, ws.as_of), facts=kept)


def _impact(ws: Workspace) -> int:
    latest = dims.latest_per_key(ws.read("conversions"), ["user_id"], "conversion_date", tie_break=["mrr", "plan"]).withColumn("conversion_date", iso_date("conversion_date"))
    gold = cohort.impact_rewrite(ws.read("user_dim"), scd2.current(ws.read("feature_states")), ws.read("feature_usage_facts"), latest)
    return _replace(ws, "feature_conversion_impact", gold, replace_schema=True)


REGISTRY = {t.name: t for t in (
    _bronze("feature_releases", ingest.feature_releases),
    _bronze("user_signups", ingest.user_signups),
    _bronze("feature_usage_events", ingest.feature_usage_events),
    _bronze("conversions", ingest.conversions),
    Table("feature_states", _feature_states, ("feature_releases",)),
    Table("user_dim", _user_dim, ("user_signups", "conversions")),
    Table("feature_usage_facts", _usage_facts, ("feature_usage_events",)),
    Table("feature_conversion_impact", _impact, ("user_dim", "feature_states", "feature_usage_facts", "conversions")),
)}


def in_order(names: Iterable[str]) -> list[str]:
    """The names with what they depend on among themselves before them."""
    wanted, done = list(names), []

    def visit(name: str) -> None:
        if name in done:
            return
        for other in REGISTRY[name].depends_on:
            if other in wanted:
                visit(other)
        done.append(name)

    for name in wanted:
        visit(name)
    return done


def gate_input(ws: Workspace, name: str) -> dict[str, int]:
    """Rows of each input, once all of them pass."""
    if name in RAW_FILES:
        return {name: quality.check_raw(ws.spark, f"{ws.raw}/{RAW_FILES[name]}", RAW[name], name, options=RAW_OPTIONS.get(name))}
    return {other: quality.check_table(ws.spark, ws.path(other), TABLES[other], other, partition_by=PARTITIONS.get(other, ()), fmt=ws.fmt) for other in REGISTRY[name].depends_on}


def gate_output(ws: Workspace, name: str) -> int:
    return quality.check_table(ws.spark, ws.path(name), TABLES[name], name, keys=KEYS.get(name, ()), partition_by=PARTITIONS.get(name, ()), fmt=ws.fmt)


def run_table(ws: Workspace, name: str) -> int:
    """Rows written."""
    return REGISTRY[name].process(ws)


def run_gated(ws: Workspace, name: str) -> int:
    gate_input(ws, name)
    rows = run_table(ws, name)
    gate_output(ws, name)
    return rows


def _layer(ws: Workspace, layer: str, run: Callable[[Workspace, str], int]) -> dict[str, int]:
    return {name: run(ws, name) for name in in_order(n for n, of in LAYERS.items() if of == layer)}


def run_bronze(ws: Workspace) -> dict[str, int]:
    return _layer(ws, "bronze", run_table)


def run_silver(ws: Workspace) -> dict[str, int]:
    return _layer(ws, "silver", run_table)


def run_gold(ws: Workspace) -> dict[str, int]:
    return _layer(ws, "gold", run_table)


def run_all(ws: Workspace) -> dict[str, int]:
    """All tables, each gated; a gate that fails stops what follows."""
    return {name: run_gated(ws, name) for name in in_order(REGISTRY)}


def lookup(ws: Workspace, feature_name: str) -> DataFrame:
    return ws.read("feature_conversion_impact").filter(F.col("feature_name") == feature_name)
