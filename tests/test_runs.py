import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortlake.functions.columns import iso_date
from cohortlake.operators import ingest, quality, scd2
from cohortlake.plans import registry
from cohortlake.schemas import RAW, TABLES
from cohortlake.sources import tables
from cohortlake.sources.history import History
from cohortlake.streaming import bronze


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    lines = lambda rows: "".join(json.dumps(r) + "\n" for r in rows)
    (folder / "feature_releases.json").write_text(json.dumps([{"id": 1, "name": "boards", "release_date": "2024-01-01", "version": "r1"}, {"id": 1, "name": "boards", "release_date": "2024-06-01", "version": "r2"}]))
    (folder / "user_signups.jsonl").write_text(lines({"user_id": u, "email": f"someone{u}@example.net", "signup_date": f"2024-06-{10 + u}", "company_size": "11-50", "industry": "retail"} for u in (1, 2)))
    (folder / "feature_usage_events.jsonl").write_text(lines([{"timestamp": t, "user_id": 1, "feature_id": 1, "feature_name": "boards", "event_type": "click"} for t in ("2024-07-01 08:05:07", "2024-07-01 08:05:07", "bad")]))
    (folder / "conversions.jsonl").write_text(lines([{"user_id": 1, "conversion_date": "2024-07-10", "plan": "team", "mrr": 41, "signup_date": "2024-06-11", "days_to_convert": 29, "used_real_time_collab": True}]))
    return str(folder)


def test_all_tables(spark, raw, tmp_path):
    ws = registry.Workspace(spark, raw, str(tmp_path / "tables"), as_of=datetime.date(2024, 8, 1))
    assert registry.run_all(ws) == {"feature_releases": 2, "user_signups": 2, "feature_usage_events": 3, "conversions": 1, "feature_states": 2, "user_dim": 2, "feature_usage_facts": 1, "feature_conversion_impact": 2}
    for name, schema in TABLES.items():
        assert [(f.name, f.dataType) for f in ws.read(name).schema] == [(f.name, f.dataType) for f in schema]
    assert {(r.cohort, r.total_users, r.avg_days_to_convert) for r in registry.lookup(ws, "boards").collect()} == {("used_feature", 1, 29.0), ("available_not_used", 1, None)}
    # another run appends to bronze, and leaves history and gold as they are
    before = ws.read("feature_conversion_impact").collect()
    assert registry.run_bronze(ws)["user_signups"] == 2 and registry.run_silver(ws)["feature_states"] == 2
    assert registry.run_gold(ws) == {"feature_conversion_impact": 2} and sorted(ws.read("feature_conversion_impact").collect()) == sorted(before)


def test_gate_stops_what_follows(spark, raw, tmp_path):
    ws = registry.Workspace(spark, raw, str(tmp_path / "tables"))
    with pytest.raises(quality.DataValidationError, match="not found"):
        registry.run_gated(ws, "user_dim")


def test_dedupe_makes_reruns_harmless(spark, raw, tmp_path):
    ws = registry.Workspace(spark, raw, str(tmp_path / "tables"), dedupe=True)
    registry.run_bronze(ws)
    assert set(registry.run_bronze(ws).values()) == {0}


def test_order():
    order = registry.in_order(reversed([*registry.REGISTRY]))
    assert all(order.index(d) < order.index(n) for n, t in registry.REGISTRY.items() for d in t.depends_on)


def test_event_ids_are_stable_and_unique(spark, raw):
    read = spark.read.schema(RAW["feature_usage_events"]).json(f"{raw}/feature_usage_events.jsonl")
    ids = [sorted(r.event_id for r in ingest.feature_usage_events(read).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 3


def test_new_versions_through_the_registry(spark, raw, tmp_path):
    ws = registry.Workspace(spark, raw, str(tmp_path / "tables"), dedupe=True)
    registry.run_all(ws)
    releases = json.loads((Path(raw) / "feature_releases.json").read_text())
    releases += [{"id": 1, "name": "boards", "release_date": "2024-09-01", "version": "r3"}, {"id": 2, "name": "exports", "release_date": "2024-08-01", "version": "r1"}]
    (Path(raw) / "feature_releases.json").write_text(json.dumps(releases))
    assert registry.run_all(ws)["feature_releases"] == 2
    states = {(r.feature_id, r.version): (str(r.effective_to), r.is_current) for r in ws.read("feature_states").collect()}
    assert states == {(1, "r1"): ("2024-06-01", False), (1, "r2"): ("2024-09-01", False), (1, "r3"): ("9999-12-31", True), (2, "r1"): ("9999-12-31", True)}


def test_equal_records_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(ingest, "RUN_ROWS", 3)
    df = spark.createDataFrame([("a", None)] * 8 + [(None, "a"), ("", None), (None, None)], "x string, y string")
    found = ingest.with_stable_id(df, ["x", "y"]).collect()
    assert len(found) == 11 and len({r.event_id for r in found}) == 11 and sum(r.x == "a" for r in found) == 8
    assert {r.event_id for r in found} == {r.event_id for r in ingest.with_stable_id(df.repartition(3), ["x", "y"]).collect()}
    some = ingest.with_stable_id(df.withColumn("z", F.lit(1)), ["x", "y"]).collect()
    assert {r.event_id for r in some} == {r.event_id for r in found}


def test_records_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(ingest, "natural_id", lambda *natural: F.lit(1))
    known = spark.createDataFrame([("a", None)], "x string, y string")
    new = spark.createDataFrame([("a", None), ("b", None), ("b", None), (None, "a")], "x string, y string")
    assert sorted(map(repr, ingest.unseen(new, known, ["x", "y"]).collect())) == ["Row(x='b', y=None)", "Row(x=None, y='a')"]


def lines(*events):
    return "".join(json.dumps(dict(zip(RAW["feature_usage_events"].names, e))) + "\n" for e in events)


def test_stream_equals_batch(spark, raw, tmp_path):
    """Ids are those of a batch ingest; a run that finds nothing new changes nothing."""
    path, incoming = str(tmp_path / "stream"), tmp_path / "incoming"
    incoming.mkdir()
    (incoming / "a.jsonl").write_text((Path(raw) / "feature_usage_events.jsonl").read_text())
    for _ in range(2):
        bronze.ingest_available(spark, str(incoming), f"{path}/events", f"{path}/checkpoint")
    ws = registry.Workspace(spark, raw, str(tmp_path / "tables"))
    registry.run_table(ws, "feature_usage_events")
    columns = [c for c in TABLES["feature_usage_events"].names if c != "ingestion_timestamp"]
    streamed, batch = (sorted(map(repr, df.select(*columns).collect())) for df in (tables.read(spark, f"{path}/events", TABLES["feature_usage_events"]), ws.read("feature_usage_events")))
    assert streamed == batch and len(batch) == 3  # two equal events, and one without a time
    assert [tuple(r) for r in bronze.daily_counts(spark.read.parquet(f"{path}/events")).filter("event_date IS NOT NULL").collect()] == [(datetime.date(2024, 7, 1), "click", 2)]


def test_stream_loses_nothing_whatever_the_order(spark, tmp_path):
    """Events older than any watermark, repeated in and over files, in files that come one by one or together."""
    old, new, none = ("2024-03-01 10:00:00", 1, 1, "f", "view"), ("2024-03-20 10:00:00", 1, 1, "f", "view"), (None, 2, 1, "f", "click")
    files = {"a": [new, new, new], "b": [old, new], "c": [none, old, old, ("bad", 1, 1, "f", "view")], "d": [new, none]}
    found = []
    for order in (["a", "b", "c", "d"], ["d", "c", "b", "a"], ["abcd"]):
        path, incoming = tmp_path / f"s{len(found)}", tmp_path / f"in{len(found)}"
        incoming.mkdir()
        for step in order:
            for name in step:
                (incoming / f"{name}.jsonl").write_text(lines(*files[name]))
            bronze.ingest_available(spark, str(incoming), f"{path}/events", f"{path}/checkpoint", files_at_once=2)
        rows = tables.read(spark, f"{path}/events", TABLES["feature_usage_events"]).drop("ingestion_timestamp").collect()
        assert len({r.event_id for r in rows}) == len(rows) == 7
        found.append(sorted(map(repr, rows)))
    assert found[0] == found[1] == found[2]


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    incoming, path = tmp_path / "in", tmp_path / "s"
    incoming.mkdir()
    (incoming / "a.jsonl").write_text(lines(("2024-03-01 10:00:00", 1, 1, "f", "view"), ("2024-03-01 10:00:00", 1, 1, "f", "view")))
    for checkpoint in ("one", "two"):  # another checkpoint knows of no file
        bronze.ingest_available(spark, str(incoming), f"{path}/events", f"{path}/{checkpoint}")
    assert spark.read.parquet(f"{path}/events").count() == 2


def test_history_from_a_stream(spark, tmp_path):
    schema = RAW["feature_releases"]
    rows = [(k, f"f{k}", f"2024-0{m}-01", v) for k in (1, 2) for m, v in ((1, "a"), (3, "b"), (5, "b"), (7, "a"))] + [(1, "f1", "2024-04-01", "c"), (2, "f2", "2024-07-01", "z"), (3, "f3", "soon", "a")]
    of = lambda df: scd2.versions(df, "id", iso_date("release_date"), ["name", "version"], tie_break=["version"])
    everything = of(spark.createDataFrame(rows, schema))
    wanted = sorted(map(repr, scd2.initial(spark.createDataFrame(rows, schema), "id", iso_date("release_date"), ["name", "version"], tie_break=["version"], collapse_unchanged=True).collect()))
    for turn, order in enumerate((rows, rows[::-1])):
        incoming, path = tmp_path / f"in{turn}", tmp_path / f"h{turn}"
        incoming.mkdir()
        for i, r in enumerate(order):
            (incoming / f"{i:02d}.jsonl").write_text(json.dumps(dict(zip(schema.names, r))) + "\n")
        history = History(spark, f"{path}/t", "id", scd2.initial(everything.limit(0).withColumn("release_date", F.lit("")), "id", iso_date("release_date"), ["name", "version"]).schema, n_buckets=2)
        for _ in range(2):
            bronze.history_available(spark, str(incoming), schema, history, f"{path}/checkpoint", of, feed="releases", tie_break=["version"], files_at_once=4)
        assert history.last_batch("releases") == 2 and sorted(map(repr, history.read().collect())) == wanted
        # the last batch once more, as after a driver that died between merging and noting it
        assert history.merge_late(of(spark.createDataFrame([(1, "f1", "2030-01-01", "x")], schema)), batch=("releases", 2)) == 0


def test_facts_are_kept_up_to_date(spark, tmp_path):
    """Three batches, the last with events of earlier days and none, equal one run over all; only days that have grown are read."""
    raw, event = tmp_path / "raw", lambda t, u, f: (t, u, f, "f", "view")
    raw.mkdir()
    ws = registry.Workspace(spark, str(raw), str(tmp_path / "tables"), as_of=datetime.date(2024, 8, 1))
    batches = [
        [event(f"2024-01-{d:02d} 10:00:00", u, 1) for d in (1, 5, 9) for u in (1, 2)],
        [event("2024-01-20 10:00:00", 1, 1), event("2024-01-20 10:00:00", 3, 1), event("bad", 4, 1)],
        [event("2024-01-05 11:00:00", 1, 1), event("2023-12-01 10:00:00", 2, 2), event(None, 4, 1), event("2024-01-20 10:00:00", 1, 1)],
    ]
    for n, batch in enumerate(batches):
        (raw / registry.RAW_FILES["feature_usage_events"]).write_text(lines(*batch))
        registry.run_table(ws, "feature_usage_events")
        if n:
            new, marks, _ = registry.new_events(ws)
            assert new.count() == len(batch) and len(marks) > n
            plan = new._jdf.queryExecution().toString()
            assert "PartitionFilters: [" in plan and "2024-01-09" not in plan
            assert ("2024-01-20" in plan) and all("event_date=2024-01-09" not in f and "event_date=2024-01-01" not in f for f in read_files(new))
        registry.run_table(ws, "feature_usage_facts")
        rows = sorted(map(repr, ws.read("feature_usage_facts").collect()))
        assert registry.new_events(ws)[0].count() == 0
        assert registry.run_table(ws, "feature_usage_facts") == len(rows) and sorted(map(repr, ws.read("feature_usage_facts").collect())) == rows
    registry._usage_facts(ws, afresh=True)
    assert sorted(map(repr, ws.read("feature_usage_facts").collect())) == rows and len(rows) == 5


def read_files(df):
    return [r[0] for r in df.select("_metadata.file_path").distinct().collect()]


def test_a_rerun_reads_the_partitions_of_its_records_alone(spark, tmp_path):
    schema = TABLES["user_signups"]
    rows = [(u, "e", d, "s", "i", datetime.datetime(2024, 1, 1)) for u, d in ((1, "2024-01-01"), (2, "2024-01-02"), (3, None), (4, "2024-01-04"))]
    tables.append(spark.createDataFrame(rows, schema), str(tmp_path / "t"), partition_by=["signup_date"])
    known = tables.read(spark, str(tmp_path / "t"), schema)
    for values, wanted in ((["2024-01-02", "2025-01-01"], [2]), ([None, "2024-01-04"], [3, 4]), ([None], [3]), (["2025-01-01"], []), ([], [])):
        new = spark.createDataFrame([(v,) for v in values], "signup_date string")
        found = ingest.partitions_of(new, known, "signup_date")
        assert sorted(r.user_id for r in found.collect()) == wanted and len(read_files(found)) == len(wanted)


def test_appends_are_noted_once_a_filter_is_kept(spark, raw, tmp_path):
    """A run that doesn't skip what is there doesn't make the next one that does take it again."""
    runs = [registry.Workspace(spark, raw, str(tmp_path / "tables"), dedupe=d) for d in (True, False, True)]
    (Path(raw) / "user_signups.jsonl").write_text(json.dumps({"user_id": 8, "email": "e", "signup_date": "2024-06-30", "company_size": "1", "industry": "i"}) + "\n")
    assert registry.run_table(runs[0], "user_signups") == 1
    (Path(raw) / "user_signups.jsonl").write_text(json.dumps({"user_id": 9, "email": "e", "signup_date": "2024-06-30", "company_size": "1", "industry": "i"}) + "\n")
    assert registry.run_table(runs[1], "user_signups") == 1 and registry.run_table(runs[2], "user_signups") == 0
