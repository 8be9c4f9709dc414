import datetime
import random

import pytest
from pyspark.sql import functions as F

from cohortlake.functions.columns import iso_date
from cohortlake.operators import scd2
from cohortlake.sources import history as histories
from cohortlake.sources import tables
from cohortlake.sources.history import CLOSED, CURRENT, History

D = datetime.date.fromisoformat
SCHEMA = "k int, name string, day string"


def versions(spark, rows):
    return scd2.versions(spark.createDataFrame(rows, SCHEMA), "k", iso_date("day"), ["name"])


def whole(spark, rows):
    return scd2.initial(spark.createDataFrame(rows, SCHEMA), "k", iso_date("day"), ["name"], collapse_unchanged=True)


def lines(df):
    return sorted(map(repr, df.collect()))


def files(tmp_path):
    return {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("part-*.parquet")}


@pytest.fixture
def made(spark, tmp_path):
    rows = [(k, f"a{k % 3}", "2024-01-01") for k in range(1000)] + [(k, "b", "2024-02-01") for k in range(0, 1000, 2)] + [(None, "n", "2024-01-01")]
    table = History(spark, str(tmp_path / "h"), "k", whole(spark, rows).schema)
    assert table.create(whole(spark, rows)) == 1501
    return table, rows


def test_a_small_batch_rewrites_few_files(spark, tmp_path, made):
    table, rows = made
    before = files(tmp_path)
    batch = [(k, "c", "2024-03-01") for k in range(7, 1000, 100)] + [(5, "a2", "2024-03-01"), (6, "old", "2024-01-15")]  # one that changes nothing, one that is late
    assert table.merge(versions(spark, batch)) > 0
    # the state before is kept for its readers; what the new one doesn't hold any more was rewritten
    held = {f"h/{f}" for f in tables.snapshot(spark, table.path).folders()}
    rewritten = {f for f in before if f.rpartition("/")[0] not in held}
    assert 0 < len(rewritten) < 0.05 * len(before) and all(f"={CURRENT}/" in f for f in rewritten)
    assert lines(table.read()) == lines(whole(spark, rows + batch[:-1]))
    assert lines(table.current()) == lines(whole(spark, rows + batch[:-1]).filter("is_current"))
    after = files(tmp_path)
    assert table.merge(versions(spark, batch)) == 0 and files(tmp_path) == after  # again


def test_batches_equal_the_one_shot_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(histories, "MOST_FOLDERS", 2)
    rng = random.Random(6)
    rows = sorted(((rng.choice([*range(12), None]), rng.choice("xyz"), str(D("2024-01-01") + datetime.timedelta(n))) for n in range(80)), key=lambda r: r[2])
    rows = list({(k, d): (k, v, d) for k, v, d in rows}.values())
    table = History(spark, str(tmp_path / "h"), "k", whole(spark, rows).schema, n_buckets=4)
    for n, i in enumerate(range(0, len(rows), 16)):
        table.merge(versions(spark, rows[i:i + 16]), batch=("feed", n))
        assert lines(table.read()) == lines(whole(spark, rows[:i + 16])) and table.last_batch("feed") == n
    assert table.merge(versions(spark, [(1, "never", "2025-01-01")]), batch=("feed", 2)) == 0 and lines(table.read()) == lines(whole(spark, rows))
    parts = tables.snapshot(spark, table.path).parts
    assert all(len(f) == 1 for p, f in parts.items() if f"={CURRENT}/" in p) and max(len(f) for p, f in parts.items() if f"={CLOSED}/" in p) <= 2
    # nothing is left on disk but what the last two states hold
    assert len(files(tmp_path)) <= 2 * sum(map(len, parts.values()))
    with pytest.raises(ValueError, match="4 buckets"):
        History(spark, table.path, "k", table.schema).merge(versions(spark, rows[:1]))


def test_late_batches_in_any_order_equal_the_history_of_all(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice([*range(9), None]), rng.choice("xyz"), str(D("2024-01-01") + datetime.timedelta(rng.randrange(40)))) for _ in range(90)]
    everything = scd2.versions(spark.createDataFrame(rows, SCHEMA), "k", iso_date("day"), ["name"], tie_break=["name"])
    wanted = scd2.rebuild(whole(spark, rows).limit(0), everything, "k")
    for turn in range(2):
        table = History(spark, str(tmp_path / f"h{turn}"), "k", whole(spark, rows).schema, n_buckets=8)
        rng.shuffle(rows)
        for n, i in enumerate(range(0, len(rows), 23)):
            batch = scd2.versions(spark.createDataFrame(rows[i:i + 23], SCHEMA), "k", iso_date("day"), ["name"], tie_break=["name"])
            for _ in range(2):
                table.merge_late(batch, batch=("late", n), tie_break=["name"])
        assert lines(table.read()) == lines(wanted) == lines(tables.read(spark, table.path)) and table.last_batch("late") == 3
        assert lines(table.current()) == lines(wanted.filter("is_current"))


def test_keys_whose_last_version_was_ended_stay(spark, tmp_path):
    ended = whole(spark, [(1, "a", "2024-01-01"), (2, "a", "2024-01-01")]).withColumn("is_current", F.col("k") == 2)
    table = History(spark, str(tmp_path / "h"), "k", ended.schema, n_buckets=2)
    table.create(ended)
    batch = versions(spark, [(1, "b", "2024-05-01"), (2, "b", "2024-05-01"), (3, "b", "2024-05-01")])
    table.merge(batch)
    assert lines(table.read()) == lines(scd2.apply(ended, batch, "k"))


def test_empty_batches_and_tables(spark, tmp_path):
    nothing = whole(spark, [])
    table = History(spark, str(tmp_path / "h"), "k", nothing.schema, n_buckets=2)
    assert table.merge(versions(spark, []), batch=("feed", 0)) == 0 and table.read().collect() == [] and table.last_batch("feed") == 0
    assert table.merge(versions(spark, [(1, "a", "2024-01-01")]), batch=("feed", 1)) == 1
    assert table.merge_late(versions(spark, [])) == 0 and table.current().count() == 1
