import json
from pathlib import Path

import pytest
from pyspark.sql.types import ArrayType, StructType

from cohortlake import queries
from cohortlake.operators import profile, quality
from cohortlake.sources import raw, tables

SAMPLE = StructType().add("id", "integer").add("name", "string")


@pytest.fixture
def two(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], SAMPLE)


def test_check_schema(spark, two):
    quality.check_schema(two, SAMPLE, "t")
    quality.check_schema(two.selectExpr("*", "'x' AS email"), SAMPLE, "t")
    with pytest.raises(quality.SchemaValidationError, match="Missing columns"):
        quality.check_schema(two.select("id"), SAMPLE, "t")
    with pytest.raises(quality.SchemaValidationError, match="type mismatch"):
        quality.check_schema(two.selectExpr("CAST(id AS bigint) id", "name"), SAMPLE, "t")


def test_check_table(spark, two, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(quality.DataValidationError, match="not found"):
        quality.check_table(spark, path, SAMPLE, "t")
    assert tables.overwrite(two, path) == 2
    assert quality.check_table(spark, path, SAMPLE, "t", keys=["id"]) == 2
    with pytest.raises(quality.DataValidationError, match="at least 5 rows"):
        quality.check_table(spark, path, SAMPLE, "t", min_rows=5)
    tables.append(two, path)
    with pytest.raises(quality.DataValidationError, match="2 duplicate keys"):
        quality.check_table(spark, path, SAMPLE, "t", keys=["id"])
    tables.overwrite(tables.empty(spark, SAMPLE), path)
    with pytest.raises(quality.DataValidationError, match="at least 1 rows"):
        quality.check_table(spark, path, SAMPLE, "t")


def test_check_raw(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]))
    (tmp_path / "l.jsonl").write_text('{"id": 1, "name": "a"}\n{"id": "x", "name": "b"}\n{"broken\n')
    (tmp_path / "e.jsonl").write_text("")
    assert quality.check_raw(spark, str(tmp_path / "a.json"), SAMPLE, "a", options={"multiLine": True}) == 2
    assert quality.check_raw(spark, str(tmp_path / "l.jsonl"), SAMPLE, "l") == 3
    with pytest.raises(quality.DataValidationError, match="don't parse"):
        quality.check_raw(spark, str(tmp_path / "l.jsonl"), SAMPLE, "l", max_corrupt=0)
    with pytest.raises(quality.DataValidationError, match="empty"):
        quality.check_raw(spark, str(tmp_path / "e.jsonl"), SAMPLE, "e")
    with pytest.raises(quality.DataValidationError):
        quality.check_raw(spark, str(tmp_path / "none.jsonl"), SAMPLE, "n")


def test_overwrite_may_read_what_it_replaces(spark, two, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(two, path)
    assert tables.overwrite(tables.read(spark, path).unionAll(two), path) == 4
    assert tables.read(spark, path).count() == 4


@pytest.mark.parametrize("step", ["write_folder", "_rename", "publish", "tidy"])
@pytest.mark.parametrize("after", [False, True])
def test_overwrite_that_is_cut_off(spark, two, tmp_path, monkeypatch, step, after):
    """Before or after each step, the table is the old one or the new one; the first of all isn't there or is."""
    path, real = str(tmp_path / "t"), getattr(tables, step)

    def cut(*args, **options):
        if after:
            real(*args, **options)
        raise KeyboardInterrupt

    def interrupted(df):
        monkeypatch.setattr(tables, step, cut)
        with pytest.raises(KeyboardInterrupt):
            tables.overwrite(df, path)
        monkeypatch.undo()

    published = step == "tidy" or after and step in ("_rename", "publish")
    interrupted(two)
    assert tables.exists(spark, path) == published
    if published:
        assert tables.read(spark, path, SAMPLE).count() == 2
    tables.overwrite(two, path)
    reader = tables.read(spark, path)
    interrupted(two.limit(1))
    assert tables.exists(spark, path) and tables.read(spark, path).count() == (1 if published else 2)
    assert reader.count() == 2  # planned before, and read after
    assert tables.overwrite(two.unionAll(two), path) == 4 and tables.read(spark, path).count() == 4
    assert len(list((tmp_path / "t" / tables.DATA).iterdir())) == tables.KEPT and len(list((tmp_path / "t" / tables.SNAPSHOTS).glob("*.json"))) == tables.KEPT


def test_one_of_two_writers_fails(spark, two, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(two, path)
    now = tables.snapshot(spark, path)
    slow, _ = tables.write_folder(two.limit(1), path, now)
    tables.overwrite(two.unionAll(two), path)
    with pytest.raises(OSError, match="could not be renamed"):
        tables.publish(spark, path, now, {"": [slow]}, SAMPLE, {})
    assert tables.read(spark, path).count() == 4
    tables.overwrite(two, path)
    assert not (tmp_path / "t" / slow).exists()


def test_tables_of_earlier_layouts(spark, two, tmp_path):
    path = str(tmp_path / "t")
    two.write.parquet(f"{path}.old-1")  # what an overwrite left that was cut off between two renames
    assert tables.exists(spark, path) and tables.read(spark, path, SAMPLE).count() == 2 and (tmp_path / "t").exists()
    assert tables.overwrite(two.limit(1), path) == 1 and tables.read(spark, path).count() == 1
    assert {p.name for p in (tmp_path / "t").iterdir()} == {tables.DATA, tables.SNAPSHOTS}
    assert tables.append(two, path) == 2 and tables.read(spark, path).count() == 3
    at, files = tables._path(spark, path)
    with pytest.raises(OSError, match="could not be renamed"):  # Hadoop would move it inside
        tables._rename(files, at, at)


def test_other_columns_need_to_be_asked_for(spark, two, tmp_path):
    path = str(tmp_path / "t")
    tables.overwrite(two, path)
    with pytest.raises(ValueError, match="other columns"):
        tables.overwrite(two.selectExpr("id", "name AS title"), path)
    tables.overwrite(two.selectExpr("id", "name AS title"), path, replace_schema=True)
    assert tables.read(spark, path).columns == ["id", "title"]


def test_schema_of_partitioned_tables(spark, tmp_path):
    schema = StructType().add("id", "integer").add("note", "string").add("day", "string")
    tables.append(spark.createDataFrame([(1, "a", "2024-01-15")], schema), str(tmp_path / "t"), partition_by=["day"])
    assert quality.check_table(spark, str(tmp_path / "t"), schema, "t", partition_by=["day"]) == 1
    wrong = StructType().add("id", "integer").add("note", "integer").add("day", "string")
    with pytest.raises(quality.SchemaValidationError, match="note"):
        quality.check_table(spark, str(tmp_path / "t"), wrong, "t", partition_by=["day"])
    with pytest.raises(quality.SchemaValidationError, match="day"):
        quality.check_table(spark, str(tmp_path / "t"), schema, "t")


def test_preview(spark, two):
    assert [tuple(r) for r in profile.preview(two, ["name"], 1).collect()] == [(1, "a")]
    assert tuple(profile.summary(two).first()) == (2, "id int, name string")


def test_partitions_prune_and_keep_their_type(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = StructType().add("id", "integer").add("day", "string")
    tables.append(spark.createDataFrame([(1, "2024-01-15"), (2, "2024-01-16")], schema), path, partition_by=["day"])
    assert sorted(p.name for p in (tmp_path / "t").glob("day=*")) == ["day=2024-01-15", "day=2024-01-16"]
    df = tables.read(spark, path, schema).filter("day >= '2024-01-16'")
    assert df.collect() == [(2, "2024-01-16")]
    assert "PartitionFilters: [isnotnull(day" in df._jdf.queryExecution().toString()


def test_views_and_readers(spark, two, tmp_path):
    tables.register_views({"two_rows": two})
    assert spark.sql("SELECT count(*) FROM two_rows").first()[0] == 2
    (tmp_path / "a.json").write_text('[{"id": 1, "more": 2}]')
    assert raw.read_json_array(spark, str(tmp_path / "a.json"), SAMPLE).collect() == [(1, None)]


def jobs_of(spark, run):
    """Spark jobs that run() starts."""
    spark.sparkContext.setJobGroup(name := f"group {id(run)}", "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_gates_know_what_was_observed(spark, two, tmp_path):
    path, gate = str(tmp_path / "t"), lambda **k: quality.check_table(spark, str(tmp_path / "t"), SAMPLE, "t", **k)
    tables.overwrite(two, path, observed=quality.observed(["id"]))
    assert jobs_of(spark, lambda: gate()) == 0 and gate() == 2 and gate(keys=["id"]) == 2
    with pytest.raises(quality.DataValidationError, match="has 2 rows, expected at least 3 rows"):
        gate(min_rows=3)
    tables.overwrite(two.selectExpr("IF(id = 1, NULL, id) AS id", "name"), path, observed=quality.observed(["id"]))
    with pytest.raises(quality.DataValidationError, match="1 null keys in id"):
        gate(keys=["id"])
    tables.overwrite(two.unionAll(two), path, observed=quality.observed(["id"]))
    with pytest.raises(quality.DataValidationError, match="0 null and 2 duplicate keys in id"):
        gate(keys=["id"])
    tables.overwrite(tables.empty(spark, SAMPLE), path, observed=quality.observed(["id"]))
    with pytest.raises(quality.DataValidationError, match="has 0 rows"):
        gate(keys=["id"])
    tables.append(two, path)  # not observed: counted again
    assert gate() == 2 and jobs_of(spark, lambda: gate()) > 0


@pytest.mark.parametrize("layout", ["lines", "lines, no spaces", "indented", "tabs", "one line"])
def test_json_arrays_by_records(spark, tmp_path, layout):
    schema = StructType().add("id", "integer").add("name", "string").add("tags", ArrayType(StructType().add("a", "integer")))
    rows = [{"id": i, "name": ["a", "}, {", "x\n  }\n]", None, "[é,"][i % 5], "tags": [{"a": k} for k in range(i % 3)]} for i in range(3_000)]
    text = {"lines": "[\n" + ",\n".join(map(json.dumps, rows)) + "\n]\n", "lines, no spaces": "[\r\n" + "\r\n,".join(json.dumps(r, separators=(",", ":")) for r in rows) + "]",
            "indented": json.dumps(rows, indent=2), "tabs": json.dumps(rows, indent="\t") + "\n\n", "one line": json.dumps(rows)}[layout]
    (tmp_path / "a.json").write_text(text)
    path = str(tmp_path / "a.json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = raw.read_json_array(spark, path, schema)
        parts = df.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(repr, df.collect())) == sorted(map(repr, raw.read_raw(spark, path, schema, options={"multiLine": True}).collect()))
    assert df.count() == 3_000 and (parts == 1 if layout == "one line" else parts > 2)
    if layout == "one line":
        with pytest.raises(ValueError, match="more than the 1000"):
            raw.read_json_array(spark, path, schema, most_in_one_task=1000)


def test_odd_json_arrays(spark, tmp_path):
    for name, text, n in (("empty", "[]", 0), ("lines", "[\n]", 0), ("one", '[\n  {\n    "id": 1\n  }\n]', 1), ("single", '[\n{"id": 1}\n]', 1), ("typed", '[\n{"id": "x", "name": "b"},\n{"id": 2}\n]', 2)):
        (tmp_path / name).write_text(text)
        assert raw.read_json_array(spark, str(tmp_path / name), SAMPLE).count() == n
    (tmp_path / "mixed").write_text('[\n{"id": 1},\n{"id": 2,\n"name": "b"}\n]')
    with pytest.raises(Exception, match="doesn't parse"):
        raw.read_json_array(spark, str(tmp_path / "mixed"), SAMPLE).collect()


def test_json_arrays_are_written_as_rows_pass(spark, tmp_path):
    """One array for each task of the input, of which nobody holds or sorts the whole."""
    rows = [(i, i % 7, None if i % 5 == 0 else f"a, [{{\n\"{i}") for i in range(500)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string")
    orders.repartition(9).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    try:
        found = queries.q_json_array(spark, str(tmp_path))
        files = [Path(f.removeprefix("file://")) for f in found.inputFiles()]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(files) > 4 and sorted(map(tuple, found.collect())) == rows
    assert sorted(r["o_orderkey"] for f in files for r in json.loads(f.read_text())) == [r[0] for r in rows]
    for n, empty in enumerate((orders.limit(0), orders.filter("o_orderkey < 0").repartition(3))):
        raw.write_json_array(empty, f"{tmp_path}/empty{n}")
        assert raw.read_json_array(spark, f"{tmp_path}/empty{n}", orders.schema).collect() == []
