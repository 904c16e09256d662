"""Package folders: what is written is read back, and awkward files are told apart."""

from pyspark.sql import functions as F

from tidemark.operators import contracts
from tidemark.sources import packages


def test_tables_are_read_back_without_private_columns(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, "x", 9), ("b", 2, None, 9)], "run_id string, n bigint, text string, _hidden int")
    packages.write_table(d, f"file://{tmp_path}", "rows")
    schema = packages.public(d).schema
    assert sorted(map(tuple, packages.read_table(spark, f"file://{tmp_path}", "rows", schema).select("run_id", "n", "text").collect())) == [("a", 1, "x"), ("b", 2, None)]
    assert packages.public(d, "z").columns == ["run_id", "n", "text"] and {r.run_id for r in packages.public(d, "z").collect()} == {"z"}


def test_reports_and_plans(spark, tmp_path):
    s = spark.createDataFrame([("a", 61_000, 62_500, "cut", "pause"), ("a", 0, 1_000, "move", "hook")], "run_id string, start_ms bigint, end_ms bigint, operation string, note string")
    packages.write_report(s, f"file://{tmp_path}/report")
    assert [tuple(r) for r in spark.read.csv(f"file://{tmp_path}/report", header=True).orderBy("start").collect()] == [("a", "0:00", "0:01", "1.0"), ("a", "1:01", "1:02", "1.5")]
    assert packages.edit_plan(s).first().plan == "1. 0:00-0:01 move hook\n2. 1:01-1:02 cut pause"


def test_file_bytes_and_content_checks(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "a.jpg").write_bytes(b"\xff\xd8\xff" + b"0" * 20)
    (tmp_path / "data" / "b.zip").write_bytes(b"no zip")
    f = packages.file_bytes(spark, f"{tmp_path}/data").withColumn("run_id", F.lit("r"))
    rows = {r.path: r for r in f.collect()}
    assert set(rows) == {"a.jpg", "b.zip"} and rows["a.jpg"].bytes == 23 and rows["a.jpg"].head.startswith("FFD8FF30")
    listed = f.select("run_id", "path", F.when(F.col("path") == "a.jpg", F.col("sha256")).otherwise("0").alias("sha256"), F.col("bytes"))
    got = {(r.rule, r.row_key) for r in contracts.content_problems(f.select("run_id", "path", "content"), listed).collect()}
    assert got == {("hash", "b.zip"), ("type", "b.zip")}
    (tmp_path / "one.json").write_text('{\n "a": 1\n}')
    assert packages.whole_json(spark, f"{tmp_path}/one.json", "a int").first().a == 1


def test_runs_of_projects(spark):
    r = spark.createDataFrame([("p", "r1", 1, "analysis"), ("p", "r2", 2, "media"), ("q", "r3", 1, "media"), ("e", None, None, None)], "project_id string, run_id string, created_at int, package_kind string")
    assert {tuple(x) for x in packages.active_runs(r).collect()} == {("p", "r2", "ready"), ("q", "r3", "partial"), ("e", None, "empty")}
    assert [x.run_id for x in packages.orphans(spark.createDataFrame([("r1",), ("r9",)], "run_id string"), r).collect()] == ["r9"]
    files = spark.createDataFrame([("r", "reports/a.srt", 1), ("r", "data/x.jsonl", 2), ("r", "clip.mp4", 3)], "run_id string, path string, bytes int")
    assert {(x.path, x.kind) for x in packages.catalogue(files).collect()} == {("reports/a.srt", "text"), ("data/x.jsonl", "records"), ("clip.mp4", "media")}
