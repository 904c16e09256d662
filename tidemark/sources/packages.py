"""Run packages in folders: tables as JSON lines, reports as CSV, edit plans as text, files with their bytes and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import clock


def public(df: DataFrame, run: str | None = None) -> DataFrame:
    """df without its private columns (those that begin with _), stamped with a run where one is given."""
    out = df.drop(*[c for c in df.columns if c.startswith("_")])
    return out if run is None else out.withColumn("run_id", F.lit(run))


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Compact JSON lines, one folder per table and run; nulls are left out of a line."""
    public(df).write.mode("overwrite").partitionBy("run_id").json(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{name}")


def whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document, however many lines it has."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_report(spans: DataFrame, folder: str) -> None:
    """Spans with their times as clock text, in order, as CSV with a header."""
    text = spans.orderBy("run_id", "start_ms").select("run_id", clock(F.col("start_ms")).alias("start"), clock(F.col("end_ms")).alias("end"), F.round((F.col("end_ms") - F.col("start_ms")) / 1000, 3).alias("seconds"))
    text.write.mode("overwrite").csv(folder, header=True)


def edit_plan(edits: DataFrame) -> DataFrame:
    """run_id, plan: a numbered line per edit (operation, start_ms, end_ms, note) in order of time. Edits of a run are few."""
    line = F.struct("start_ms", "end_ms", F.concat_ws(" ", F.concat(clock(F.col("start_ms")), F.lit("-"), clock(F.col("end_ms"))), "operation", "note").alias("line"))
    rows = edits.groupBy("run_id").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    return rows.select("run_id", F.array_join(F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r.line)), "\n").alias("plan"))


def file_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), content, bytes, sha256, head (first 16 bytes as hexadecimal digits) of every file."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    below = F.regexp_extract("path", r"^(?:file:)?/*" + folder.removeprefix("file:").strip("/").replace(".", r"\.") + r"/(.*)$", 1)
    return f.select(below.alias("path"), "content", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.hex(F.substring("content", 1, 16)).alias("head"))


def catalogue(manifest: DataFrame) -> DataFrame:
    """What a run offers for download: run_id, path, kind by its suffix, bytes; in order of path."""
    kind = F.when(F.col("path").rlike(r"\.(srt|vtt|txt)$"), "text").when(F.col("path").rlike(r"\.csv$"), "table").when(F.col("path").rlike(r"\.jsonl?$"), "records").otherwise("media")
    return manifest.select("run_id", "path", kind.alias("kind"), "bytes")


def orphans(folders: DataFrame, runs: DataFrame) -> DataFrame:
    """Run folders that no run row names."""
    return folders.join(runs.select("run_id"), "run_id", "left_anti")


def active_runs(runs: DataFrame) -> DataFrame:
    """project_id, active_run: each project's newest run (created_at; ties: the larger id), and its state by what its runs hold."""
    full = F.max(F.col("package_kind") == "analysis")
    return runs.groupBy("project_id").agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("active_run"), F.when(F.count("run_id") == 0, "empty").when(full, "ready").otherwise("partial").alias("state"))
