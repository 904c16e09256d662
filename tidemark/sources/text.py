"""Readers and writers of timed text: plain scripts, subtitle cues, record lines, journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.text import cue_time, is_json, parse_cue_time, word_count

#: Milliseconds per spoken word (150 words a minute) and the shortest segment.
WORD_MS, LEAST_MS = 400, 1000


def timed_segments(texts: DataFrame, run: str = "doc_id", text: str = "text") -> DataFrame:
    """run_id, seg_idx, start_ms, end_ms, text: sentences of plain text on a timeline of 150 words a minute, one second at least."""
    marked = F.regexp_replace(F.col(text), r"([.!?])[ \t]+", "$1\n")
    lines = F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    x = texts.select(F.col(run).alias("run_id"), F.posexplode(lines).alias("seg_idx", "text"))
    x = x.withColumn("_ms", F.greatest(F.lit(LEAST_MS), word_count(F.col("text")) * WORD_MS).cast("bigint"))
    end = F.sum("_ms").over(Window.partitionBy("run_id").orderBy("seg_idx"))
    return x.withColumn("end_ms", end).select("run_id", "seg_idx", (F.col("end_ms") - F.col("_ms")).alias("start_ms"), "end_ms", "text")


def subtitle_cues(files: DataFrame, run: str = "path", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(cues, rejected) of whole subtitle files: blocks with a `-->` line, markup taken out, empty or reversed cues rejected."""
    blocks = files.select(F.col(run).alias("run_id"), F.posexplode(F.split(F.regexp_replace(value, "\r\n?", "\n"), r"\n[ \t]*\n")).alias("block", "raw"))
    line = F.regexp_extract("raw", r"(?m)^(.*-->.*)$", 1)
    sides = F.split(line, "-->")
    body = F.regexp_replace(F.regexp_extract("raw", r"(?s)-->[^\n]*\n(.*)$", 1), r"<[^>]*>|\{[^}]*\}", "")
    text = F.trim(F.regexp_replace(body, r"\s+", " "))
    cues = blocks.where(line != "").select("run_id", "block", parse_cue_time(F.trim(sides[0])).alias("start_ms"), parse_cue_time(F.regexp_extract(F.trim(sides[1]), r"^\S+", 0)).alias("end_ms"), text.alias("text"))
    good = (F.col("end_ms") > F.col("start_ms")) & (F.col("text") != "")
    order = Window.partitionBy("run_id").orderBy("start_ms", "block")
    return cues.where(good).withColumn("seg_idx", F.row_number().over(order) - 1).drop("block"), cues.where(~good)


def record_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): JSON lines of a declared schema; lines that do not fit come with their file. NaN and Infinity do not fit."""
    full = StructType([*schema.fields]).add("_bad", "string")
    df = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("allowNonNumericNumbers", False).json(path)
    df = df.withColumn("_file", F.input_file_name())
    return df.where("_bad is null").drop("_bad", "_file"), df.where("_bad is not null").select("_file", "_bad")


def parsed_lines(files: DataFrame, schema: StructType, torn_tail: bool = False) -> DataFrame:
    """file, line (from 1), raw, row, problem (null for good lines) of the non-blank lines of whole files (file, value), batch or stream alike.

    A line must be one JSON object of the schema, without unknown fields, NaN or Infinity. With torn_tail, a last line that is no JSON is dropped,
    as after a crash; another bad line is reported. Files are read whole: a package's tables have a size limit.
    """
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("line", "raw"), F.size(F.split("value", "\n")).alias("_n"))
    lines = lines.where("trim(raw) != ''").withColumns({"line": F.col("line") + 1, "raw": F.rtrim(F.regexp_replace("raw", "\r$", ""))})
    full = StructType([*schema.fields]).add("_bad", "string")
    row = F.from_json("raw", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"})
    keys = F.json_object_keys("raw")
    x = lines.withColumns({"_row": row, "_json": is_json(F.col("raw"))})
    unknown = F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: ~k.isin([f.name for f in schema.fields]))
    problem = F.when(~F.col("_json"), "not JSON").when(keys.isNull(), "not an object").when(unknown, "unknown field").when(F.col("_row._bad").isNotNull(), "wrong type")
    x = x.withColumn("problem", problem)
    if torn_tail:
        x = x.where((F.col("line") < F.col("_n")) | ~F.coalesce(F.col("problem") == "not JSON", F.lit(False)))
    kept = F.struct(*[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields])
    return x.select("file", "line", "raw", F.when(F.col("problem").isNull(), kept).alias("row"), "problem")


def journal(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(events, bad): a journal in which only the last line of a file may be torn; other bad lines come out."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    x = text.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("trim(line) != ''")
    x = x.withColumn("row", F.from_json("line", schema)).withColumn("fits", F.col("row").isNotNull() & F.col("line").rlike(r"\}\s*$"))
    last = F.max("pos").over(Window.partitionBy("file")) == F.col("pos")
    x = x.withColumn("last", last)
    return x.where("fits").select("file", "pos", "row.*"), x.where("not fits and not last").select("file", "pos", "line")


def subtitle_lines(segments: DataFrame) -> DataFrame:
    """run_id, seg_idx, cue: one numbered subtitle block per segment."""
    cue = F.concat((F.col("seg_idx") + 1).cast("string"), F.lit("\n"), cue_time(F.col("start_ms")), F.lit(" --> "), cue_time(F.col("end_ms")), F.lit("\n"), F.col("text"))
    return segments.select("run_id", "seg_idx", cue.alias("cue"))


def pack_series(df: DataFrame, t: str = "t_ms", v: str = "v") -> DataFrame:
    """A row per run with parallel arrays in time order."""
    x = df.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(v).alias("v")))).alias("s"))
    return x.select("run_id", F.transform("s", lambda p: p.t).alias(t), F.transform("s", lambda p: p.v).alias(v))


def unpack_series(df: DataFrame, t: str = "t_ms", v: str = "v") -> DataFrame:
    return df.select("run_id", F.explode(F.arrays_zip(F.col(t).alias("t"), F.col(v).alias("v"))).alias("p")).select("run_id", F.col("p.t").alias(t), F.col("p.v").alias(v))


def caption_text(segments: DataFrame, kind: str = "srt") -> DataFrame:
    """run_id, value: a run's segments as one srt, vtt or txt file. A recording's segments are few enough for one text."""
    time = lambda c: cue_time(F.col(c)) if kind == "srt" else F.replace(cue_time(F.col(c)), F.lit(","), F.lit("."))
    span = F.concat(time("start_ms"), F.lit(" --> "), time("end_ms"), F.lit("\n"), F.col("text"))
    block = {"srt": F.concat((F.col("seg_idx") + 1).cast("string"), F.lit("\n"), span), "vtt": span, "txt": F.col("text")}[kind]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", block.alias("b")))), lambda x: x.b)
    body = F.array_join(rows, "\n" if kind == "txt" else "\n\n")
    return segments.groupBy("run_id").agg(F.concat(F.lit("WEBVTT\n\n" if kind == "vtt" else ""), body, F.lit("\n")).alias("value"))


def arrivals(known: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): rows whose package_sha256 is not known yet, and rows that bring other bytes for a known run_id."""
    fresh = new.join(known.select("package_sha256"), "package_sha256", "left_anti")
    clash = fresh.join(known.select("run_id"), "run_id", "left_semi")
    return fresh.join(known.select("run_id"), "run_id", "left_anti").dropDuplicates(["package_sha256"]), clash
