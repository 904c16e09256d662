"""The test tables as runs: documents and conversations as timed segments, events as issues with coverage, vectors as passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import word_count
from tidemark.operators.intervals import dealt
from tidemark.sources.text import timed_segments

# Event types as risk tracks and as features.
TRACKS = {"view": "visual", "click": "pacing", "purchase": "narrative", "signup": "text", "error": "technical"}
FEATURES = {"view": "repetition", "click": "slow_pace", "purchase": "concrete", "signup": "cta_or_sponsor", "error": "dead_air"}
STEP_MS = 10_000
# What the runs of documents promise, and what their spans are.
STATUSES = ("fulfilled", "partial", "unaddressed", "uncertain")
KINDS = ("cta", "sponsor", "outro", "recap", "viewer_question", "open_loop", "tangent_candidate", "greeting")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs_of_text(spark: SparkSession, sf_dir: str, spread: bool) -> DataFrame:
    """run_id, text; with spread, documents are dealt out by run, for queries that make many rows of each: windows and groups within a run then move nothing."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), "text")
    return dealt(d, "run_id") if spread else d


def segments(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    return timed_segments(runs_of_text(spark, sf_dir, spread), run="run_id")


def talk(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """Lines of documents as segments at 150 words a minute: some sentences as questions, some lines without their end, some unpunctuated."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    x = runs_of_text(spark, sf_dir, spread).select("run_id", F.posexplode(lines).alias("seg_idx", "text"))
    asked = F.regexp_replace("text", r"e[.]( |$)", "e?$1")
    x = x.withColumn("text", F.when(F.col("seg_idx") % 5 == 4, F.lower(F.regexp_replace(asked, "[.?!]", ""))).when(F.col("seg_idx") % 3 == 1, F.regexp_replace(asked, "[.]$", "")).otherwise(asked))
    x = x.withColumn("_ms", F.greatest(F.lit(1000), word_count(F.col("text")) * 400).cast("bigint"))
    end = F.sum("_ms").over(Window.partitionBy("run_id").orderBy("seg_idx"))
    return x.select("run_id", "seg_idx", (end - F.col("_ms")).alias("start_ms"), end.alias("end_ms"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as segments, ten seconds a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seg_idx"), (F.col("turn") * STEP_MS).alias("start_ms"), ((F.col("turn") + 1) * STEP_MS).alias("end_ms"), "role", "text")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events, ten seconds apart, lasting a tenth of a second per unit of value."""
    e = table(spark, sf_dir, "events")
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("event_type"))
    x = e.withColumn("place", place)
    return x.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("issue_id"), "event_type", "ts", "value", "place", (F.col("place") * STEP_MS).alias("start_ms"),
        (F.col("place") * STEP_MS + F.greatest(F.lit(1), F.round(F.col("value") * 100).cast("bigint"))).alias("end_ms"), pick(TRACKS).alias("track"), pick(FEATURES).alias("feature"),
        F.when(F.col("value") < 20, "low").when(F.col("value") < 80, "medium").otherwise("high").alias("severity"), F.when(k % 2 == 0, "supported").otherwise("provisional").alias("evidence_status"),
        F.concat_ws("-", "event_type", (k % 3).cast("string")).alias("cause_group"),
    )


def runs(i: DataFrame) -> DataFrame:
    return i.groupBy("run_id").agg(((F.max("place") + 1) * STEP_MS).alias("duration_ms"))


def spans(i: DataFrame) -> DataFrame:
    """Observed spans: half a minute from every second event, on its own track and on that of visuals."""
    s = i.where("issue_id % 2 = 0").withColumn("track", F.explode(F.array_distinct(F.array("track", F.lit("visual")))))
    return s.select("run_id", "track", "start_ms", (F.col("start_ms") + 30_000).alias("end_ms"))


SEG = r"""l as (select doc_id as run_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') as ls from documents),
s0 as (select run_id, unnest(range(len(ls))) as seg_idx, unnest(ls) as text from l),
s1 as (select *, greatest(1000, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) * 400)::bigint as ms from s0),
seg as (select run_id, seg_idx::int as seg_idx, (sum(ms) over w - ms)::bigint as start_ms, (sum(ms) over w)::bigint as end_ms, text from s1 window w as (partition by run_id order by seg_idx))"""
WORDS = "len(list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r]+'), lambda x: x <> ''))"
#: A text whose letters beyond ASCII are underscores: patterns that take only ASCII for word characters find the same words in it.
PLAIN = r"regexp_replace({0}, '[^\x00-\x7F\P{{L}}]', '_', 'g')"
TALK = rf"""l as (select doc_id as run_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '') as ls from documents),
l0 as (select run_id, unnest(range(len(ls)))::int as seg_idx, unnest(ls) as raw from l), l1 as (select run_id, seg_idx, regexp_replace(raw, 'e[.]( |$)', 'e?\1', 'g') as t from l0),
l2 as (select run_id, seg_idx, case when seg_idx % 5 = 4 then lower(regexp_replace(t, '[.?!]', '', 'g')) when seg_idx % 3 = 1 then regexp_replace(t, '[.]$', '') else t end as text from l1),
l3 as (select *, greatest(1000, {WORDS.format('text')} * 400)::bigint as ms from l2),
talk as (select run_id, seg_idx, (sum(ms) over w - ms)::bigint as start_ms, (sum(ms) over w)::bigint as end_ms, text from l3 window w as (partition by run_id order by seg_idx))"""
ISS = """i0 as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as place, json_extract_string(props, '$.k')::int as k from events),
iss as (select user_id as run_id, event_id as issue_id, event_type, ts, value, place, place * 10000 as start_ms, place * 10000 + greatest(1, round(value * 100)::bigint) as end_ms,
  case event_type when 'view' then 'visual' when 'click' then 'pacing' when 'purchase' then 'narrative' when 'signup' then 'text' else 'technical' end as track,
  case event_type when 'view' then 'repetition' when 'click' then 'slow_pace' when 'purchase' then 'concrete' when 'signup' then 'cta_or_sponsor' else 'dead_air' end as feature,
  case when value < 20 then 'low' when value < 80 then 'medium' else 'high' end as severity, case when k % 2 = 0 then 'supported' else 'provisional' end as evidence_status,
  event_type || '-' || (k % 3)::varchar as cause_group from i0)"""


def union_sql(source: str, name: str, keys: str = "run_id", gap: int = 0) -> str:
    """CTEs for the union of intervals."""
    return f"""{name}_r as (select *, max(end_ms) over (partition by {keys} order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from {source} where end_ms > start_ms),
{name}_n as (select *, sum(case when reach is null or start_ms > reach + {gap} then 1 else 0 end) over (partition by {keys} order by start_ms, end_ms rows unbounded preceding) as island from {name}_r),
{name} as (select {keys}, min(start_ms) as start_ms, max(end_ms) as end_ms from {name}_n group by {keys}, island)"""
