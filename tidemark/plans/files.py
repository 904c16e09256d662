"""Queries over readers, writers and small functions: cues, captions, edit plans, catalogues, ids, redaction, language, arrivals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import checks
from tidemark.operators import contracts as c
from tidemark.plans.inputs import ISS, SEG, issues, segments, table
from tidemark.plans.queries import CONTENT
from tidemark.plans.registry import query
from tidemark.sources import packages, text
from tidemark.streaming import jobs

_T = "printf('%02d:%02d:%02d{1}%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_SPAN = f"{_T.format('start_ms', '.')} || ' --> ' || {_T.format('end_ms', '.')} || chr(10) || text"


@query(f"with {SEG} select run_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_SPAN}, chr(10) || chr(10) order by seg_idx) || chr(10) as value from seg group by 1")
def s14_web_captions(spark, d):
    return text.caption_text(segments(spark, d), "vtt")


@query(f"with {SEG} select run_id, string_agg(text, chr(10) order by seg_idx) || chr(10) as value from seg group by 1")
def s14_plain_text(spark, d):
    return text.caption_text(segments(spark, d), "txt")


@query(f"with {SEG} select run_id, seg_idx, start_ms, end_ms, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from seg")
def s05_subtitle_cues(spark, d):
    """Captions written as a file, with markup and Windows line ends, and read again."""
    s = segments(spark, d).withColumn("text", F.when(F.col("seg_idx") % 2 == 0, F.concat(F.lit("<i>"), "text", F.lit("</i>"))).otherwise(F.concat(F.lit("{\\an8}"), F.col("text"))))
    cues, _ = text.subtitle_cues(text.caption_text(s).withColumn("value", F.replace("value", F.lit("\n"), F.lit("\r\n"))), "run_id")
    return cues.select("run_id", "seg_idx", "start_ms", "end_ms", "text")


_CLOCK = "({0} // 60000)::varchar || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0')"


@query(f"""with {ISS}, x as (select *, {_CLOCK.format('start_ms')} || '-' || {_CLOCK.format('end_ms')} || ' ' || case when issue_id % 2 = 0 then 'cut' else 'move' end || ' ' || event_type as line from iss where issue_id % 3 = 0), y as (select *, row_number() over (partition by run_id order by start_ms, end_ms, line) as k from x)
 select run_id, string_agg(k || '. ' || line, chr(10) order by k) as plan from y group by 1""")  # fmt: skip
def s16_edit_plan(spark, d):
    i = issues(spark, d).where("issue_id % 3 = 0")
    return packages.edit_plan(i.select("run_id", F.when(F.col("issue_id") % 2 == 0, "cut").otherwise("move").alias("operation"), "start_ms", "end_ms", F.col("event_type").alias("note")))


@query("""select doc_id as run_id, doc_id || x as path, case x when '.srt' then 'text' when '.csv' then 'table' when '.jsonl' then 'records' else 'media' end as kind, n_chars as bytes from (select doc_id, n_chars, ['.srt', '.csv', '.jsonl', '.png'][doc_id % 4 + 1] as x from documents)""")
def s21_catalogue(spark, d):
    end = F.get(F.array(*[F.lit(x) for x in (".srt", ".csv", ".jsonl", ".png")]), (F.col("doc_id") % 4).cast("int"))
    return packages.catalogue(table(spark, d, "documents").select(F.col("doc_id").alias("run_id"), F.concat(F.col("doc_id").cast("string"), end).alias("path"), F.col("n_chars").alias("bytes")))


@query("""select doc_id, '[redacted]' as api_key, substr(text, 1, 500) as note, '[redacted]' as session_token from documents where text is not null""")
def p13_redacted(spark, d):
    x = table(spark, d, "documents").where("text is not null").select("doc_id", ft.redact(F.create_map(F.lit("API_Key"), F.col("text"), F.lit("note"), F.col("text"), F.lit("session_token"), F.lit("x"))).alias("m"))
    return x.select("doc_id", F.col("m")["API_Key"].alias("api_key"), F.col("m")["note"].alias("note"), F.col("m")["session_token"].alias("session_token"))


_UUID = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(p_name))"


@query(f"""select p_partkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17:17])::int & 3) + 1, 1) || h[18:20] || '-' || h[21:32] as id from (select p_partkey, {_UUID} as h from part)""")
def p14_name_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", ft.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("p_name")).alias("id"))


@query("""with x as (select event_id, user_id % 100 / 100.0::double as a, (event_id % 50) / 100.0::double as b from events), y as (select event_id, a, b, case when event_id % 5 = 0 then 1 - a - b + 0.1 else 1 - a - b end as c, event_id % 7 = 0 as extra from x)
 select event_id, array_to_string(list_filter([case when extra then 'keys' end, case when not (a between 0 and 1 and b between 0 and 1 and c between 0 and 1) then 'range' end, case when abs(a + b + c - 1) > 0.02 then 'sum' end, case when a <> greatest(a, b, c) then 'choice' end], lambda r: r is not null), ',') as problems from y""")  # fmt: skip
def d21_probability_problems(spark, d):
    x = table(spark, d, "events").select("event_id", (F.col("user_id") % 100 / 100.0).alias("a"), (F.col("event_id") % 50 / 100.0).alias("b"))
    rest = 1 - F.col("a") - F.col("b")
    rest = F.when(F.col("event_id") % 5 == 0, rest + 0.1).otherwise(rest)
    third = F.when(F.col("event_id") % 7 == 0, "other").otherwise("rework")
    p = F.create_map(F.lit("keep"), F.col("a"), F.lit("cut"), F.col("b"), third, rest)
    return x.select("event_id", F.array_join(checks.probability_problems(p, F.lit("keep"), ["keep", "cut", "rework"]), ",").alias("problems"))


_LATIN, _INDIC = "len(regexp_extract_all(t, '[A-Za-z\\x{00C0}-\\x{024F}]'))", "len(regexp_extract_all(t, '[\\x{0900}-\\x{097F}]'))"


@query(f"""with x as (select doc_id, lang, case doc_id % 3 when 0 then text when 1 then text || repeat('क', length(text)) else repeat('ख', 9) end as t from documents where text is not null), y as (select doc_id, lang, {_LATIN} as a, {_INDIC} as b from x)
 select doc_id, case when a + b = 0 then lang when a >= 0.7 * (a + b) then 'latin' when b >= 0.7 * (a + b) then 'devanagari' else coalesce(lang, 'mixed') end as hint from y""")  # fmt: skip
def f06_language_hint(spark, d):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.repeat(F.lit("क"), F.length("text")))).otherwise(F.lit("ख" * 9))
    return table(spark, d, "documents").where("text is not null").select("doc_id", ft.language_hint(t, F.col("lang")).alias("hint"))


@query(f"""with {SEG}, x as (select run_id, seg_idx, text as a, lead(text) over (partition by run_id order by seg_idx) as b from seg), y as (select run_id, seg_idx, {CONTENT.format("(a || ' ' || b)")} as o, {CONTENT.format('b')} as p from x where b is not null)
 select run_id, seg_idx, case when len(o) >= 8 then round(len(list_intersect(o, p)) / len(o), 6) else -1.0 end as kept from y""")  # fmt: skip
def f16_retention(spark, d):
    s = segments(spark, d).withColumn("b", F.lead("text").over(Window.partitionBy("run_id").orderBy("seg_idx"))).where("b is not null")
    return s.select("run_id", "seg_idx", F.coalesce(F.round(ft.retention(F.concat_ws(" ", "text", "b"), F.col("b")), 6), F.lit(-1.0)).alias("kept"))


def _loads(spark, d):
    return issues(spark, d).select("run_id", "issue_id", (F.col("issue_id") % 400).cast("string").alias("package_sha256"), F.col("ts").alias("arrived_at"))


@query(f"with {ISS} select (issue_id % 400)::varchar as package_sha256, count(*) over () as kept from iss group by issue_id % 400")
def x02_first_arrivals(spark, d):
    x = jobs.first_arrivals(_loads(spark, d)).select("package_sha256")
    return x.join(x.agg(F.count("*").alias("kept")), F.lit(True))


@query(f"""with {ISS}, n as (select distinct 1000 + issue_id % 400 as run_id, (issue_id % 700)::varchar as sha from iss), k as (select distinct 1000 + issue_id % 400 as run_id, (issue_id % 700)::varchar as sha from iss where issue_id % 9 = 0 and issue_id % 400 < 100)
 select distinct sha as package_sha256 from n where sha not in (select sha from k) and run_id not in (select run_id from k)""")  # fmt: skip
def s18_arrivals(spark, d):
    """Of each accepted package its hash; which of equal ones is taken does not matter."""
    rows = issues(spark, d).select((1000 + F.col("issue_id") % 400).alias("run_id"), (F.col("issue_id") % 700).cast("string").alias("package_sha256"), "issue_id")
    known = rows.where("issue_id % 9 = 0 and issue_id % 400 < 100").drop("issue_id")
    taken, _ = text.arrivals(known, rows.drop("issue_id"))
    return taken.select("package_sha256")


@query(f"""with {ISS}, k as (select run_id, issue_id from iss where issue_id % 5 <> 4), a as (select run_id, place as bin, unnest([issue_id, issue_id + 1]) as id from iss)
 select distinct a.run_id, 'risk_bins' as "table", 'issues exist' as rule, bin::varchar as row_key from a where not exists (select 1 from k where k.run_id = a.run_id and k.issue_id = a.id)""")  # fmt: skip
def d08_bin_issues(spark, d):
    i = issues(spark, d)
    bins = i.select("run_id", F.col("place").alias("bin"), F.array("issue_id", F.col("issue_id") + 1).alias("ids"))
    return c.dangling(bins, "risk_bins", "bin", F.col("ids"), i.where("issue_id % 5 != 4"), "issue_id", "issues exist")
