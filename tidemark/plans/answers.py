"""Queries over rules for single rows, fingerprints, record lines, the stored index and context rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import text as ft
from tidemark.operators import findings, links, policies, retrieval, sequences
from tidemark.plans.decided import REC, recorded
from tidemark.plans.inputs import ISS, PLAIN, SEG, issues, segments, table, turns
from tidemark.plans.queries import BM25
from tidemark.plans.registry import query
from tidemark.plans.talks import quoted
from tidemark.sources.text import parsed_lines
from tidemark.sources.working import shared_dir


@query("""select event_id, sha256('{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || ',"v":[{"n":null,"type":"' || event_type || '"},' || user_id || ']}') as fingerprint from events""")
def p15_fingerprint(spark, d):
    """Nested values whose keys come in another order than the canonical one."""
    j = F.concat(F.lit('{"v": [ {"type": "'), "event_type", F.lit('", "n": null}, '), F.col("user_id").cast("string"), F.lit('],\n "k": '), F.get_json_object("props", "$.k"), F.lit(', "id": '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, d, "events").select("event_id", ft.fingerprint(j).alias("fingerprint"))


LINES = StructType().add("id", "long").add("kind", "string")


def files(spark, d) -> DataFrame:
    """file, value: a user's events as JSON lines, some broken."""
    n = F.col("event_id").cast("string")
    good = F.concat(F.lit('{"id": '), n, F.lit(', "kind": "'), "event_type", F.lit('"}'))
    bad = {1: F.concat(F.lit('{"id": NaN, "kind": "'), n, F.lit('"}')), 3: F.concat(good, F.lit(" tail")), 4: F.lit("  "), 5: F.concat(F.lit('{"id": '), n, F.lit(', "more": 1}')), 7: F.concat(F.lit("["), n, F.lit("]")), 8: F.concat(F.lit('{"id": "x'), n, F.lit('"}'))}
    line = good
    for k, v in bad.items():
        line = F.when(F.col("event_id") % 11 == k, v).otherwise(line)
    x = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("file")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    return x.select("file", F.array_join(F.transform("x", lambda v: v.line), "\n").alias("value"))


@query("""with x as (select user_id::varchar as file, row_number() over (partition by user_id order by event_id) as line, event_id % 11 as k, event_id as id, event_type as kind from events)
 select file, line::int as line, case when k in (1, 3, 5, 7, 8) then -1 else id end as id, case k when 1 then 'not JSON' when 3 then 'not JSON' when 5 then 'unknown field' when 7 then 'not an object' when 8 then 'wrong type' else '' end as problem from x where k <> 4""")  # fmt: skip
def s01_record_lines(spark, d):
    x = parsed_lines(files(spark, d), LINES)
    return x.select("file", "line", F.coalesce("row.id", F.lit(-1)).alias("id"), F.coalesce("problem", F.lit("")).alias("problem"))


def _search(spark, d) -> tuple[DataFrame, DataFrame]:
    t = turns(spark, d)
    return t.where("seg_idx = 0").select("run_id", F.col("seg_idx").alias("query_id"), "text"), sequences.passages(t.select("run_id", "seg_idx", "start_ms", "end_ms", "text"))


@query(f"with {BM25} select run_id::varchar as run_id, query_id, passage, score, matched from sc")
def q01_stored_search(spark, d):
    """An index loaded in two parts, and one of them again."""
    q, p = _search(spark, d)
    index = retrieval.StoredIndex(spark, f"{shared_dir(spark)}/tidemark/index-{uuid.uuid4().hex}")
    for part in (0, 1, 0):
        index.append(p.where(F.col("run_id") % 2 == part).select("run_id", "passage", "text"))
    return index.search(q)


@query()
def q07_context_rows(spark, d):
    """For each conversation's first turn: findings, questions, chapters, the opening and the best passages, within 12,000 characters."""
    q, p = _search(spark, d)
    t = turns(spark, d)
    p = p.withColumn("passage", F.col("passage").cast("bigint"))
    hits = findings.top_passages(retrieval.bm25(q, p).join(p.select("run_id", "passage", "start_ms", "end_ms"), ["run_id", "passage"]), 8).join(p.select("run_id", "passage", "text"), ["run_id", "passage"])
    chapters = t.where("seg_idx % 4 = 0").select("run_id", "start_ms", F.concat(F.lit("turn "), F.col("seg_idx").cast("string")).alias("label"))
    found = t.where("seg_idx % 5 = 2").select("run_id", "start_ms", "end_ms", F.concat("role", F.lit(" speaks")).alias("text"))
    return retrieval.conversation_context(q, t, hits, chapters, found, t.where("text like '%?%'").select("run_id", "start_ms", "text"))


_QUOTE = "case seg_idx % 6 when 0 then text || '?' when 1 then 'Here''s how ' || text when 2 then 'Next, ' || text else text end"
_SAID = "case when seg_idx % 4 = 3 then 'Bro, ' || text else text end"


@query(f"""with {SEG}, s as (select run_id, seg_idx, start_ms, {_SAID} as said, {_QUOTE} as text, case when seg_idx % 7 <> 6 then 'Cut this' else 'Keep this' end as answer from seg), h as (select run_id, start_ms as hook_ms from seg where seg_idx = 3)
 select run_id, seg_idx as quote_id, reason from (select s.*, case when ends_with(rtrim(text, ' '), '?') then 'question' when abs(start_ms + 10 - hook_ms) < 3000 then 'hook' when regexp_matches(text, '{quoted(policies.TRANSITION)}') then 'transition' when regexp_matches({PLAIN.format('said')}, '{policies.QUOTED_VOICE}') then 'quoted_voice' end as reason from s left join h using (run_id) where answer = 'Cut this') where reason is not null""")  # fmt: skip
def p11_edit_warnings(spark, d):
    s = segments(spark, d)
    i = F.col("seg_idx")
    text = F.when(i % 6 == 0, F.concat("text", F.lit("?"))).when(i % 6 == 1, F.concat(F.lit("Here's how "), "text")).when(i % 6 == 2, F.concat(F.lit("Next, "), "text")).otherwise(F.col("text"))
    quotes = s.select("run_id", i.alias("quote_id"), text.alias("text"), (F.col("start_ms") + 10).alias("start_ms"), F.when(i % 7 != 6, "Cut this").otherwise("Keep this").alias("answer"))
    said = s.withColumn("text", F.when(i % 4 == 3, F.concat(F.lit("Bro, "), "text")).otherwise(F.col("text")))
    return policies.edit_warnings(quotes, s.where("seg_idx = 3").select("run_id", F.col("start_ms").alias("hook_ms")), said)


_ENDS = ["with loud music", "looks bored", "40 % leave", "a person enters", "viewers will leave", "unhappy sadness"]
_STATED = "text || ' ' || [" + ", ".join(f"'{e}'" for e in _ENDS) + "][seg_idx % 6 + 1]"
_BANNED = "case " + " ".join(f"when regexp_matches({PLAIN.format('s')}, '{quoted(p)}') then '{n}'" for n, p in policies.BANNED.items()) + " end"


@query(f"with {SEG} select run_id, seg_idx, coalesce({_BANNED}, '') as reason from (select run_id, seg_idx, {_STATED} as s from seg)")
def p12_banned_statements(spark, d):
    s = segments(spark, d)
    stated = F.concat("text", F.lit(" "), F.get(F.array(*[F.lit(e) for e in _ENDS]), F.col("seg_idx") % 6))
    return s.select("run_id", "seg_idx", F.coalesce(policies.banned_reason(stated), F.lit("")).alias("reason"))


def _answers(spark, d):
    _, chunks, s = recorded(spark, d)
    i, run = F.col("seg_idx"), F.col("run_id")
    ref = F.concat(F.lit("F"), i.cast("string"))
    items = F.struct(F.concat(F.lit("item "), i.cast("string"), F.when(i % 4 == 1, " is loud").otherwise("")).alias("statement"), F.get(F.array(F.lit("clear"), F.lit("likely"), F.lit("uncertain")), i % 3).alias("certainty"), F.when(i % 5 == 3, F.array(F.lit("F9999"))).otherwise(F.array(ref, F.concat(F.lit("F"), (i + 1).cast("string")))).alias("frames"))
    x = s.groupBy("run_id", F.col("chunk").alias("clip")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", items.alias("item")))), lambda v: v["item"]).alias("items"))
    x = x.join(chunks.withColumnRenamed("chunk", "clip"), ["run_id", "clip"]).withColumn("status", F.when((run + F.col("clip")) % 6 == 0, "timeout").otherwise("complete"))
    # A frame of a clip may be its context: the first line of the next clip.
    frames = s.select("run_id", F.explode(F.array("chunk", F.floor((i - 1) / 5).cast("int"))).alias("clip"), ref.alias("ref"), F.col("start_ms").alias("at_ms")).distinct()
    return x, frames


@query(f"""with {REC}, it as (select run_id, chunk as clip, (seg_idx % 5) as n, seg_idx as i from sg where (run_id + chunk) % 6 <> 0 and seg_idx % 4 <> 1 and seg_idx % 5 <> 3),
 x as (select it.*, ch.start_ms as c0, ch.end_ms as c1, f.start_ms as at_ms, f.seg_idx as ref from it join ch on ch.run_id = it.run_id and ch.chunk = it.clip join sg f on f.run_id = it.run_id and f.seg_idx in (it.i, it.i + 1) and f.start_ms >= ch.start_ms and f.start_ms < ch.end_ms)
 select run_id, clip, min(at_ms) as start_ms, greatest(least(any_value(c1), max(at_ms) + 1000), min(at_ms) + 1) as end_ms, 'item ' || i as statement, case i % 3 when 0 then 'supported' else 'provisional' end as status, string_agg('F' || ref, ',' order by 'F' || ref) as refs from x group by run_id, clip, n, i""")  # fmt: skip
def j27_observations(spark, d):
    made, _, _ = policies.observations(*_answers(spark, d))
    return made.drop("observation_id").withColumn("refs", F.array_join("refs", ","))


@query(f"""with {REC}, it as (select run_id, chunk as clip, (seg_idx % 5)::int as n, seg_idx as i from sg where (run_id + chunk) % 6 <> 0) select run_id, clip, n, case when i % 4 = 1 then 'audio_claim' else 'no core frame' end as reason from it where i % 4 = 1 or i % 5 = 3""")
def j27_dropped(spark, d):
    _, _, dropped = policies.observations(*_answers(spark, d))
    return dropped


@query("""select c_custkey as project_id, case when count(o_orderkey) = 0 then 'awaiting_analysis' when bool_or(o_orderstatus = 'F') then 'ready' else 'partial' end as state from customer left join orders on o_custkey = c_custkey group by 1""")
def a21_project_states(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "analysis").otherwise("raw").alias("package_kind"))
    return policies.project_states(table(spark, d, "customer").select(F.col("c_custkey").alias("project_id")), runs)


@query(f"""with {ISS}, m as (select run_id, 'model' as source, issue_id::varchar as id, severity, evidence_status = 'supported' as firm, start_ms, case when run_id % 2 = 0 then issue_id % 900 else 1000 end as rank from iss where event_type = 'view'),
 i as (select run_id, 'issue' as source, issue_id::varchar as id, severity, evidence_status = 'supported' as firm, start_ms, row_number() over (partition by run_id order by issue_id) + 499 as rank from iss where event_type <> 'view' and issue_id % 7 <> 0), a as (select * from m union all select * from i),
 g as (select *, coalesce(max(case when source = 'model' and rank < 1000 then 1 end) over (partition by run_id), 0) as given from a)
 select run_id, row_number() over (partition by run_id order by case when given = 1 then rank else 0 end, case severity when 'high' then 1 when 'medium' then 2 else 3 end, case when firm then 0 else 1 end, start_ms, source, id) as place, source, id from g""")  # fmt: skip
def t06_all_findings(spark, d):
    i = issues(spark, d)
    model = i.where("event_type = 'view'").select("run_id", F.col("issue_id").alias("finding_id"), "severity", F.col("evidence_status").alias("strength"), "start_ms", F.when(F.col("run_id") % 2 == 0, F.col("issue_id") % 900).alias("rank"))
    rest = i.where("event_type != 'view'").withColumn("review_status", F.when(F.col("issue_id") % 7 == 0, "dismissed").otherwise("open"))
    return policies.all_findings(model, rest)


_MMSS = "({0} // 60000)::varchar || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0')"


@query(f"""with {ISS} select run_id, issue_id, {_MMSS.format('start_ms')} || '–' || {_MMSS.format('end_ms')} || ': ' || case when event_type = 'error' then 'scenario loss above the neutral video.' else event_type || '; because of ' || cause_group || '.' end as headline from iss""")
def f19_headlines(spark, d):
    what = F.when(F.col("event_type") != "error", F.col("event_type"))
    return issues(spark, d).select("run_id", "issue_id", policies.headline(F.col("start_ms"), F.col("end_ms"), what, F.concat(F.lit("because of "), "cause_group")).alias("headline"))


@query("""with q as (select doc_id as run_id, i as quote_id, case i when 0 then substr(text, 6, 2) when 1 then substr(text, 9, 5) else substr(text, 40, 1) end as quote from (select doc_id, text, unnest([0, 1, 2]) as i from documents where text is not null and doc_id % 3 = 0)),
 l as (select doc_id as run_id, unnest(range(len(string_split(text, chr(10)))))::int as seg_idx, lower(unnest(string_split(text, chr(10)))) as t from documents where text is not null), p as (select run_id, seg_idx, trim(regexp_replace(t, '\\s+', ' ', 'g')) as t from l),
 n as (select *, trim(regexp_replace(lower(quote), '\\s+', ' ', 'g')) as k from q)
 select n.run_id, quote_id, coalesce(min(seg_idx) filter (k <> '' and contains(t, k)), -1) as seg_idx from n left join p on p.run_id = n.run_id group by 1, 2""")  # fmt: skip
def j24_short_quotes(spark, d):
    """Quotes of one and two words, or parts of them."""
    t = table(spark, d, "documents").where("text is not null")
    q = t.where("doc_id % 3 = 0").select(F.col("doc_id").alias("run_id"), F.posexplode(F.array(F.substring("text", 6, 2), F.substring("text", 9, 5), F.substring("text", 40, 1))).alias("quote_id", "quote"))
    return links.exact_quotes(q, t.select(F.col("doc_id").alias("run_id"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))).select("run_id", "quote_id", F.coalesce("seg_idx", F.lit(-1)).alias("seg_idx"))

