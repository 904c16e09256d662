"""Queries over package checks; packages are derived from events (a run per user) and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import contracts as c
from tidemark.plans.inputs import ISS, issues, runs, table
from tidemark.plans.queries import CONTENT
from tidemark.plans.registry import query

KINDS = "['transcript', 'frame', 'observation', 'signal', 'ocr']"
R = "r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1)"


def _evidence(i):
    kinds = F.array(*[F.lit(k) for k in ("transcript", "frame", "observation", "signal", "ocr")])
    return i.select("run_id", F.col("issue_id").alias("evidence_id"), F.element_at(kinds, (F.col("issue_id") % 5 + 1).cast("int")).alias("kind"), (F.col("issue_id") - F.col("issue_id") % 2).alias("ref_id"))


@query(f"with {ISS} select run_id, 'issues' as \"table\", 'same run' as rule, issue_id::varchar as row_key from iss where issue_id % 11 = 0")
def d02_cross_run(spark, d):
    return c.cross_run(issues(spark, d).withColumn("file_run", F.when(F.col("issue_id") % 11 != 0, F.col("run_id"))), "issues", "issue_id")


@query(f"""with {ISS}, e as (select run_id, issue_id as id, ({KINDS})[issue_id % 5 + 1] as kind, issue_id - issue_id % 2 as ref from iss)
 select run_id, 'evidence' as "table", 'reference exists' as rule, id::varchar as row_key from e where not exists (select 1 from e t where t.run_id = e.run_id and t.kind = e.kind and t.id = e.ref)""")  # fmt: skip
def d03_evidence_targets(spark, d):
    e = _evidence(issues(spark, d))
    return c.dangling_kinds(e, "evidence", "evidence_id", e.select("run_id", "kind", F.col("evidence_id").alias("ref_id")))


@query(f"""with {ISS}, k as (select run_id, issue_id from iss where issue_id % 4 <> 3), a as (select run_id, issue_id, unnest([issue_id, issue_id + 1]) as id from iss)
 select distinct a.run_id, 'issues' as "table", 'evidence exists' as rule, a.issue_id::varchar as row_key from a where not exists (select 1 from k where k.run_id = a.run_id and k.issue_id = a.id)""")  # fmt: skip
def d05_dangling_ids(spark, d):
    i = issues(spark, d)
    return c.dangling(i, "issues", "issue_id", F.array("issue_id", F.col("issue_id") + 1), i.where("issue_id % 4 != 3"), "issue_id", "evidence exists")


@query(f"with {ISS}, {R} select iss.run_id, 'suggestions' as \"table\", 'destination_ms inside the run' as rule, issue_id::varchar as row_key from iss join r using (run_id) where start_ms + value * 2000 > t")
def d06_destinations(spark, d):
    i = issues(spark, d)
    return c.outside(i.withColumn("destination_ms", F.col("start_ms") + F.col("value") * 2000), "suggestions", "issue_id", runs(i), "destination_ms")


@query(f"with {ISS}, {R} select iss.run_id, 'issues' as \"table\", 'end_ms inside the run' as rule, issue_id::varchar as row_key from iss join r using (run_id) where end_ms > t")
def d09_intervals_inside(spark, d):
    i = issues(spark, d)
    return c.outside(i, "issues", "issue_id", runs(i))


@query("select label as run_id, 'vectors' as \"table\", 'finite numbers' as rule, vec_id::varchar as row_key from embeddings where vec_id % 9 = 0")
def d14_finite_numbers(spark, d):
    e = table(spark, d, "embeddings").withColumn("run_id", F.col("label"))
    bad = F.when(F.col("vec_id") % 9 == 0, F.when(F.col("vec_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.lit(0.0))
    return c.not_finite(e, "vectors", "vec_id", F.concat(F.col("embedding").cast("array<double>"), F.array(bad)))


@query("""with u as (select distinct user_id as run_id from events), x as (select run_id, unnest(['view', 'click', 'purchase', 'signup', 'error']) as "table" from u), p as (select distinct user_id as run_id, event_type as "table" from events where value > 150),
 dl as (select distinct user_id as run_id, event_type as "table", case when user_id % 2 = 0 then '' else 'quiet' end as reason from events where user_id % 3 <> 0)
 select x.run_id, x."table", case when reason is null then 'declared missing' else 'reason given' end as rule, x."table" as row_key from x left join dl on dl.run_id = x.run_id and dl."table" = x."table" where not exists (select 1 from p where p.run_id = x.run_id and p."table" = x."table") and (reason is null or reason = '')""")  # fmt: skip
def d15_absent_tables(spark, d):
    e = table(spark, d, "events").withColumn("run_id", F.col("user_id"))
    kinds = F.explode(F.array(*[F.lit(k) for k in ("view", "click", "purchase", "signup", "error")])).alias("table")
    declared = e.where("run_id % 3 != 0").select("run_id", F.col("event_type").alias("table"), F.when(F.col("run_id") % 2 == 0, "").otherwise("quiet").alias("reason")).distinct()
    return c.undeclared(e.select("run_id").distinct().select("run_id", kinds), e.where("value > 150").select("run_id", F.col("event_type").alias("table")).distinct(), declared)


@query("""select o_orderkey as run_id, 'manifest' as "table", 'identity' as rule, o_custkey::varchar as row_key from orders left join customer on c_custkey = o_custkey where c_custkey is null or o_orderkey % 13 = 0 or o_custkey % 17 = 0""")
def d16_identity_chain(spark, d):
    o, cu = table(spark, d, "orders"), table(spark, d, "customer")
    m = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("asset_id"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("source_sha256"), (F.col("o_custkey") % 5).alias("project_id"))
    a = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("c_custkey")).join(cu, "c_custkey").select("run_id", F.col("c_custkey").alias("asset_id"), F.col("c_custkey").alias("sha256"), F.when(F.col("c_custkey") % 17 != 0, F.col("c_custkey") % 5).alias("project_id"))
    return c.identity_chain(m, a)


FILES = """f as (select p_partkey % 50 as run_id, case p_partkey % 7 when 0 then 'reports/' || p_partkey || '.CSV' when 1 then p_partkey || '.csv' when 2 then 'a//' || p_partkey || '.jpg' when 3 then '../' || p_partkey || '.txt' when 4 then 'x/Same.json' when 5 then 'x/same.json' else repeat('p', 100 + p_partkey % 200) || '.exe' end as path, p_partkey * 20000 as bytes from part)"""


@query(f"""with {FILES}, x as (select *, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) as s, row_number() over (partition by run_id, lower(path) order by path) > 1 as again from f),
 y as (select run_id, path, unnest([case when starts_with(path, '/') or contains(path, '\\') or contains(string_split(path, '/')[1], ':') or len(list_filter(string_split(path, '/'), lambda p: p in ('', '.', '..'))) > 0 then 'unsafe path' end, case when length(path) > 240 then 'path length' end, case when again then 'repeated path' end,
  case when s not in ({", ".join(f"'{s}'" for s in c.SUFFIXES)}) then 'file type' end, case when s in ('.csv', '.srt', '.vtt') and not starts_with(path, 'reports/') then 'reports folder' end,
  case when bytes > case when s in ('.json', '.jsonl', '.txt', '.md', '.csv', '.srt', '.vtt') then {c.TEXT_BYTES} when s = '.jpg' then {c.IMAGE_BYTES} else {c.OTHER_BYTES} end then 'file size' end]) as rule from x)
 select run_id, 'files' as "table", rule, path as row_key from y where rule is not null""")  # fmt: skip
def d12_listing_limits(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 7 == 0, F.concat(F.lit("reports/"), k, F.lit(".CSV"))).when(k % 7 == 1, F.concat(k, F.lit(".csv"))).when(k % 7 == 2, F.concat(F.lit("a//"), k, F.lit(".jpg"))).when(k % 7 == 3, F.concat(F.lit("../"), k, F.lit(".txt")))
    path = path.when(k % 7 == 4, "x/Same.json").when(k % 7 == 5, "x/same.json").otherwise(F.concat(F.repeat(F.lit("p"), (100 + k % 200).cast("int")), F.lit(".exe")))
    return c.listing_problems(table(spark, d, "part").select((k % 50).alias("run_id"), path.alias("path"), (k * 20000).alias("bytes")))


@query("""with x as (select doc_id % 20 as run_id, doc_id, case doc_id % 3 when 0 then '.jpg' when 1 then '.zip' else '.txt' end as s, case when doc_id % 4 = 0 then 'PK' || chr(3) || chr(4) else '' end || coalesce(text, '') as b from documents),
 y as (select run_id, doc_id || s as path, unnest([case when doc_id % 5 = 0 then 'hash' end, case when doc_id % 6 = 0 then 'size' end, case when s = '.jpg' or (s = '.zip' and doc_id % 4 <> 0) then 'type' end]) as rule from x) select run_id, 'files' as "table", rule, path as row_key from y where rule is not null""")  # fmt: skip
def d11_file_contents(spark, d):
    k = F.col("doc_id")
    s = F.when(k % 3 == 0, ".jpg").when(k % 3 == 1, ".zip").otherwise(".txt")
    raw = F.encode(F.concat(F.when(k % 4 == 0, "PK\x03\x04").otherwise(""), F.coalesce("text", F.lit(""))), "UTF-8")
    files = table(spark, d, "documents").select((k % 20).alias("run_id"), F.concat(k, s).alias("path"), raw.alias("content"), "doc_id")
    listed = files.select("run_id", "path", F.when(k % 5 == 0, "0").otherwise(F.sha2("content", 256)).alias("sha256"), (F.length("content") + F.when(k % 6 == 0, 1).otherwise(0)).alias("bytes"))
    return c.content_problems(files.drop("doc_id"), listed)


ANSWERS = "a as (select doc_id % 40 as run_id, doc_id as answer, doc_id + case when doc_id % 5 = 0 then 100000000 else 0 end as passage, case doc_id % 4 when 0 then replace(text[5:40], ' ', '  ') when 1 then '  ' when 2 then text[10:30] || ' zz' else text[3:60] end as quote from documents where length(text) > 60)"
_PLAIN = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"


@query(f"""with {ANSWERS}, x as (select a.*, d.text from a left join documents d on d.doc_id = a.passage), y as (select *, case when text is null then 'passage exists' when trim(quote, ' ') = '' or not contains({_PLAIN.format('text')}, {_PLAIN.format('quote')}) then 'quote in passage' end as rule from x)
 select run_id, 'answers' as "table", rule, answer::varchar as row_key from y where rule is not null""")  # fmt: skip
def d17_answer_quotes(spark, d):
    docs, k = table(spark, d, "documents").where("length(text) > 60"), F.col("doc_id")
    quote = F.when(k % 4 == 0, F.replace(F.substring("text", 5, 36), F.lit(" "), F.lit("  "))).when(k % 4 == 1, "  ").when(k % 4 == 2, F.concat(F.substring("text", 10, 21), F.lit(" zz"))).otherwise(F.substring("text", 3, 58))
    answers = docs.select((k % 40).alias("run_id"), k.alias("answer"), (k + F.when(k % 5 == 0, 100000000).otherwise(0)).alias("passage"), quote.alias("quote"))
    return c.quote_problems(answers, docs.select((k % 40).alias("run_id"), k.alias("passage"), "text"))


DECISIONS = f"""dc as (select doc_id % 40 as run_id, doc_id as candidate, case when doc_id % 3 = 0 then 'dismiss' else 'accept' end as verdict, case when doc_id % 7 = 0 then [] when doc_id % 7 = 1 then ['E9'] else ['E1'] end as evidence, case when doc_id % 5 = 0 then null when doc_id % 2 = 0 then 'rewrite' else 'cut' end as kind,
 coalesce(text, '') as original, case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then coalesce(text, '') else coalesce(text[1:40], '') end as proposed, case when doc_id % 11 = 0 then ' ' else 'why' end as explanation from documents),
 dw as (select *, {CONTENT.format('original')} as ow, {CONTENT.format('proposed')} as pw from dc), dp as (select run_id, candidate, unnest([case when evidence = ['E9'] then 'evidence listed' end, case when len(evidence) = 0 then 'evidence cited' end, case when kind is null then 'option known' end, case when verdict = 'accept' and kind = 'rewrite' and trim(proposed, ' ') = '' then 'text given' end,
  case when verdict = 'accept' and kind = 'rewrite' and trim(proposed, ' ') <> '' and len(ow) >= 8 and len(list_intersect(ow, pw)) / len(ow) < 0.4 then 'content kept' end, case when verdict = 'accept' and trim(explanation, ' ') = '' then 'explained' end]) as rule from dw), db as (select * from dp where rule is not null)"""


def _decisions(spark, d):
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    ev = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 == 1, F.array(F.lit("E9"))).otherwise(F.array(F.lit("E1")))
    return table(spark, d, "documents").select((k % 40).alias("run_id"), k.alias("candidate"), F.when(k % 3 == 0, "dismiss").otherwise("accept").alias("verdict"), ev.alias("evidence"), F.array(F.lit("E1"), F.lit("E2")).alias("allowed"),
                                               F.when(k % 5 == 0, None).when(k % 2 == 0, "rewrite").otherwise("cut").alias("option_kind"), text.alias("original"), F.when(k % 4 == 0, "").when(k % 4 == 1, text).otherwise(F.substring(text, 1, 40)).alias("proposed"), F.when(k % 11 == 0, " ").otherwise("why").alias("explanation"))


@query(f"with {DECISIONS} select run_id, 'decisions' as \"table\", rule, candidate::varchar as row_key from db")
def d18_decisions(spark, d):
    return c.decision_problems(_decisions(spark, d))


@query(f"with {DECISIONS}, g as (select candidate, list_distinct(list(rule)) as rs from db group by 1) select run_id, candidate, rs is not null as edit_dropped from dc left join g using (candidate) where rs is null or rs = ['content kept']")
def d19_salvaged(spark, d):
    x = _decisions(spark, d)
    return c.salvaged(x, c.decision_problems(x)).select("run_id", "candidate", "edit_dropped")


@query(f"with {DECISIONS} select run_id, candidate from dc where candidate not in (select candidate from db)")
def d20_without_broken(spark, d):
    x = _decisions(spark, d)
    return c.without_broken(x, c.decision_problems(x), "candidate").select("run_id", "candidate")


@query(f"with {ISS} select run_id, issue_id, case when coalesce(value / 100, 0.0) < 0.65 then 'needs_review' else event_type end as choice from iss")
def d22_low_confidence(spark, d):
    i = issues(spark, d).select("run_id", "issue_id", F.col("event_type").alias("choice"), (F.col("value") / 100).alias("confidence"))
    return c.routed(i).select("run_id", "issue_id", "choice")


DRAFTS = "dr as (select conv_id as run_id, turn as passage, turn * 10000 as start_ms, text as original, case when turn % 2 = 0 then text else text[1:20] end as draft, case when turn % 3 = 0 then text[1:60] else lag(text) over (partition by conv_id order by turn)[1:60] end as quote from conversations)"


@query(f"""with {DRAFTS}, w as (select *, len(list_filter(regexp_split_to_array(quote, '[ \\t\\n\\r]+'), lambda x: x <> '')) as nq, len(list_filter(regexp_split_to_array(draft, '[ \\t\\n\\r]+'), lambda x: x <> '')) as nd, len(list_filter(regexp_split_to_array(original, '[ \\t\\n\\r]+'), lambda x: x <> '')) as no,
  exists (select 1 from conversations c where c.conv_id = dr.run_id and c.turn * 10000 < dr.start_ms and contains({_PLAIN.format('c.text')}, {_PLAIN.format('quote')})) as held from dr where quote is not null),
 x as (select run_id, passage, unnest([case when nq < 4 or not held then 'earlier support' end, case when nd >= no then 'shorter' end]) as rule from w) select run_id, 'drafts' as "table", rule, passage::varchar as row_key from x where rule is not null""")  # fmt: skip
def d23_shortenings(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("passage"), (F.col("turn") * 10000).alias("start_ms"), "text")
    before = F.lag("text").over(Window.partitionBy("run_id").orderBy("passage"))
    x = t.withColumn("quote", F.when(F.col("passage") % 3 == 0, F.substring("text", 1, 60)).otherwise(F.substring(before, 1, 60))).where("quote is not null")
    x = x.select("run_id", "passage", "start_ms", "quote", F.when(F.col("passage") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 20)).alias("draft"), F.col("text").alias("original"))
    return c.shortening_problems(x, t)


@query(f"""with v as (select doc_id % 40 as run_id, doc_id as answer, case doc_id % 4 when 0 then ['F1', 'F3'] when 1 then ['F3', 'F2'] when 2 then ['F9'] else [] end as frames, case doc_id % 3 when 0 then '' when 1 then text[5:30] else 'qq zz' end as quote, coalesce(text, '') as text from documents),
 x as (select run_id, answer, unnest([case when frames = ['F9'] then 'labels known' end, case when frames = ['F3', 'F2'] then 'labels in order' end, case when quote <> '' and not contains({_PLAIN.format('text')}, {_PLAIN.format('quote')}) then 'quote said' end]) as rule from v) select run_id, 'visual' as "table", rule, answer::varchar as row_key from x where rule is not null""")  # fmt: skip
def d24_frame_labels(spark, d):
    k = F.col("doc_id")
    frames = F.when(k % 4 == 0, F.array(F.lit("F1"), F.lit("F3"))).when(k % 4 == 1, F.array(F.lit("F3"), F.lit("F2"))).when(k % 4 == 2, F.array(F.lit("F9"))).otherwise(F.array().cast("array<string>"))
    quote = F.when(k % 3 == 0, "").when(k % 3 == 1, F.substring("text", 5, 26)).otherwise("qq zz")
    x = table(spark, d, "documents").select((k % 40).alias("run_id"), k.alias("answer"), frames.alias("frames"), F.array(F.lit("F1"), F.lit("F2"), F.lit("F3")).alias("labels"), quote.alias("quote"), F.coalesce("text", F.lit("")).alias("transcript"))
    return c.frame_problems(x)
