"""Queries over recorded answers, made from documents (five lines are a chunk) and events (candidates with decisions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import decisions as dc
from tidemark.plans.inputs import ISS, TALK, issues, talk
from tidemark.plans.registry import query

KINDS = list(dc.SPAN_FEATURES)
#: Chunks that no run has, however long.
GONE = 2**31 - 2
LEDGER = "struct<obligation:int,status:string,setup:array<int>,partial:array<int>,fulfilled:array<int>>"


def recorded(spark, d, far: int = 98) -> tuple[DataFrame, DataFrame, DataFrame]:
    """answers, chunks, segments. The last chapter has the chunks far and far + 1, which only long runs have, if any."""
    s = talk(spark, d).withColumn("chunk", F.floor(F.col("seg_idx") / 5).cast("int"))
    chunks = s.groupBy("run_id", "chunk").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    run, lit = F.col("run_id"), F.lit
    ints = lambda *v: F.array(*[lit(x) for x in v]).cast("array<int>")
    entry = lambda i, st, *a: F.struct(lit(i).alias("obligation"), lit(st).alias("status"), *[ints(*x).alias(n) for n, x in zip(("setup", "partial", "fulfilled"), a, strict=True)]).cast(LEDGER)
    led = lambda i: F.when((run + i) % 4 == 1, entry(i, "fulfilled", [0], [2], [3])).when((run + i) % 4 == 2, entry(i, "partial", [], [4, 2], [])).when((run + i) % 4 == 3, entry(i, "fulfilled", [1], [], [GONE]))
    # Part of what one line says; lines of one word have no quote.
    part = F.substring("text", 3, 20)
    head = s.groupBy("run_id").agg(F.max(F.when(F.col("seg_idx") == 1, part)).alias("second"))
    spans = s.where("seg_idx % 5 = 0").select("run_id", "chunk", F.struct(F.get(F.array(*[lit(k) for k in KINDS]), ((run + F.col("chunk")) % 9).cast("int")).alias("kind"), "chunk", F.when(F.col("chunk") % 2 == 0, part).otherwise("").alias("quote")).alias("s"))
    spans = spans.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "s"))), lambda x: x.s).alias("spans"))
    chapter = lambda a, b: F.struct(F.concat(lit("part "), lit(a).cast("string")).alias("label"), lit("body").alias("role"), lit(a).alias("first"), lit(b).alias("last"))
    answer = F.struct(
        F.struct(F.when(run % 4 == 0, "none").otherwise("cold_open").alias("kind"), lit(0).alias("chunk"), F.when(run % 3 != 0, F.col("second")).otherwise("never said so").alias("quote")).alias("hook"), lit(1).alias("first_substance_chunk"),
        F.array(*[F.struct(lit(f"promise {i}").alias("obligation"), lit(f"title {i}").alias("title_quote")) for i in range(3)]).alias("obligations"), F.array_compact(F.array(led(0), led(1), led(2))).alias("ledger"),
        F.array(chapter(0, 1), chapter(2, 4), chapter(far, far + 1)).alias("chapters"), "spans",
    )
    return head.join(spans, "run_id").select("run_id", answer.alias("answer")), chunks, s


_NORM = "regexp_replace(lower({0}), '[ \\t\\n\\r]+', ' ', 'g')"
REC = f"""{TALK}, sg as (select *, seg_idx // 5 as chunk from talk), ch as (select run_id, chunk, min(start_ms) as start_ms, max(end_ms) as end_ms from sg group by 1, 2), runs as (select distinct run_id from talk)"""


def _at(refs: str, name: str) -> str:
    """CTE `name`: refs (run_id, k, chunk, quote) with their place."""
    said = f"(select run_id, k, min({{'i': seg_idx, 'a': sg.start_ms, 'z': sg.end_ms}}) as s from {refs} r join sg using (run_id, chunk) where trim(quote, ' ') <> '' and contains({_NORM.format('text')}, trim({_NORM.format('quote')}, ' ')) group by 1, 2)"
    return f"{name} as (select r.run_id, r.k, coalesce(s.a, ch.start_ms) as start_ms, coalesce(s.z, ch.end_ms) as end_ms from {refs} r join ch using (run_id, chunk) left join {said} x on x.run_id = r.run_id and x.k = r.k)"


@query(f"""with {REC}, hk as (select runs.run_id, 0 as k, 0 as chunk, case when runs.run_id % 3 <> 0 then substr(text, 3, 20) else 'never said so' end as quote from runs left join talk on talk.run_id = runs.run_id and seg_idx = 1 where runs.run_id % 4 <> 0), hq as (select * replace (coalesce(quote, '') as quote) from hk), {_at('hq', 'h')}
 select runs.run_id, case when runs.run_id % 4 = 0 then 'none' else 'cold_open' end as hook_kind, coalesce(h.start_ms, -1) as hook_ms, coalesce(h.end_ms, -1) as hook_end_ms, coalesce(ch.start_ms, -1) as first_substance_ms from runs left join h using (run_id) left join ch on ch.run_id = runs.run_id and ch.chunk = 1""")  # fmt: skip
def k11_structure(spark, d):
    return dc.structure(*recorded(spark, d)).fillna(-1, ["hook_ms", "hook_end_ms", "first_substance_ms"])


@query(f"""with {REC}, c as (select * from (values (0, 0, 1), (1, 2, 4), (2, 98, 99)) v(chapter, first, last)) select run_id, chapter, 'part ' || first as label, 'body' as role, min(start_ms) as start_ms, max(end_ms) as end_ms from c join ch on chunk = first or chunk = last group by all""")
def k11_chapters(spark, d):
    answers, chunks, _ = recorded(spark, d)
    return dc.chapters(answers, chunks)


_SPAN_ROWS = f"sp as (select run_id, chunk as k, chunk, ([{', '.join(repr(k) for k in KINDS)}])[(run_id + chunk) % 9 + 1] as kind, case when chunk % 2 = 0 then substr(text, 3, 20) else '' end as quote from sg where seg_idx % 5 = 0)"


@query(f"with {REC}, {_SPAN_ROWS}, {_at('sp', 'loc')} select run_id, k::int as span, kind, quote, loc.start_ms, loc.end_ms from sp join loc using (run_id, k)")
def k11_spans(spark, d):
    return dc.spans(*recorded(spark, d))


@query(f"""with {REC}, ob as (select run_id, unnest([0, 1, 2]) as i from runs), st as (select *, (run_id + i) % 4 as m, case (run_id + i) % 4 when 1 then 'fulfilled' when 2 then 'partial' when 3 then 'fulfilled' else 'uncertain' end as claimed from ob),
 x as (select st.*, c0.start_ms as s0, c1.start_ms as s1, c2.start_ms as a2, c2.end_ms as z2, c3.start_ms as a3, c3.end_ms as z3, c4.start_ms as a4, c4.end_ms as z4 from st left join ch c0 on c0.run_id = st.run_id and c0.chunk = 0 left join ch c1 on c1.run_id = st.run_id and c1.chunk = 1 left join ch c2 on c2.run_id = st.run_id and c2.chunk = 2 left join ch c3 on c3.run_id = st.run_id and c3.chunk = 3 left join ch c4 on c4.run_id = st.run_id and c4.chunk = 4),
 hd as (select run_id, chunk, list(seg_idx order by seg_idx)[1:2] as ids from sg group by 1, 2), y as (select x.*, case m when 1 then a3 is null else m = 3 end as bare, h3.ids as i3, h4.ids as i4 from x left join hd h3 on h3.run_id = x.run_id and h3.chunk = 3 left join hd h4 on h4.run_id = x.run_id and h4.chunk = 4)
 select run_id, i as promise, 'promise ' || i as obligation, 'title ' || i as title_quote, case when bare then 'uncertain' else claimed end as status, coalesce(case m when 1 then s0 when 3 then s1 end, -1) as setup_ms, coalesce(case m when 1 then coalesce(a2, a3) when 2 then coalesce(a2, a4) end, -1) as first_fulfil_ms,
  coalesce(case when m = 2 then coalesce(a2, a4) when m = 1 and not bare then a2 end, -1) as partial_start_ms, coalesce(case when m = 2 then coalesce(z4, z2) when m = 1 and not bare then z2 end, -1) as partial_end_ms, coalesce(case when m = 1 and not bare then a3 end, -1) as fulfilled_start_ms, coalesce(case when m = 1 and not bare then z3 end, -1) as fulfilled_end_ms,
  coalesce(array_to_string(case m when 1 then i3 when 2 then i4 end, ','), '') as evidence from y""")  # fmt: skip
def k13_promises(spark, d):
    x = dc.promises(*recorded(spark, d)).withColumn("evidence", F.array_join("evidence", ","))
    return x.fillna(-1, [c for c in x.columns if c.endswith("_ms")])


def _decided(spark, d):
    """candidates, decisions, book from a user's events."""
    i = issues(spark, d)
    n, opt = F.col("issue_id"), lambda name, op, to: F.struct(F.lit(name).alias("id"), F.lit(op).alias("operation"), F.col("start_ms"), F.col("end_ms"), to.cast("bigint").alias("destination_ms"))
    none = F.lit(None)
    text = n.cast("string")
    options = F.array(opt("a", "cut", none), opt("b", "move", F.greatest(F.lit(0), F.col("start_ms") - 25_000)), opt("c", "insert_visual", none), opt("d", "rewrite", none))
    c = i.select("run_id", text.alias("candidate"), F.col("event_type").alias("type"), "start_ms", "end_ms", (n % 7 == 0).alias("absence"), options.alias("options"), F.array(F.concat(F.lit("t"), text), F.concat(F.lit("s"), text), F.concat(F.lit("o"), text)).alias("evidence"))
    cited = F.when(n % 5 == 0, F.array(F.lit(3))).when(n % 5 == 1, F.array(F.lit(2), F.lit(1))).when(n % 5 == 2, F.array().cast("array<int>")).otherwise(F.array(F.lit(2)))
    pick = F.get(F.array(*[F.lit(x) for x in "abcde"]), (n % 5).cast("int"))
    dec = i.where("issue_id % 11 != 0").select("run_id", text.alias("candidate"), F.when(n % 3 == 0, "dismiss").otherwise("accept").alias("verdict"), "severity", cited.alias("cited"), pick.alias("option"), F.when(n % 2 == 0, " new words ").otherwise(" ").alias("proposed"), F.lit("why").alias("explanation"))
    book = i.select("run_id", F.concat(F.lit("t"), text).alias("evidence_id"), F.lit("transcript").alias("kind"), F.lit("asr").alias("stage")).unionByName(i.select("run_id", F.concat(F.lit("s"), text).alias("evidence_id"), F.lit("signal").alias("kind"), F.when(n % 2 == 0, "audio").otherwise("video").alias("stage")))
    return c, dec, book


_ID = "'is_' || sha256(run_id || '|' || event_type || '|' || start_ms || '|' || end_ms)[1:24]"
JUD = f"""{ISS}, j0 as (select *, issue_id as n, {_ID} as iid, ['a', 'b', 'c', 'd', 'e'][issue_id % 5 + 1] as opt from iss where issue_id % 11 <> 0 and issue_id % 3 <> 0),
j1 as (select *, case when opt <> 'e' then 'su_' || sha256(iid || '|' || opt)[1:24] end as sid, case opt when 'a' then 'cut' when 'b' then 'move' when 'c' then 'insert_visual' when 'd' then 'rewrite' end as op, case opt when 'b' then greatest(0, start_ms - 25000) when 'c' then start_ms end as dest from j0)"""


@query(f"""with {JUD}, k as (select * exclude (evidence_status), case n % 5 when 0 then 'visual' when 1 then case when n % 2 = 0 then 'audio,speech' else 'speech,visual' end when 2 then 'speech' else case when n % 2 = 0 then 'audio' else 'visual' end end as tags, case when n % 7 = 0 or n % 5 in (0, 2) then 'provisional' else 'supported' end as evidence_status,
  case n % 5 when 0 then 'o' || n when 1 then 's' || n || ',t' || n when 2 then '' else 's' || n end as evidence_ids from j1), w as (select *, case when start_ms < lag(end_ms) over (partition by run_id, event_type order by start_ms, iid) then 0 else 1 end as new from k), g as (select *, sum(new) over (partition by run_id, event_type order by start_ms, iid rows unbounded preceding) as gr from w)
 select run_id, iid as issue_id, event_type as type, start_ms, end_ms, tags, severity, evidence_status, evidence_ids, coalesce(sid, '') as suggestion_id, 'cause-' || first_value(iid) over (partition by run_id, event_type, gr order by start_ms, iid) as cause_group from g""")  # fmt: skip
def k12_issues(spark, d):
    i, _, _ = dc.judged(*_decided(spark, d))
    return i.withColumns({"tags": F.array_join("tags", ","), "evidence_ids": F.array_join("evidence_ids", ","), "suggestion_id": F.coalesce("suggestion_id", F.lit(""))})


_CLOCK = "({0} // 60000)::varchar || ':' || lpad(({0} // 1000 % 60)::varchar, 2, '0')"


@query(f"""with {JUD} select run_id, sid as suggestion_id, iid as issue_id, op as operation, start_ms, end_ms, coalesce(dest, -1) as destination_ms, case when op in ('rewrite', 'insert_visual') and n % 2 = 0 then 'new words' else '' end as proposed_text,
 case op when 'cut' then 'Removes ' || printf('%.1f', (end_ms - start_ms + 50) // 100 / 10) || ' s (' || {_CLOCK.format('start_ms')} || '-' || {_CLOCK.format('end_ms')} || ').' when 'move' then 'Brings ' || {_CLOCK.format('start_ms')} || '-' || {_CLOCK.format('end_ms')} || ' ' || printf('%.1f', (abs(start_ms - dest) + 50) // 100 / 10) || ' s ' || case when start_ms > dest then 'earlier.' else 'later.' end
  else 'Effect on retention unknown until the edited video is reanalysed.' end as rationale, op <> 'cut' as requires_reanalysis from j1 where sid is not null""")  # fmt: skip
def k12_suggestions(spark, d):
    _, s, _ = dc.judged(*_decided(spark, d))
    return s.fillna(-1, ["destination_ms"]).fillna("", ["proposed_text"])


def _key_evidence(spark, d):
    i = issues(spark, d)
    n = F.col("issue_id")
    key = F.get(F.array(*[F.lit(k) for k in ("wpm", "clip", "pause", "black", "static", "other")]), (n % 6).cast("int"))
    text = F.when(n % 6 == 0, F.concat((n % 300).cast("string"), F.lit(" words per minute"))).when((n % 6 == 1) & (n % 4 != 3), F.concat(F.lit("clipped in "), (n % 100).cast("string"), F.lit(".5%"))).otherwise("measured")
    return i.select("run_id", F.concat(F.lit("ev"), n.cast("string")).alias("evidence_id"), F.concat(key, F.lit(":"), n.cast("string")).alias("ref_key"), "start_ms", "end_ms", text.alias("text"))


@query(f"""with {ISS}, e as (select *, issue_id as n, ['wpm', 'clip', 'pause', 'black', 'static', 'other'][issue_id % 6 + 1] as k from iss), f as (select * from (values ('wpm', 'F40', 'speech', 'speech_rate', 'words/min'), ('clip', 'F42', 'audio', 'clipped_share', 'fraction'), ('pause', 'F39', 'audio', 'pause', 'ms'), ('black', 'F06', 'visual', 'black', 'ms'), ('static', 'F11', 'visual', 'low_motion_shot', 'ms')) v(k, feature_id, modality, name, unit)),
 s as (select * exclude (value), case when unit = 'ms' then (end_ms - start_ms)::varchar when k = 'wpm' then (n % 300)::varchar when n % 4 <> 3 then round((n % 100 + 0.5) / 100, 6)::double::varchar end as value from e join f using (k))
 select run_id, 'ev' || n as evidence_id, 'sg_' || sha256(run_id || '|' || k || ':' || n)[1:24] as signal_id, feature_id, modality, name, unit, coalesce(value, '') as value, case when value is null then 'unknown' else 'measured' end as validity from s""")  # fmt: skip
def k17_key_signals(spark, d):
    """Every evidence key resolved to its signal."""
    s, e = dc.key_signals(_key_evidence(spark, d))
    return e.join(s, (e.run_id == s.run_id) & (e.ref_id == s.signal_id)).select(e.run_id, "evidence_id", "signal_id", "feature_id", "modality", "name", "unit", F.coalesce("value", F.lit("")).alias("value"), "validity")


def _signals(spark, d) -> DataFrame:
    answers, chunks, segments = recorded(spark, d, GONE)
    rates = chunks.select("run_id", "start_ms", "end_ms", (100 + F.col("chunk") % 50).alias("wpm"), F.when(F.col("chunk") % 3 == 0, "word").otherwise("segment").alias("precision"))
    return dc.structure_signals(dc.structure(answers, chunks, segments), dc.chapters(answers, chunks), dc.spans(answers, chunks, segments), rates)


@query(f"""with {REC}, {_SPAN_ROWS}, {_at('sp', 'loc')}, c as (select * from (values (0, 1), (2, 4)) v(first, last)), cp as (select run_id, 'F61' as feature_id, 'chapter' as name, '{{"label":"part ' || first || '","role":"body"}}' as value, min(start_ms) as start_ms, max(end_ms) as end_ms from c join ch on chunk = first or chunk = last group by run_id, first),
 ft as (select unnest([{', '.join(repr(k) for k in KINDS)}]) as kind, unnest([{', '.join(repr(v) for v in dc.SPAN_FEATURES.values())}]) as feature_id)
 select run_id, feature_id, name, value, start_ms, end_ms, 'label' as unit, 'estimated' as validity from cp union all select run_id, feature_id, kind, to_json({{'quote': quote}})::varchar, loc.start_ms, loc.end_ms, 'label', 'estimated' from sp join loc using (run_id, k) join ft using (kind)
 union all select run_id, 'F59', 'time_to_substance', start_ms::varchar, 0, greatest(1, start_ms), 'ms', 'estimated' from ch where chunk = 1 union all select run_id, 'F40', 'speech_rate', (100 + chunk % 50)::varchar, start_ms, end_ms, 'words/min', case when chunk % 3 = 0 then 'measured' else 'estimated' end from ch""")  # fmt: skip
def k14_structure_signals(spark, d):
    return _signals(spark, d).where("name != 'hook'").select("run_id", "feature_id", "name", "value", "start_ms", "end_ms", "unit", "validity")


@query(f"""with {REC}, {_SPAN_ROWS}, {_at('sp', 'loc')} select run_id, kind as name, loc.start_ms, loc.end_ms from sp join loc using (run_id, k) where kind in ('sponsor', 'outro', 'greeting') union all select run_id, 'time_to_substance', 0, greatest(1, start_ms) from ch where chunk = 1""")
def p07_selected_signals(spark, d):
    return dc.selected(_signals(spark, d), ["F62", "F59"], ["outro"]).select("run_id", "name", "start_ms", "end_ms")


@query(f"""with {REC}, f as (select run_id, start_ms, end_ms, chunk % 4 as n from ch where chunk % 4 > 0) select run_id, 'F52' as feature_id, 'filler_rate' as name, '{{"count":' || n || ',"per_min":' || round(n * 60000 / (end_ms - start_ms), 1)::double || '}}' as value, start_ms, end_ms from f
 union all select run_id, 'F47', 'language_switch', '{{"from":"' || case when seg_idx % 2 = 0 then 'hi' else 'en' end || '","to":"' || case when seg_idx % 2 = 0 then 'en' else 'hi' end || '"}}', start_ms, start_ms + 1 from sg where seg_idx % 9 = 8""")  # fmt: skip
def k15_speech_signals(spark, d):
    _, chunks, s = recorded(spark, d)
    even = F.col("seg_idx") % 2 == 0
    switches = s.where("seg_idx % 9 = 8").select("run_id", F.col("start_ms").alias("at_ms"), F.when(even, "hi").otherwise("en").alias("previous"), F.when(even, "en").otherwise("hi").alias("language"))
    return dc.speech_signals(chunks.withColumn("count", F.col("chunk") % 4), switches).select("run_id", "feature_id", "name", "value", "start_ms", "end_ms")


@query(f"""with {REC}, r as (select run_id, max(end_ms) as t from talk group by 1), w as (select run_id, t, unnest(range(0, t, 10000)) as a from r), n as (select run_id, start_ms // 10000 * 10000 as a, count(*) as n from sg where seg_idx % 2 = 0 group by 1, 2)
 select w.run_id, 'F01' as feature_id, 'cuts_per_10s' as name, coalesce(n, 0)::varchar as value, w.a as start_ms, least(t, w.a + 10000) as end_ms from w left join n on n.run_id = w.run_id and n.a = w.a
 union all select run_id, 'F06', 'black', (end_ms - start_ms)::varchar, start_ms, end_ms from sg where seg_idx % 5 = 1 union all select run_id, 'F39', 'waveform_silence', (end_ms - start_ms)::varchar, start_ms, end_ms from sg where seg_idx % 7 = 3
 union all select run_id, 'F11', 'motion_energy', '{{"t_ms":[' || string_agg(start_ms, ',' order by start_ms) || '],"v":[' || string_agg(seg_idx % 13, ',' order by start_ms) || ']}}', 0, max(end_ms) from sg group by 1""")  # fmt: skip
def k16_measured_signals(spark, d):
    _, _, s = recorded(spark, d)
    runs = s.groupBy("run_id").agg(F.max("end_ms").alias("end_ms"))
    spans = {"black": s.where("seg_idx % 5 = 1"), "silence": s.where("seg_idx % 7 = 3")}
    series = {"motion_energy": s.select("run_id", F.col("start_ms").alias("t_ms"), (F.col("seg_idx") % 13).alias("v"))}
    x = dc.measured_signals(runs, s.where("seg_idx % 2 = 0").select("run_id", F.col("start_ms").alias("at_ms")), spans, series)
    return x.select("run_id", "feature_id", "name", "value", "start_ms", "end_ms")
