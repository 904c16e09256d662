"""Queries over candidate issues and the edits they offer, evidence, and texts within a budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import word_count
from tidemark.operators import candidates as c
from tidemark.operators import selects, signals
from tidemark.plans import picked  # noqa: F401  its speech rates are built on here
from tidemark.plans.inputs import ISS, WORDS, issues
from tidemark.plans.registry import SQL, query
from tidemark.plans.seconds import PAUSE, RUN, Run

COLS = "run_id, type, start_ms, end_ms, operation, edit_start, edit_end, coalesce(destination_ms, -1) as destination_ms, absence"


def _out(df):
    return df.fillna(-1, ["destination_ms"])


@query(f"""with {RUN}, wx as (select run_id, start_ms as a, end_ms as b, (start_ms // 100) % 7 = 0 as e from wd), so as (select *, sum(coalesce(lag_e, true)::int) over (partition by run_id order by a, b) as sn from (select *, lag(e) over (partition by run_id order by a, b) as lag_e from wx)), ss as (select *, min(a) over (partition by run_id, sn) as s from so),
 i as (select run_id, 0 as start_ms, substance as end_ms, case when hook_end_ms < substance then hook_end_ms else 0 end as x0, substance as x1 from stc where substance >= 20000),
 q as (select i.*, (select max({{'a': a, 'e': e, 's': s}}) from ss where ss.run_id = i.run_id and a < x0) as p0, (select min(a) from ss where ss.run_id = i.run_id and a >= x0) as n0, (select max({{'a': a, 'b': b, 'e': e}}) from ss where ss.run_id = i.run_id and a < x1) as p1, (select min({{'a': a, 'b': b}}) from ss where ss.run_id = i.run_id and a >= x1 and e) as e1 from i),
 z as (select *, case when p0 is not null and not p0.e then p0.s when n0 is not null then n0 else x0 end as y0 from q)
 select run_id, 'slow_intro' as type, start_ms::bigint as start_ms, end_ms, 'rewrite' as operation, y0 as edit_start, case when p1 is not null and p1.a >= y0 and p1.e then p1.b when p1 is not null and p1.a >= y0 and e1.b - x1 <= 15000 then e1.b else x1 end as edit_end, -1 as destination_ms, false as absence from z""")  # fmt: skip
def k01_slow_intros(spark, d):
    r = Run(spark, d)
    w = r.words.select("run_id", "start_ms", "end_ms", F.when(F.floor(F.col("start_ms") / 100) % 7 == 0, "end.").otherwise("word").alias("text"))
    return _out(c.slow_intros(r.structure, w))


@query(f"""with {RUN}, fin as (select run_id, max(start_ms) as a, arg_max(end_ms, start_ms) as b from talk group by 1)
 select pro.run_id, 'delayed_payoff' as type, 0 as start_ms, first as end_ms, 'move' as operation, talk.start_ms as edit_start, talk.end_ms as edit_end, coalesce(hook_ms, 0) as destination_ms, false as absence from pro join talk on talk.run_id = pro.run_id and talk.start_ms <= first and first < talk.end_ms left join stc on stc.run_id = pro.run_id where status in ('fulfilled', 'partial') and first >= 60000
 union all select run_id, 'unresolved_promise', coalesce(setup_ms, 0), t, 'rewrite', a, b, -1, true from pro join dur using (run_id) join fin using (run_id) where status in ('unaddressed', 'uncertain') and t > coalesce(setup_ms, 0)""")  # fmt: skip
def k02_late_payoffs(spark, d):
    r = Run(spark, d)
    return _out(c.late_payoffs(r.runs, r.promises, r.structure, r.segments))


_COS = "round(((run_id * 7 + seg_idx * 13) % 17) / 100 + case when (run_id + seg_idx) % 9 = 6 and seg_idx % 2 = 0 then -1.0 else 0.6 end, 4)"


@query(f"""with {RUN}, p as (select run_id, start_ms, end_ms, {_COS}::double as cos from talk), n as (select *, row_number() over (partition by run_id order by cos) as i, count(*) over (partition by run_id) as n from p), m as (select run_id, cos as mid from n where i = n // 2 + 1 and n >= 6),
 v as (select p.run_id, abs(cos - mid) as away, mid, row_number() over (partition by p.run_id order by abs(cos - mid)) as i, count(*) over (partition by p.run_id) as n from p join m using (run_id)), lim as (select run_id, mid - 2.5 * greatest(away, 0.005) as lim from v where i = n // 2 + 1),
 t as (select spn.run_id, spn.start_ms, spn.end_ms, max(cos) as best from spn join p on p.run_id = spn.run_id and p.start_ms < spn.end_ms and p.end_ms > spn.start_ms where kind = 'tangent_candidate' group by 1, 2, 3), k as (select t.*, row_number() over (partition by t.run_id order by t.start_ms) as k from t join lim using (run_id) where best < lim)
 select run_id, 'tangent' as type, start_ms, end_ms, 'cut' as operation, start_ms as edit_start, end_ms as edit_end, -1 as destination_ms, false as absence from k where k <= 4""")  # fmt: skip
def k03_tangents(spark, d):
    r = Run(spark, d)
    k, i = F.col("run_id"), F.col("seg_idx")
    cos = F.round((k * 7 + i * 13) % 17 / 100 + F.when(((k + i) % 9 == 6) & (i % 2 == 0), -1.0).otherwise(0.6), 4)
    return _out(c.tangents(r.spans, r.segments.select("run_id", "start_ms", "end_ms", cos.alias("title_cos"))))


@query(f"""with {RUN}, a as (select spn.*, row_number() over (partition by run_id order by start_ms, end_ms) as k from spn where kind in ('cta', 'sponsor')), b as (select a.*, t, coalesce(substance, 0) as sub from a join dur using (run_id) join stc using (run_id) where k <= 3)
 select run_id, 'disruptive_cta' as type, start_ms, end_ms, 'move' as operation, start_ms as edit_start, end_ms as edit_end, case when start_ms < sub then t - 1 else greatest(sub, least(t - 1, sub + 60000)) end as destination_ms, false as absence from b where start_ms <= t - 45000""")  # fmt: skip
def k04_disruptive_requests(spark, d):
    r = Run(spark, d)
    return _out(c.disruptive_requests(r.runs, r.spans, r.structure))


@query(f"""with {PAUSE}, k as (select *, row_number() over (partition by run_id order by end_ms - start_ms desc, start_ms) as k from pau)
 select run_id, 'dead_air' as type, start_ms, end_ms, 'cut' as operation, start_ms + 300 as edit_start, greatest(start_ms + 301, end_ms - 300) as edit_end, -1 as destination_ms, false as absence from k where k <= 6""")  # fmt: skip
def k06_dead_air(spark, d):
    r = Run(spark, d)
    return _out(c.dead_air(signals.pauses(r.runs, r.speech, r.silence, r.rms)))


@query(f"""with {RUN}, g as (select run_id, seg_idx as part, start_ms, end_ms from talk), x as ({SQL["a11_speech_rates"].replace("seg_idx // 3", "seg_idx").replace("(start_ms // 1000) % 9 <> 0", "true")}), k as (select g.*, row_number() over (partition by g.run_id order by wpm desc, g.start_ms) as k from x join g using (run_id, part) where wpm > greatest(190.0, 1.25 * usual))
 select run_id, 'rushed_delivery' as type, start_ms, end_ms, 'rewrite' as operation, start_ms as edit_start, end_ms as edit_end, -1 as destination_ms, false as absence from k where k <= 3""")  # fmt: skip
def k07_rushed(spark, d):
    r = Run(spark, d)
    g = r.segments.select("run_id", F.col("seg_idx").cast("bigint").alias("part"), "start_ms", "end_ms", word_count(F.col("text")).alias("n_words"))
    return _out(c.rushed(g, selects.speech_rates(g, r.words.withColumnRenamed("seg_idx", "part"))))


@query(f"""with {ISS}, b as (select run_id, start_ms, end_ms, value from iss where event_type = 'error'), r as (select *, max(end_ms) over (partition by run_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from b), n as (select *, sum(case when reach is null or start_ms > reach + 2000 then 1 else 0 end) over (partition by run_id order by start_ms, end_ms rows unbounded preceding) as k from r),
 u as (select run_id, min(start_ms) as start_ms, max(end_ms) as end_ms, max(value) as fraction from n group by run_id, k), q as (select *, row_number() over (partition by run_id order by fraction desc, start_ms) as z from u)
 select run_id, 'technical_audio_fault' as type, start_ms, end_ms, 'adjust_audio' as operation, start_ms as edit_start, end_ms as edit_end, -1 as destination_ms, false as absence from q where z <= 3""")  # fmt: skip
def k08_clip_faults(spark, d):
    return _out(c.clip_faults(issues(spark, d).where("event_type = 'error'").select("run_id", "start_ms", "end_ms", F.col("value").alias("fraction"))))


@query(f"""with {RUN}, bl as (select run_id, start_ms + 200 as start_ms, start_ms + 700 as end_ms, row_number() over (partition by run_id order by start_ms) as k from talk where seg_idx % 3 = 0), b as (select bl.* from bl join dur using (run_id) where k <= 4 and start_ms >= 1000 and end_ms <= t - 1000)
 select run_id, 'technical_visual_fault' as type, start_ms, end_ms, case when exists (select 1 from sp where sp.run_id = b.run_id and sp.start_ms < b.end_ms and sp.end_ms > b.start_ms) then 'insert_visual' else 'cut' end as operation, start_ms as edit_start, end_ms as edit_end, -1 as destination_ms, false as absence from b""")  # fmt: skip
def k09_black_faults(spark, d):
    r = Run(spark, d)
    black = r.segments.where("seg_idx % 3 = 0").select("run_id", (F.col("start_ms") + 200).alias("start_ms"), (F.col("start_ms") + 700).alias("end_ms"))
    return _out(c.black_faults(r.runs, black, r.speech))


@query(f"""with {RUN}, a as (select *, row_number() over (partition by run_id order by start_ms) as k from sht where end_ms - start_ms >= 15000 and motion < 0.02)
 select run_id, 'visual_stagnation' as type, start_ms, end_ms, 'insert_visual' as operation, start_ms as edit_start, end_ms as edit_end, -1 as destination_ms, false as absence from a where k <= 6 and exists (select 1 from spn where spn.run_id = a.run_id and spn.start_ms < a.end_ms and spn.end_ms > a.start_ms)""")  # fmt: skip
def k10_stagnation(spark, d):
    r = Run(spark, d)
    return _out(c.stagnation(r.shots, r.spans))


@query(f"""with {ISS}, s as (select run_id, 'transcript' as kind, (issue_id % 50)::varchar as ref_id, start_ms, end_ms, 0 as i from iss where event_type <> 'view' union all select run_id, case event_type when 'view' then 'transcript' else 'signal' end, (issue_id % 50)::varchar, start_ms + 1, end_ms + 1, 1 from iss),
 k as (select *, row_number() over (partition by run_id, kind, ref_id order by i, start_ms, end_ms) as k from s) select run_id, 'ev_' || sha256(kind || '|' || ref_id || '|' || run_id)[1:24] as evidence_id, kind, ref_id, start_ms, end_ms from k where k = 1""")  # fmt: skip
def k18_evidence(spark, d):
    i = issues(spark, d).withColumn("ref_id", F.col("issue_id") % 50)
    said = i.where("event_type != 'view'").select("run_id", F.lit("transcript").alias("kind"), "ref_id", "start_ms", "end_ms")
    more = i.select("run_id", F.when(F.col("event_type") == "view", "transcript").otherwise("signal").alias("kind"), "ref_id", (F.col("start_ms") + 1).alias("start_ms"), (F.col("end_ms") + 1).alias("end_ms"))
    return c.evidence(said, more)


@query(f"""with {RUN}, x as (select *, least(1.0, 1500 / greatest(1, sum(length(text)) over (partition by run_id))) as scale, {WORDS.format('text')} as n, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as ws from talk), y as (select *, greatest(25, floor(n * scale)::int) as keep from x)
 select run_id, seg_idx as paragraph, case when scale < 1 then array_to_string(ws[1:keep], ' ') || case when keep < n then ' …' else '' end else text end as shown from y""")  # fmt: skip
def k19_shown_paragraphs(spark, d):
    p = Run(spark, d).segments.select("run_id", F.col("seg_idx").alias("paragraph"), "text")
    return c.within_budget(p, 1500).select("run_id", "paragraph", "shown")
