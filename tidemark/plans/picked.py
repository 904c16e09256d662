"""Queries over selections, small sets, rollups and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import risk
from tidemark.operators import selects as s
from tidemark.operators.signals import seconds
from tidemark.plans.inputs import ISS, WORDS, issues, runs, spans, table, turns
from tidemark.plans.linked import MOMENTS, _moments
from tidemark.plans.queries import RISK, RUNS, TOPIC
from tidemark.plans.registry import SQL, query
from tidemark.plans.seconds import RUN, Run
from tidemark.sources.packages import active_runs, orphans

_R = "r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1)"


@query(f"with {ISS} select run_id, issue_id from iss where start_ms < 90000 and end_ms > 30000")
def p02_slice(spark, d):
    return s.sliced(issues(spark, d), 30_000, 90_000).select("run_id", "issue_id")


@query(f"with {ISS} select run_id, issue_id from iss where track in ('visual', 'text') and severity = 'high'")
def p03_chosen_issues(spark, d):
    i = issues(spark, d).withColumns({"tags": F.array("track", F.when(F.col("track") == "text", "visual")), "type": F.col("severity"), "review_status": F.lit("open")})
    return s.chosen(i, "visual", "high", "open").select("run_id", "issue_id")


FAST = f"f as (select conv_id as run_id, turn as seg_idx, text, {WORDS.format('text')} as n, 100 + turn * 3000 as ms from conversations)"


@query(f"with {FAST} select run_id, seg_idx from f where n >= 6 and n / (ms / 1000) > 10")
def p05_too_fast(spark, d):
    t = turns(spark, d).withColumns({"start_ms": F.lit(0), "end_ms": 100 + F.col("seg_idx") * 3000})
    return s.plausible(t)[1].select("run_id", "seg_idx")


@query(f"""with {RUN}, w as (select run_id, sum({WORDS.format('text')}) as n from talk group by 1), k as (select run_id, t / 1000 as s, n, case when run_id % 2 = 0 then 'script' else 'recording' end as kind from dur join w using (run_id))
 select run_id, case when kind = 'script' and n < 20 then 'too few words' when kind = 'script' and s not between 10 and 3600 then 'script length' when kind = 'recording' and s not between 300 and 900 then 'recording length' end as reason from k""")  # fmt: skip
def p06_scope(spark, d):
    r = Run(spark, d)
    n = r.segments.groupBy("run_id").agg(F.sum(ft.word_count(F.col("text"))).alias("n_words"))
    return s.scope(r.runs.join(n, "run_id").withColumn("kind", F.when(F.col("run_id") % 2 == 0, "script").otherwise("recording"))).select("run_id", "reason")


@query(f"with {ISS}, {_R} select iss.run_id, issue_id, start_ms - 20000 as start_ms, least(greatest(end_ms - 20000, start_ms - 19000), t) as end_ms from iss join r using (run_id) where start_ms - 20000 >= 0 and start_ms - 20000 < t")
def p08_citations(spark, d):
    i = issues(spark, d)
    moved = i.select("run_id", "issue_id", (F.col("start_ms") - 20_000).alias("start_ms"), (F.col("end_ms") - 20_000).alias("end_ms"))
    return s.citations(moved, runs(i))[0].select("run_id", "issue_id", "start_ms", "end_ms")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'an')")
def p10_found_text(spark, d):
    return s.found(table(spark, d, "part"), "p_name", "AN").select("p_partkey", "p_name")


@query("select c_custkey, o_orderkey from (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k <= 3")
def t12_newest(spark, d):
    return s.newest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query(f"""with w as (select conv_id as run_id, turn as seg_idx, {TOPIC.format('text')} as a, lag({TOPIC.format('text')}) over (partition by conv_id order by turn) as b from conversations)
 select run_id, seg_idx, array_to_string(list_sort(list_intersect(a, b)), ',') as shared, len(a) - len(list_intersect(a, b)) as n_only_first, len(list_distinct(list_concat(a, b))) as n_either from w where b is not null""")  # fmt: skip
def u01_word_sets(spark, d):
    t = turns(spark, d).select("run_id", "seg_idx", ft.topic_words(F.col("text")).alias("a")).withColumn("b", F.lag("a").over(Window.partitionBy("run_id").orderBy("seg_idx"))).where("b is not null")
    x = s.word_sets(t, F.col("a"), F.col("b"))
    return x.select("run_id", "seg_idx", F.array_join("shared", ",").alias("shared"), F.size("only_first").alias("n_only_first"), F.size("either").alias("n_either"))


@query(f"with {ISS} select distinct run_id, issue_id + 1 as issue_id from iss a where not exists (select 1 from iss b where b.run_id = a.run_id and b.issue_id = a.issue_id + 1)")
def u05_unknown_ids(spark, d):
    i = issues(spark, d)
    return s.unknown(i.select("run_id", (F.col("issue_id") + 1).alias("issue_id")), i, "issue_id")


@query("select event_id, round((epoch_us(ts) // 1000 - epoch_us(ts0) // 1000) / 1000, 3) as seconds from (select event_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as ts0 from events) where ts0 is not null")
def f13_seconds_between(spark, d):
    e = table(spark, d, "events").withColumn("ts0", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("ts0 is not null")
    return e.select("event_id", F.round(s.seconds_between(F.col("ts0"), F.col("ts")), 3).alias("seconds"))


@query("""with b as (select vec_id, label, [list_min([e[1], e[3], e[5], e[7]]), list_min([e[2], e[4], e[6], e[8]]), list_max([e[1], e[3], e[5], e[7]]), list_max([e[2], e[4], e[6], e[8]])] as q from (select vec_id, label, embedding::double[] as e from embeddings)),
 p as (select x.vec_id, x.q as a, y.q as b from b x join b y on y.vec_id = x.vec_id + 1), o as (select vec_id, a, b, greatest(0.0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0.0, least(a[4], b[4]) - greatest(a[2], b[2])) as shared from p),
 v as (select *, (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - shared as either from o)
 select vec_id, round(case when either > 0 then shared / either else 0.0 end, 6) as iou, case when (a[2] + a[4]) / 2 < 1.0 / 3 then 'top' when (a[2] + a[4]) / 2 < 2.0 / 3 then 'middle' else 'bottom' end || '-' || case when (a[1] + a[3]) / 2 < 1.0 / 3 then 'left' when (a[1] + a[3]) / 2 < 2.0 / 3 then 'centre' else 'right' end as zone from v""")  # fmt: skip
def f14_boxes(spark, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    quad = F.array(*[F.array(F.get(e, F.lit(2 * k)), F.get(e, F.lit(2 * k + 1))) for k in range(4)])
    b = table(spark, d, "embeddings").select("vec_id", s.box_of(quad).alias("a"))
    x = b.join(b.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return x.select("vec_id", F.round(s.box_overlap(F.col("a"), F.col("b")), 6).alias("iou"), s.box_zone(F.col("a")).alias("zone"))


@query(f"with {ISS} select run_id, issue_id, case event_type when 'click' then (end_ms - start_ms) / 1000 when 'view' then (start_ms - 30000) / 1000 end as seconds from iss")
def f21_edit_effects(spark, d):
    op = F.when(F.col("event_type") == "click", "cut").when(F.col("event_type") == "view", "move").otherwise("rewrite")
    return issues(spark, d).select("run_id", "issue_id", s.edit_effect(op, F.col("start_ms"), F.col("end_ms"), F.lit(30_000)).alias("seconds"))


@query("select event_id, json_extract_string(props, '$.k') as label from events")
def f20_json_values(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("label"))


@query(f"""with {RUN}, sa as (select run_id, t * 1000 as at_ms, (t * 7 + run_id) % 10 / 10 as motion, (t * 3) % 5 / 5 as brightness from sec), x as (select sht.run_id, shot, sa.motion, brightness, row_number() over (partition by sht.run_id, shot order by at_ms) as k from sht join sa on sa.run_id = sht.run_id and sht.start_ms <= at_ms and at_ms < sht.end_ms),
 m as (select run_id, shot, avg(motion) filter (k > 1) as motion_mean, max(motion) filter (k > 1) as motion_max, avg(brightness) as brightness_mean from x group by 1, 2)
 select sht.run_id, sht.shot, coalesce(round(motion_mean, 6), -1.0) as motion_mean, coalesce(motion_max, -1.0) as motion_max, coalesce(round(brightness_mean, 6), -1.0) as brightness_mean from sht left join m using (run_id, shot)""")  # fmt: skip
def a06_shot_metrics(spark, d):
    r = Run(spark, d)
    t = F.col("t")
    sa = seconds(r.runs).select("run_id", (t * 1000).cast("bigint").alias("at_ms"), ((t * 7 + F.col("run_id")) % 10 / 10).alias("motion"), (t * 3 % 5 / 5).alias("brightness"))
    x = s.shot_metrics(r.shots.select("run_id", "shot", "start_ms", "end_ms"), sa)
    return x.select("run_id", "shot", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c) for c in ("motion_mean", "motion_max", "brightness_mean")])


@query("""with x as (select label as run_id, vec_id * 64 + i - 1 as i, e[i] as x from (select label, vec_id, embedding::double[] as e, unnest(range(1, 65)) as i from embeddings)), g as (select run_id, i // 100 as win, avg((abs(x) >= 0.3)::int) as clipped, sqrt(avg(x * x)) as r, max(abs(x)) as peak from x group by 1, 2)
 select run_id, win, round(clipped, 6) as clipped, coalesce(round(case when r > 0 then 20 * log10(r) end, 5), -999.0) as rms_db, round(peak, 6) as peak from g""")  # fmt: skip
def a09_sample_windows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("run_id"), "vec_id", F.posexplode("embedding").alias("p", "x"))
    w = s.sample_windows(e.select("run_id", (F.col("vec_id") * 64 + F.col("p")).alias("i"), F.col("x").cast("double").alias("x")), 100, 0.3)
    return w.select("run_id", "win", F.round("clipped", 6).alias("clipped"), F.coalesce(F.round("rms_db", 5), F.lit(-999.0)).alias("rms_db"), F.round("peak", 6).alias("peak"))


@query(f"with {RUN} select dur.run_id, coalesce(sum(end_ms - start_ms), 0) >= 0.1 * any_value(t) as silent from dur left join sil using (run_id) group by 1")
def a10_silent_runs(spark, d):
    r = Run(spark, d)
    return s.silent_runs(r.runs, r.silence, 0.1).select("run_id", "silent")


@query(f"""with {RUN}, g as (select run_id, seg_idx // 3 as part, min(start_ms) as start_ms, max(end_ms) as end_ms, sum({WORDS.format('text')}) as n from talk group by 1, 2), w as (select run_id, seg_idx // 3 as part, case when (start_ms // 1000) % 9 <> 0 then start_ms end as a, end_ms as b from wd),
 ld as (select *, lead(a) over (partition by run_id, part order by a, b) - b as gap from w where a is not null), sp2 as (select run_id, part, sum(b - a + case when gap > 0 and gap < 500 then gap else 0 end) as speak, count(*) as timed from ld group by 1, 2), al as (select run_id, part, count(*) as n_all from w group by 1, 2),
 x as (select g.*, speak, timed, coalesce(timed / n_all >= 0.9 and timed >= 10, false) as exact from g left join sp2 using (run_id, part) left join al using (run_id, part)), y as (select *, case when exact then speak else end_ms - start_ms end / 60000 as m from x),
 z as (select run_id, part, round_even(case when exact then timed else n end / m, 0)::int as wpm, case when exact then 'word' else 'segment' end as precision from y where m > 0.15), u as (select *, row_number() over (partition by run_id order by wpm) as i, count(*) over (partition by run_id) as c from z)
 select z.run_id, z.part, z.wpm, z.precision, u.wpm as usual from z join u on u.run_id = z.run_id and u.i = u.c // 2 + 1""")  # fmt: skip
def a11_speech_rates(spark, d):
    r = Run(spark, d)
    part = F.floor(F.col("seg_idx") / 3).alias("part")
    g = r.segments.groupBy("run_id", part).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum(ft.word_count(F.col("text"))).alias("n_words"))
    w = r.words.select("run_id", part, F.when(F.floor(F.col("start_ms") / 1000) % 9 != 0, F.col("start_ms")).alias("start_ms"), "end_ms")
    return s.speech_rates(g, w).select("run_id", "part", "wpm", "precision", "usual")


@query("""select user_id as run_id, case when bool_or(event_type = 'error' and value > 150) then 'failed' when bool_or(event_type = 'click' and value > 200) then 'running' when bool_or(event_type = 'view' and value > 100) then 'partial' else 'complete' end as state from events group by 1""")
def a22_workflow_state(spark, d):
    status = F.when(F.expr("event_type = 'error' and value > 150"), "failed").when(F.expr("event_type = 'click' and value > 200"), "pending").when(F.expr("event_type = 'view' and value > 100"), "partial").otherwise("complete")
    return s.workflow_state(table(spark, d, "events").select(F.col("user_id").alias("run_id"), status.alias("status")))


@query("select user_id as run_id, event_id % 7 as still, round(min(value), 6) as confidence, array_to_string(list_sort(list_distinct(list(event_type))), ',') as texts from events group by 1, 2")
def a24_still_texts(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.col("event_id") % 7).alias("still"), F.col("value").alias("confidence"), F.col("event_type").alias("text"))
    return s.still_texts(e).select("run_id", "still", F.round("confidence", 6).alias("confidence"), F.array_join("texts", ",").alias("texts"))


@query(f"""with {RISK}, cb as (select bins.run_id, p.track, b0, b1, coalesce(c, 0.0) as c from bins cross join (values ('visual'), ('text')) p(track) left join cov on cov.run_id = bins.run_id and cov.bin = bins.bin and cov.track = p.track)
 select i.run_id, i.issue_id, array_to_string(list_sort(list_distinct(list(cb.track))), ',') as tracks from iss i join cb on cb.run_id = i.run_id and cb.b0 < i.end_ms and cb.b1 > i.start_ms where cb.c < 0.999 group by 1, 2""")  # fmt: skip
def a37_not_inspected(spark, d):
    i = issues(spark, d)
    g = risk.grid(runs(i))
    c = g.withColumn("track", F.explode(F.array(F.lit("visual"), F.lit("text")))).join(risk.coverage(spans(i), g), ["run_id", "bin", "track"], "left").select("run_id", "track", F.col("b0").alias("start_ms"), F.col("b1").alias("end_ms"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
    return s.not_inspected(i, c).withColumn("tracks", F.array_join("tracks", ","))


@query("""with f as (select user_id as run_id, epoch_us(ts) // 1000 as b, lag(epoch_us(ts) // 1000) over (partition by user_id order by ts) as a from events), x as (select *, b - a as step from f where a is not null), m as (select *, row_number() over (partition by run_id order by step) as i, count(*) over (partition by run_id) as n from x)
 select x.run_id, x.a as start_ms, x.b as end_ms from x join m on m.run_id = x.run_id and m.i = m.n // 2 + 1 where x.step > 3 * m.step and x.step > 250""")  # fmt: skip
def w07_decode_gaps(spark, d):
    return s.decode_gaps(table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms")))


@query(f"""with {RUN}, sg as (select run_id, seg_idx // 4 as paragraph, seg_idx, case when seg_idx >= 8 and seg_idx % 4 < 3 then lag(text, 8) over (partition by run_id order by seg_idx) else text end as text from talk), g as (select run_id, paragraph, seg_idx, unnest({RUNS.format('text')}) as g from sg),
 pr as (select distinct run_id, paragraph - 2 as earlier, paragraph as later from sg where paragraph >= 2), x as (select pr.run_id, earlier, later, l.seg_idx, avg((e.g is not null)::int) as s from pr join g l on l.run_id = pr.run_id and l.paragraph = pr.later left join (select distinct run_id, paragraph, g from g) e on e.run_id = pr.run_id and e.paragraph = pr.earlier and e.g = l.g group by 1, 2, 3, 4),
 k as (select *, seg_idx - row_number() over (partition by run_id, earlier, later order by seg_idx) as k from x where s >= 0.5), r2 as (select run_id, earlier, later, min(seg_idx) as first, max(seg_idx) as last, count(*) as n from k group by run_id, earlier, later, k having count(*) >= 2)
 select run_id, earlier, later, first, last from (select *, row_number() over (partition by run_id, earlier, later order by n desc, first) as z from r2) where z = 1""")  # fmt: skip
def w18_repeated_runs(spark, d):
    t = Run(spark, d, spread=True).segments
    again = F.lag("text", 8).over(Window.partitionBy("run_id").orderBy("seg_idx"))
    sg = t.select("run_id", F.floor(F.col("seg_idx") / 4).alias("paragraph"), "seg_idx", F.when((F.col("seg_idx") >= 8) & (F.col("seg_idx") % 4 < 3), again).otherwise(F.col("text")).alias("text"))
    pairs = sg.where("paragraph >= 2").select("run_id", (F.col("paragraph") - 2).alias("earlier"), F.col("paragraph").alias("later")).distinct()
    return s.repeated_runs(pairs, sg)


@query(f"""with {ISS}, w as (select run_id, issue_id, event_type, start_ms, start_ms + value::bigint * 1000 as end_ms, cause_group from iss), n as (select *, case when start_ms < lag(end_ms) over (partition by run_id, event_type order by start_ms, issue_id) then 0 else 1 end as new from w), k as (select *, sum(new) over (partition by run_id, event_type order by start_ms, issue_id rows unbounded preceding) as k from n)
 select run_id, issue_id, first_value(cause_group) over (partition by run_id, event_type, k order by start_ms, issue_id) as cause_group from k""".replace("value::bigint * 1000", "round(value)::bigint * 1000"))  # fmt: skip
def w20_inherited_causes(spark, d):
    i = issues(spark, d).withColumns({"end_ms": F.col("start_ms") + F.round("value").cast("bigint") * 1000, "type": F.col("event_type")})
    return s.inherited_causes(i.select("run_id", "issue_id", "type", "start_ms", "end_ms", "cause_group")).select("run_id", "issue_id", "cause_group")


@query(f"""with {RUN}, fr as (select run_id, k * 700 as at_ms from (select run_id, unnest(range(t // 700 + 1)) as k from dur)), gr as (select sec.run_id, max(at_ms) as at_ms, 2 as p, 'grid' as why from sec join fr on fr.run_id = sec.run_id and fr.at_ms <= sec.t * 1000 group by sec.run_id, sec.t),
 ct as (select cut.run_id, max(fr.at_ms) filter (fr.at_ms < cut.at_ms) as b, min(fr.at_ms) filter (fr.at_ms >= cut.at_ms) as a from cut join fr using (run_id) group by cut.run_id, cut.at_ms), al as (select * from gr union all select run_id, b, 1, 'before cut' from ct where b is not null union all select run_id, a, 0, 'after cut' from ct where a is not null),
 g as (select run_id, at_ms, min(p) as p, array_to_string(list_sort(list_distinct(list(why))), ',') as reasons from al group by 1, 2) select run_id, at_ms, reasons from (select *, row_number() over (partition by run_id order by p, at_ms) as k from g) where k <= 60""")  # fmt: skip
def w24_sampling_plan(spark, d):
    r = Run(spark, d)
    fr = r.runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("duration_ms") / 700))).alias("k")).select("run_id", (F.col("k") * 700).alias("at_ms"))
    return s.sampling_plan(r.runs, fr, r.cuts, 60).withColumn("reasons", F.array_join("reasons", ","))


@query(SQL["w24_sampling_plan"].replace("where k <= 60", ""))
def w25_sampling_reasons(spark, d):
    """Every sampled frame with all of its reasons."""
    r = Run(spark, d)
    fr = r.runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("duration_ms") / 700))).alias("k")).select("run_id", (F.col("k") * 700).alias("at_ms"))
    return s.sampling_plan(r.runs, fr, r.cuts, 2**31 - 1).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""with {RUN}, wx as (select wd.run_id, start_ms as a, end_ms as b, (start_ms // 100) % 7 = 0 as e from wd), so as (select *, sum(coalesce(lag_e, true)::int) over (partition by run_id order by a, b) as sn from (select *, lag(e) over (partition by run_id order by a, b) as lag_e from wx)), ss as (select *, min(a) over (partition by run_id, sn) as s from so),
 sp3 as (select run_id, seg_idx as span, start_ms + 330 as x0, end_ms - 170 as x1 from talk where seg_idx % 3 = 0 and end_ms - start_ms > 1000), q as (select sp3.*, (select max({{'a': a, 'e': e, 's': s}}) from ss where ss.run_id = sp3.run_id and a < x0) as p0, (select min(a) from ss where ss.run_id = sp3.run_id and a >= x0) as n0, (select max({{'a': a, 'b': b, 'e': e}}) from ss where ss.run_id = sp3.run_id and a < x1) as p1, (select min({{'a': a, 'b': b}}) from ss where ss.run_id = sp3.run_id and a >= x1 and e) as e1 from sp3),
 z as (select *, case when p0 is not null and not p0.e then p0.s when n0 is not null then n0 else x0 end as y0 from q)
 select run_id, span, y0 as start_ms, case when p1 is not null and p1.a >= y0 and p1.e then p1.b when p1 is not null and p1.a >= y0 and e1.b - x1 <= 15000 then e1.b else x1 end as end_ms from z""")  # fmt: skip
def w26_snapped(spark, d):
    r = Run(spark, d)
    w = r.words.select("run_id", "start_ms", "end_ms", F.when(F.floor(F.col("start_ms") / 100) % 7 == 0, "end.\"").otherwise("word").alias("text"))
    sp = r.segments.where("seg_idx % 3 = 0 and end_ms - start_ms > 1000").select("run_id", F.col("seg_idx").alias("span"), (F.col("start_ms") + 330).alias("start_ms"), (F.col("end_ms") - 170).alias("end_ms"))
    return s.snapped(sp, w)


@query("""with p as (select conv_id as run_id, count(*) as n from conversations group by 1), de as (select conv_id as run_id, count(*) as d, count(*) filter (turn % 5 <> 4) as ok from conversations where conv_id % 3 <> 0 and (turn > 0 or conv_id % 3 = 1) group by 1)
 select p.run_id, 0::bigint as query_id, d is not null and d = n and ok = n as usable, case when d is null then 'no dense scores' when d <> n then 'wrong number of scores' when ok <> n then 'invalid scores' end as reason from p left join de using (run_id)""")  # fmt: skip
def q05_fallback(spark, d):
    t = turns(spark, d).withColumn("query_id", F.lit(0).cast("bigint"))
    dense = t.where("run_id % 3 != 0 and (seg_idx > 0 or run_id % 3 = 1)").withColumn("score", F.when(F.col("seg_idx") % 5 == 4, F.lit(float("nan"))).otherwise(1.0))
    return s.with_fallback(t.select("run_id", "query_id"), dense, t)


@query(f"with {MOMENTS} select m.run_id, m.start_ms // 25000 as selection, issue_id, i.start_ms < m.end_ms and i.end_ms > m.start_ms as inside from m join iss i on i.run_id = m.run_id and i.start_ms < m.end_ms + 20000 and i.end_ms > m.start_ms - 20000 where m.start_ms >= 50000")
def q08_around(spark, d):
    i = issues(spark, d)
    m = _moments(i).where("start_ms >= 50000").withColumn("selection", F.floor(F.col("start_ms") / 25_000))
    return s.around(i.select("run_id", "start_ms", "end_ms", "issue_id"), m).select("run_id", "selection", "issue_id", "inside")


@query(r"""with q as (select conv_id as run_id, list_distinct(list_filter(regexp_split_to_array(lower(text[1:80]), '\s+'), lambda w: w <> '')) as ws from conversations where turn = 0), h as (select c.conv_id as run_id, 0::bigint as query_id, turn as seg_idx, len(list_filter(ws, lambda w: contains(lower(text), w))) as hits from conversations c join q on q.run_id = c.conv_id)
 select *, row_number() over (partition by run_id order by hits desc, seg_idx)::int as rank from h where hits > 0""")  # fmt: skip
def q09_containment(spark, d):
    t = turns(spark, d)
    q = t.where("seg_idx = 0").select("run_id", F.lit(0).cast("bigint").alias("query_id"), F.substring("text", 1, 80).alias("text"))
    return s.containment_rank(t.select("run_id", "seg_idx", "text"), q, "seg_idx")


LINES = "ln as (select user_id as job, event_id as n, case when event_type = 'view' then 'PROGRESS {\"done\": ' || event_id || '}' else event_type || ' ' || event_id end as line from events)"


@query(f"with {LINES} select job, n, line from (select *, row_number() over (partition by job order by n desc) as k from ln where not starts_with(line, 'PROGRESS ')) where k <= 25 union all select job, -1, json_extract_string(arg_max(line[10:], n), '$.done') from ln where starts_with(line, 'PROGRESS ') group by 1")
def x03_progress(spark, d):
    line = F.when(F.col("event_type") == "view", F.concat(F.lit('PROGRESS {"done": '), "event_id", F.lit("}"))).otherwise(F.concat_ws(" ", "event_type", "event_id"))
    latest, tails = s.progress(table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("n"), line.alias("line")))
    return tails.select("job", "n", "line").unionByName(latest.select("job", F.lit(-1).cast("bigint").alias("n"), F.get_json_object("record", "$.done").alias("line")))


@query("select o_orderkey, case o_orderstatus when 'F' then 'complete' else 'failed' end as status from orders")
def x04_interrupted(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running")
    return s.interrupted(table(spark, d, "orders").select("o_orderkey", status.alias("status")))


@query("select sha256(text) as hash, count(*) as n from (select distinct text from documents where text is not null) where text not in (select text from documents where doc_id % 2 = 0 and text is not null) group by 1")
def y02_uncached(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    cache = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("hash")).distinct()
    return s.uncached(docs, cache).groupBy("hash").agg(F.count("*").alias("n"))


LOG = "e as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as n, value from events)"


@query(f"""with {LOG}, r as (select run_id, max(n) * 1000 as t from e group by 1), a as (select run_id, n, row_number() over (partition by run_id order by n) as k, n - 0.25 as v from e where n % 4 = 1), b as (select run_id, row_number() over (partition by run_id order by n) as k, n - 0.5 as v from e where n % 4 = 3),
 p as (select a.run_id, greatest(0, round(a.v * 1000)::bigint) as start_ms, least(coalesce(round(b.v * 1000)::bigint, t), t) as end_ms, b.v is null as open from a left join b using (run_id, k) join r using (run_id)) select * from p where end_ms > start_ms""")  # fmt: skip
def s09_silence_log(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))
    line = F.when(F.col("n") % 4 == 1, F.concat(F.lit("[x] silence_start: "), (F.col("n") - 0.25).cast("string"))).when(F.col("n") % 4 == 3, F.concat(F.lit("[x] silence_end: "), (F.col("n") - 0.5).cast("string"), F.lit(" | d: 2"))).otherwise("frame=1")
    return s.paired_log(e.select("run_id", "n", line.alias("line")), "silence_start", "silence_end", e.groupBy("run_id").agg((F.max("n") * 1000).cast("bigint").alias("duration_ms")))


@query(f"with {LOG} select run_id, (n * 100)::bigint as t_ms, round(-value, 1) as lufs from e where (n * 100) % 1000 < 100")
def s08_loudness_log(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), "value")
    line = F.concat(F.lit("[x] t: "), F.format_string("%.1f", F.col("n") / 10), F.lit("  TARGET:-23 LUFS M:-20 S: "), F.round(-F.col("value"), 1).cast("string"), F.lit(" I: -3"))
    return s.loudness_log(e.select("run_id", line.alias("line")))


@query("with t as (select conv_id as run_id, turn, text from conversations) select run_id, turn * 61000 as start_ms, trim(replace(text[1:30], chr(10), ' '), ' ') as text from t")
def s07_pasted_captions(spark, d):
    t = turns(spark, d)
    k = F.col("seg_idx")
    time = F.format_string("%d:%02d", F.floor(k * 61 / 60), k * 61 % 60)
    rows = F.array(F.struct((k * 3).alias("n"), time.alias("line")), F.struct((k * 3 + 1).alias("n"), F.regexp_replace(F.substring("text", 1, 30), "\n", " ").alias("line")), F.struct((k * 3 + 2).alias("n"), F.lit("Chapter").alias("line")))
    return s.pasted_captions(t.select("run_id", F.inline(rows)))


@query("select o_orderkey as project_id, row_number() over (order by case when o_custkey % 5 = 0 then 1 else 0 end desc, o_orderdate desc, o_orderkey)::int as rank from orders where contains(lower(o_orderstatus || '-' || o_custkey), 'o-1') and o_custkey % 3 <> 0")
def p09_project_search(spark, d):
    o = table(spark, d, "orders")
    p = o.select(F.col("o_orderkey").alias("project_id"), F.concat_ws("-", "o_orderstatus", "o_custkey").alias("title"), (F.col("o_custkey") % 3).cast("string").alias("status"), F.when(F.col("o_custkey") % 5 == 0, 1).otherwise(0).alias("pinned"), F.col("o_orderdate").alias("created_at"))
    return s.searched(p, "O-1", ["1", "2"])


@query("select p_partkey % 20 as run_id, lower(p_name) as path_key, count(*) as n from part group by 1, 2")
def u06_distinct_paths(spark, d):
    return s.distinct_paths(table(spark, d, "part").select((F.col("p_partkey") % 20).alias("run_id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("path")))


@query(f"with {RUN}, w as (select run_id, case when (start_ms // 1000) % 9 <> 0 then start_ms end as a from wd) select run_id, count(*) as words, count(a) as aligned, round(count(a) / count(*), 4) as share from w group by 1")
def a30_alignment(spark, d):
    w = Run(spark, d).words
    return s.alignment(w.withColumn("start_ms", F.when(F.floor(F.col("start_ms") / 1000) % 9 != 0, F.col("start_ms"))))


@query(f"""with {RUN}, pay as (select run_id, min(first) as p from pro where status in ('fulfilled', 'partial') group by 1) select talk.run_id, seg_idx as chapter, round((end_ms - start_ms) / 1000, 1) as seconds, row_number() over (partition by talk.run_id order by end_ms - start_ms desc, start_ms) = 1 as longest,
 coalesce(p >= start_ms and p < end_ms, false) as pays from talk left join pay using (run_id)""")  # fmt: skip
def a33_sections(spark, d):
    r = Run(spark, d)
    pay = r.promises.where("status in ('fulfilled', 'partial')").groupBy("run_id").agg(F.min("first_fulfil_ms").alias("payoff_ms"))
    x = s.sections(r.segments.select("run_id", F.col("seg_idx").alias("chapter"), "start_ms", "end_ms"), pay)
    return x.select("run_id", "chapter", "seconds", "longest", "pays")


@query(f"""with {ISS}, r as (select run_id as query_id, row_number() over (partition by run_id order by value desc, issue_id) as rank, start_ms, end_ms from iss), g as (select run_id as query_id, start_ms - 5000 as g0, end_ms + 15000 as g1 from iss where event_type = 'signup'),
 b as (select query_id, min(rank) as best from r join g using (query_id) where start_ms < g1 and end_ms > g0 group by 1) select distinct g.query_id, coalesce(best <= 1, false) as hit_at_1, coalesce(best <= 3, false) as hit_at_3 from g left join b using (query_id)""")  # fmt: skip
def a29_hits(spark, d):
    i = issues(spark, d).withColumn("query_id", F.col("run_id"))
    r = i.withColumn("rank", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("value"), "issue_id"))).select("query_id", "rank", "start_ms", "end_ms")
    return s.hits_at(r, i.where("event_type = 'signup'").select("query_id", (F.col("start_ms") - 5000).alias("start_ms"), (F.col("end_ms") + 15_000).alias("end_ms")))


@query("select run_id, t, feature, part, rank from (select user_id % 5 as run_id, event_id % 40 as t, event_type as feature, max(value) as part, row_number() over (partition by user_id % 5, event_id % 40 order by max(value) desc, event_type) as rank from events group by 1, 2, 3) where rank <= 2")
def t11_top_causes(spark, d):
    e = table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("run_id"), (F.col("event_id") % 40).alias("t"), F.col("event_type").alias("feature")).agg(F.max("value").alias("part"))
    return s.top_causes(e)


@query("select event_type, count(*) as n, count(distinct user_id) as runs from events group by 1")
def a35_type_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("runs"))


@query("select o_custkey as project_id, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) as active_run, case when bool_or(o_orderstatus = 'F') then 'ready' else 'partial' end as state from orders group by 1")
def s19_active_runs(spark, d):
    o = table(spark, d, "orders")
    return active_runs(o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "analysis").otherwise("media").alias("package_kind")))


@query("select distinct l_orderkey as run_id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')")
def s20_orphans(spark, d):
    return orphans(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id")).distinct(), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id")))
