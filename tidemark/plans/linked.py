"""Queries over links between records and over scores under other assumptions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import findings, links, scoring, whatif
from tidemark.plans.inputs import ISS, issues, runs, spans, table, turns
from tidemark.plans.packages import _evidence
from tidemark.plans.queries import CURVE, RISK, _bins, _features
from tidemark.plans.registry import SQL, query
from tidemark.plans.seconds import RUN, Run

_PLAIN = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"


@query("select conv_id as run_id, turn // 3 as part, (turn % 3)::int as place, turn as seg_idx, role from conversations")
def j01_members(spark, d):
    t = turns(spark, d)
    g = t.groupBy("run_id", F.floor(F.col("seg_idx") / 3).alias("part")).agg(F.array_sort(F.collect_list("seg_idx")).alias("ids"))
    return links.members(g, t.select("run_id", "seg_idx", "role"), "ids", "seg_idx").select("run_id", "part", "place", "seg_idx", "role")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("run_id"), F.col("vec_id").alias("place"), "embedding")


@query("""with v as (select label as run_id, vec_id as place, embedding::double[] as e from embeddings), p as (select x.run_id, x.place, y.place as earlier, list_cosine_similarity(x.e, y.e) as c from v x join v y on x.run_id = y.run_id and y.place < x.place)
 select run_id, place, earlier, round(c, 4) as cosine from (select *, row_number() over (partition by run_id, place order by round(c, 10) desc, earlier) as k from p) where k = 1""")  # fmt: skip
def j10_best_by_cosine(spark, d):
    return links.best_by_cosine(_vectors(spark, d))


@query("""with v as (select label as run_id, vec_id as place, embedding::double[] as e from embeddings) select v.run_id, q.place as query_id, v.place, round(list_cosine_similarity(v.e, q.e), 6) as cosine from v join v q on q.run_id = v.run_id where q.place % 100 = 0""")
def j11_relevance(spark, d):
    v = _vectors(spark, d)
    return links.relevance(v, v.where("place % 100 = 0").select("run_id", F.col("place").alias("query_id"), F.col("embedding").alias("vector")))


KEPT = f"""{ISS}, k as (select run_id, issue_id as id from iss where issue_id % 4 = 1), a as (select run_id, issue_id, unnest([issue_id, issue_id + 1, issue_id + 2]) as id from iss), ki as (select a.run_id, issue_id, string_agg(a.id, ',' order by a.id) as ids from a join k using (run_id, id) group by 1, 2)"""


def _survivors(spark, d):
    i = issues(spark, d).select("run_id", "issue_id", F.array("issue_id", F.col("issue_id") + 1, F.col("issue_id") + 2).alias("evidence_ids"))
    s = i.where("issue_id % 3 = 0").select("run_id", F.col("issue_id").alias("suggestion_id"), F.array("issue_id", F.col("issue_id") + 1).alias("issue_ids"))
    return links.survivors(i, s, i.where("issue_id % 4 = 1").select("run_id", F.col("issue_id").alias("evidence_id")))


@query(f"with {KEPT} select run_id, issue_id, ids as evidence_ids from ki")
def j12_surviving_evidence(spark, d):
    return _survivors(spark, d)[0].withColumn("evidence_ids", F.array_join(F.col("evidence_ids").cast("array<string>"), ","))


@query(f"with {KEPT} select i.run_id, i.issue_id as suggestion_id from iss i where issue_id % 3 = 0 and (select count(*) from ki where ki.run_id = i.run_id and ki.issue_id in (i.issue_id, i.issue_id + 1)) = 2")
def j13_surviving_suggestions(spark, d):
    return _survivors(spark, d)[1].select("run_id", "suggestion_id")


@query(f"""with {ISS}, e as (select run_id, issue_id as evidence_id, (['transcript', 'frame', 'observation', 'signal', 'ocr'])[issue_id % 5 + 1] as kind, issue_id - issue_id % 2 as ref_id from iss)
 select e.run_id, evidence_id, kind, case kind when 'transcript' then t.event_type when 'signal' then t.severity end as target from e left join iss t on t.run_id = e.run_id and t.issue_id = e.ref_id""")  # fmt: skip
def j14_evidence_targets(spark, d):
    i = issues(spark, d)
    return links.targets(_evidence(i), {"transcript": (i, "issue_id", F.col("event_type")), "signal": (i, "issue_id", F.col("severity"))}).select("run_id", "evidence_id", "kind", "target")


MOMENTS = f"""{ISS}, r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1), m as (select run_id, k * 25000 as start_ms, k * 25000 + 10000 as end_ms from (select run_id, unnest(range(t // 25000)) as k from r))"""


def _moments(i):
    return runs(i).where("duration_ms >= 25000").select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("duration_ms") / 25_000) - 1)).alias("k")).select("run_id", (F.col("k") * 25_000).alias("start_ms"), (F.col("k") * 25_000 + 10_000).alias("end_ms"))


@query(f"with {MOMENTS} select m.run_id, m.start_ms, m.end_ms, coalesce(string_agg(issue_id, ',' order by i.start_ms, issue_id), '') as issues from m left join iss i on i.run_id = m.run_id and i.start_ms < m.end_ms and i.end_ms > m.start_ms group by 1, 2, 3")
def j17_moment_issues(spark, d):
    i = issues(spark, d)
    return links.overlapping_ids(_moments(i), i, "issue_id", "issues").withColumn("issues", F.array_join(F.col("issues").cast("array<string>"), ","))


@query(f"with {MOMENTS} select run_id, start_ms, end_ms, case when start_ms % 50000 = 0 then run_id || '-' || start_ms end as headline from m")
def j18_rekeyed_moments(spark, d):
    m = _moments(issues(spark, d))
    return links.rekeyed(m, m.where("start_ms % 50000 = 0").withColumn("headline", F.concat_ws("-", "run_id", "start_ms")), ["headline"])


_CUED = "case when turn % 4 = 1 then text || ' Now watch this again' else text end"


@query(f"""with t as (select conv_id as run_id, turn as passage, {_CUED} as text, lag({_CUED}) over (partition by conv_id order by turn) as told from conversations)
 select run_id, passage, case when regexp_matches(regexp_replace(lower(coalesce(right(told, 300), '') || ' ' || left(text, 400)), '[^\\w\\s'']', ' ', 'g'), 'watch (this|it|that) again') then 'needs_review' else 'shorten' end as choice from t""")  # fmt: skip
def j21_replay_guard(spark, d):
    t = turns(spark, d).select("run_id", F.col("seg_idx").alias("passage"), F.when(F.col("seg_idx") % 4 == 1, F.concat("text", F.lit(" Now watch this again"))).otherwise(F.col("text")).alias("text"))
    return links.replay_guard(t, F.lit("shorten")).select("run_id", "passage", "choice")


@query()
def j22_located_quotes(spark, d):
    """A quote of each third turn, a word of it left out, named as said a turn later."""
    t = turns(spark, d).select("run_id", F.col("seg_idx").alias("passage"), "text")
    words = F.split(F.trim("text"), r"\s+")
    q = t.where("passage % 3 = 0").select("run_id", F.col("passage").alias("quote_id"), (F.col("passage") + F.when(F.col("passage") % 2 == 0, 1).otherwise(90)).alias("passage"), F.concat_ws(" ", F.slice(words, 2, 9), F.slice(words, 12, 4)).alias("quote"))
    return links.located_quotes(q, t)


QUOTES = "w0 as (select conv_id as run_id, turn as seg_idx, text, lead(text) over (partition by conv_id order by turn) as later from conversations), q as (select run_id, seg_idx as quote_id, case when seg_idx % 2 = 0 then text[8:70] else right(text, 40) || ' ' || left(coalesce(later, ''), 30) end as quote from w0)"


def _quotes(spark, d):
    t = turns(spark, d).select("run_id", "seg_idx", "text")
    later = F.lead("text").over(Window.partitionBy("run_id").orderBy("seg_idx"))
    q = t.withColumn("later", F.coalesce(later, F.lit(""))).select("run_id", F.col("seg_idx").alias("quote_id"), F.when(F.col("seg_idx") % 2 == 0, F.substring("text", 8, 63)).otherwise(F.concat(F.right("text", F.lit(40)), F.lit(" "), F.left("later", F.lit(30)))).alias("quote"))
    return q, t


@query(f"with {QUOTES} select q.run_id, quote_id, coalesce(min(s.seg_idx), -1) as seg_idx from q left join w0 s on s.run_id = q.run_id and {_PLAIN.format('quote')} <> '' and contains({_PLAIN.format('s.text')}, {_PLAIN.format('quote')}) group by 1, 2")
def j24_exact_quotes(spark, d):
    return links.exact_quotes(*_quotes(spark, d)).select("run_id", "quote_id", F.coalesce("seg_idx", F.lit(-1)).alias("seg_idx"))


@query(f"""with {QUOTES}, x as (select q.run_id, quote_id, min(s.seg_idx) filter (contains({_PLAIN.format('s.text')}, {_PLAIN.format('quote')})) as one, min(s.seg_idx) filter (contains({_PLAIN.format("concat_ws(' ', s.text, s.later)")}, {_PLAIN.format('quote')})) as two from q join w0 s on s.run_id = q.run_id where {_PLAIN.format('quote')} <> '' group by 1, 2)
 select q.run_id, q.quote_id, coalesce(one, two, -1) as seg_idx, coalesce(one is null and two is not null, false) as across from q left join x using (run_id, quote_id)""")  # fmt: skip
def j23_spoken_quotes(spark, d):
    return links.spoken_quotes(*_quotes(spark, d)).select("run_id", "quote_id", F.coalesce("seg_idx", F.lit(-1)).alias("seg_idx"), "across")


@query(f"""with {RUN}, n0 as (select *, ceil(t / 20000)::bigint as n0 from dur), n1 as (select run_id, t, case when n0 > 1 and t - (n0 - 1) * 20000 < 2000 then n0 - 1 else n0 end as n from n0), c0 as (select *, unnest(range(n)) as clip from n1), cl as (select run_id, clip, clip * 20000 as start_ms, case when clip = n - 1 then t else (clip + 1) * 20000 end as end_ms from c0),
 s as (select cl.*, text, talk.start_ms as r, greatest(0, least(cl.end_ms, talk.end_ms) - greatest(cl.start_ms, talk.start_ms)) as ms, sum(length(text) + 1) over (partition by cl.run_id, clip order by talk.start_ms) as upto from cl join talk on talk.run_id = cl.run_id and talk.start_ms < cl.end_ms and talk.end_ms > cl.start_ms),
 sd as (select run_id, clip, coalesce(string_agg(text, ' ' order by r) filter (upto <= 2500), '') as transcript, sum(ms) / any_value(end_ms - start_ms) as share from s group by 1, 2),
 o as (select cl.run_id, clip, text, row_number() over (partition by cl.run_id, clip order by confidence * length(text) desc, trk.start_ms, text) as k from cl join trk on trk.run_id = cl.run_id and trk.start_ms < cl.end_ms and trk.end_ms > cl.start_ms), ot as (select run_id, clip, string_agg(text, '|' order by k) as texts from o where k <= 20 group by 1, 2)
 select cl.run_id, cl.clip, coalesce(transcript, '') as transcript, coalesce(round(least(1.0, share), 4), 0.0) as speech_share, coalesce(texts, '') as texts from cl left join sd using (run_id, clip) left join ot using (run_id, clip)""")  # fmt: skip
def j26_clip_context(spark, d):
    r = Run(spark, d)
    x = links.clip_context(findings.clips(r.runs).select("run_id", "clip", "start_ms", "end_ms"), r.segments, r.tracks)
    return x.select("run_id", "clip", "transcript", "speech_share", F.array_join("texts", "|").alias("texts"))


@query(f"""with {RUN}, f as (select sht.run_id, shot, string_agg(distinct spn.seg_idx::varchar, ',' order by spn.seg_idx::varchar) as found from sht join spn on spn.run_id = sht.run_id and spn.start_ms < sht.end_ms and spn.end_ms > sht.start_ms group by 1, 2),
 s as (select sht.run_id, shot, sum(greatest(0, least(sht.end_ms, sp.end_ms) - greatest(sht.start_ms, sp.start_ms)))::bigint as ms from sht join sp on sp.run_id = sht.run_id and sp.start_ms < sht.end_ms and sp.end_ms > sht.start_ms group by 1, 2)
 select sht.run_id, sht.shot, coalesce(found, '') as findings, coalesce(ms, 0) as speech_ms from sht left join f using (run_id, shot) left join s using (run_id, shot)""")  # fmt: skip
def j28_over_shots(spark, d):
    r = Run(spark, d)
    x = links.over_shots(r.shots, r.spans.withColumn("finding_id", F.col("seg_idx").cast("string")), r.speech)
    return x.select("run_id", "shot", F.coalesce(F.array_join("findings", ","), F.lit("")).alias("findings"), "speech_ms")


OTHER = scoring.Assumptions(at_30s=0.7, at_end=0.3)
_WATCHED = "select '{0}' as assumptions, run_id, t::int as t, round(s1, 6) as retention, round(sum(s0 * (1 - exp(-h)) / h) over (partition by run_id order by t rows unbounded preceding), 4) as watched_s from x5"


@query(f"select * from (with {CURVE} {_WATCHED.format('usual')}) union all select * from (with {CURVE.replace('-ln(0.8)', '-ln(0.7)').replace('-ln(0.45)', '-ln(0.3)')} {_WATCHED.format('harsh')})")
def m09_recomputed(spark, d):
    x = whatif.recomputed(*_features(spark, d), {"usual": scoring.Assumptions(), "harsh": OTHER})
    return x.select("assumptions", "run_id", "t", "retention", "watched_s")


@query(f"""with c as ({SQL["m04_retention_curve"]}), p as (select run_id, t, retention, coalesce(lag(retention) over (partition by run_id order by t), 1.0) as prev from c)
 select run_id, t, round_even(sum(case when retention > 0 and prev > retention then (prev - retention) / ln(prev / retention) else prev end) over (partition by run_id order by t rows unbounded preceding), 4) as watched_s from p""")  # fmt: skip
def m10_derived_watch(spark, d):
    c = scoring.curve(*_features(spark, d)).withColumn("duration_s", F.lit(1.0))
    return whatif.derived_watch(c.select("run_id", "t", "retention", "duration_s")).select("run_id", "t", "watched_s")


def bounds_sql(at_30s: float = 0.8, at_end: float = 0.45, kappa: float = 0.35) -> str:
    side = lambda r, n: f"""{n}h as (select *, (end_ms - start_ms) / 1000.0::double as dt, (case when start_ms < 30000 then -ln({at_30s}) / 30 else -ln({at_end} / {at_30s}) / (tt - 30) end + {kappa} / tt * {r}) as h from bx where tt >= 60),
 {n}s as (select *, exp(-sum(h * dt) over (partition by run_id order by bin rows unbounded preceding)) as s1 from {n}h), {n}2 as (select *, coalesce(lag(s1) over (partition by run_id order by bin), 1.0) as s0 from {n}s), {n} as (select run_id, bin, start_ms, end_ms, point, s0, s1, sum(s0 * (1 - exp(-h * dt)) / h) over (partition by run_id order by bin rows unbounded preceding) as watched from {n}2)"""  # noqa: E731
    return f"""bx as (select *, max(end_ms) over (partition by run_id) / 1000.0::double as tt from rb), {side('upper', 'lo')}, {side('lower', 'hi')},
 bd as (select lo.run_id, lo.bin, lo.start_ms, lo.end_ms, round(lo.s1, 6) as lower_end, round(hi.s1, 6) as upper_end, case when min((lo.point is not null)::int) over (partition by lo.run_id) = 1 then round(hi.s1, 6) end as central_end, round(lo.watched, 4) as lower_watched, round(hi.watched, 4) as upper_watched, round(lo.s0, 6) as l0, round(hi.s0, 6) as h0 from lo join hi using (run_id, bin)),
 sm as (select run_id, end_ms / 1000 as seconds, round(lower_watched, 2) as least_watched_s, round(upper_watched, 2) as most_watched_s, round(round(100 * lower_watched / (end_ms / 1000), 2), 1) as least_viewed_pct, round(100 * upper_end, 2) as most_end_pct, central_end is not null as complete from (select *, row_number() over (partition by run_id order by bin desc) as k from bd) where k = 1)"""


@query(f"""with {RISK}, {bounds_sql()} select run_id, bin, lower_end, upper_end, central_end is not null as complete, round(least(1 - lower_end / l0, 1 - upper_end / h0), 5) as least_conditional, round(greatest(l0 - lower_end, h0 - upper_end), 5) as most_drop from bd""")
def m12_bounds(spark, d):
    x = whatif.bounds(_bins(spark, d))
    return x.select("run_id", "bin", "lower_end", "upper_end", F.col("central_end").isNotNull().alias("complete"), "least_conditional", "most_drop")


@query(f"with {RISK}, {bounds_sql(0.7, 0.3, 0.5)} select * from sm")
def m15_user_scenario(spark, d):
    x = whatif.scenarios(_bins(spark, d), {"user": {"at_30s": 0.7, "at_end": 0.3, "kappa": 0.5}})
    return x.select("run_id", "seconds", "least_watched_s", "most_watched_s", whatif.half_up(F.col("least_viewed_pct"), 1).alias("least_viewed_pct"), "most_end_pct", "complete")


@query()
def m14_both_sides(spark, d):
    """Errors are cut out; sign-ups count as resolved after the cut."""
    i = issues(spark, d)
    return whatif.compare_cuts(runs(i), i, spans(i), i.where("event_type = 'error'").select("run_id", "start_ms", "end_ms"), i.where("event_type = 'signup'"))


@query(f"""with {ISS}, r as (select run_id, (max(place) + 1) * 10000 as t, run_id % 2 = 0 as nar, run_id % 3 <> 0 as aud, run_id % 5 <> 0 as wor, run_id % 7 <> 0 as sho, run_id % 4 = 0 as scr from iss group by 1), h as (select run_id, start_ms, end_ms from iss where event_type = 'error'), v as (select run_id, start_ms, end_ms from iss where event_type = 'view'),
 e as (select h.run_id, start_ms, least(end_ms, t) as end_ms, max(end_ms) over (partition by h.run_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach, t from h join r using (run_id) where nar), gp as (select run_id, coalesce(reach, 0) as a, start_ms as b from e union all select r.run_id, coalesce(max(h.end_ms), 0), any_value(r.t) from r left join h using (run_id) where nar group by 1),
 raw as (select run_id, 'narrative' as track, a as start_ms, b as end_ms from gp where b > a union all select run_id, 'visual', start_ms, end_ms from v union all select run_id, 'pacing', 0, t from r where aud and wor and sho union all select run_id, 'text', 0, t from r where scr union all select run_id, 'text', start_ms, end_ms from v join r using (run_id) where not scr union all select run_id, 'technical', 0, case when aud then t else t // 2 end from r where sho),
 n as (select *, max(end_ms) over (partition by run_id, track order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from raw), k as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by run_id, track order by start_ms, end_ms rows unbounded preceding) as k from n)
 select run_id, track, min(start_ms) as start_ms, max(end_ms) as end_ms from k group by run_id, track, k""")  # fmt: skip
def m13_track_coverage(spark, d):
    i = issues(spark, d)
    r = runs(i)
    k = F.col("run_id")
    flags = r.select("run_id", (k % 2 == 0).alias("narrative"), (k % 3 != 0).alias("audio"), (k % 5 != 0).alias("words"), (k % 7 != 0).alias("shots"), (k % 4 == 0).alias("screen_text"))
    return whatif.track_coverage(r, flags, i.where("event_type = 'error'").select("run_id", "start_ms", "end_ms"), i.where("event_type = 'view'").select("run_id", "start_ms", "end_ms"))
