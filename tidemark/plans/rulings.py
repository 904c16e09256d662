"""Queries over findings of all rules, the risk they make, and what they explain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import merges, rules, whole
from tidemark.operators import sentences as st
from tidemark.operators.risk import EVIDENCE, SEVERITY
from tidemark.plans import series
from tidemark.plans.inputs import PLAIN, WORDS
from tidemark.plans.queries import CONTENT, RUNS
from tidemark.plans.registry import SQL, query
from tidemark.plans.seconds import END, RUN, Run
from tidemark.plans.talks import CONC, LOAD, QA, quoted

LONGEST = f"list_max(list_transform(regexp_split_to_array({{0}}, '[.!?]+'), lambda q: {WORDS.format('q')}))"
STATIC = """l as (select run_id, greatest(8000.0, 3 * median(end_ms - start_ms))::double as lim from sht where end_ms > start_ms group by 1), m as (select run_id, list_sort(list(motion)) as ms from sht group by 1 having count(*) >= 4),
 q as (select sht.*, lim, ms[round_even(0.25 * (len(ms) - 1), 0)::int + 1] as low from sht join l using (run_id) join m using (run_id)), x as (select *, unnest(range(ceil((start_ms + lim) / 1000)::int, ceil(end_ms / 1000)::int)) as t from q where end_ms - start_ms > lim and motion <= low)
 select run_id, t::int as t, 'long_static_shot' as feature, max(greatest(0.0, least(1.0, 0.5 + 0.5 * (t * 1000 - start_ms - lim) / lim))) as value from x group by 1, 2"""
LONG = f"select run_id, s::int as t, 'long_sentences' as feature, max(v * greatest(0, least(end_ms, (s + 1) * 1000, t) - greatest(start_ms, s * 1000)) / (least((s + 1) * 1000, t) - s * 1000)) as value from (select p.*, t, unnest(range(start_ms // 1000, (end_ms + 999) // 1000)) as s from (select run_id, start_ms, end_ms, greatest(0.0, least(1.0, (n - 12) / 20))::double as v from (select *, {LONGEST.format('text')} as n from talk where regexp_matches(text, '[.!?]')) where n > 12) p join dur using (run_id)) where s * 1000 < t group by 1, 2"
FEATURES = " union all ".join(f"select * from ({SQL[n]})" for n in ("e01_setup", "e02_no_hook", "e04_low_novelty", "e08_pace", "e10_dead_air", "e16_dense_text", "e17_loudness_drop", "e19_flat_low_energy"))


def _shown(df):
    return df.select("run_id", "rule", "start_ms", "end_ms", "severity", "evidence_strength")


def _segments(spark, d):
    return Run(spark, d, spread=True).segments


FF = f"""{RUN}, f as (select run_id, t, feature, value from ({FEATURES} union all select run_id, t, feature, round(value, 6) from ({LONG}) union all select run_id, t, feature, round(value, 6) from (with {STATIC})) where value > 0), k as (select *, t - row_number() over (partition by run_id, feature order by t) as k from f),
 fr as (select k.run_id, feature, min(k.t)::bigint * 1000 as start_ms, least((max(k.t)::bigint + 1) * 1000, any_value(dur.t)) as end_ms, max(value) as strength from k join dur on dur.run_id = k.run_id group by k.run_id, feature, k),
 ab as (select fr.run_id, feature, fr.start_ms, bool_or(regexp_matches({PLAIN.format('text')}, '{ft.ADVANCE}') or regexp_matches({PLAIN.format('text')}, '{quoted(ft.CONCRETE)}')) as marked, max({LONGEST.format('text')}) as longest from fr join talk on talk.run_id = fr.run_id and talk.start_ms < fr.end_ms and talk.end_ms > fr.start_ms where feature in ('low_novelty', 'long_sentences') group by 1, 2, 3),
 ow as (select fr.run_id, feature, fr.start_ms, max(s.end_ms - s.start_ms) as shot_ms from fr join sht s on s.run_id = fr.run_id and s.start_ms <= fr.start_ms and fr.start_ms < s.end_ms where feature = 'long_static_shot' group by 1, 2, 3),
 fa as (select fr.*, (end_ms - start_ms) / 1000 as d, coalesce(marked, false) as marked, coalesce(longest, 0) as longest, shot_ms, hook_ms from fr left join ab using (run_id, feature, start_ms) left join ow using (run_id, feature, start_ms) left join stc using (run_id)),
 ff as (select run_id, case feature when 'setup_before_substance' then 'long_preamble' when 'no_hook_yet' then 'no_hook_identified' else feature end as rule, start_ms, end_ms,
  case feature when 'setup_before_substance' then case when d <= 30 then 'low' when d <= 60 then 'medium' else 'high' end when 'no_hook_yet' then case when hook_ms is null then 'medium' else 'low' end when 'low_novelty' then case when not marked and strength >= 0.5 and d >= 20 then 'medium' else 'low' end
   when 'long_sentences' then case when longest <= 40 then 'low' when longest <= 50 then 'medium' else 'high' end when 'slow_pace' then case when strength >= 0.6 then 'medium' else 'low' end when 'fast_pace' then case when strength >= 0.6 then 'medium' else 'low' end
   when 'dead_air' then case when d >= 6 then 'high' when d >= 3 then 'medium' else 'low' end when 'flat_low_energy' then 'low' when 'long_static_shot' then case when coalesce(shot_ms / 1000, d) >= 20 then 'medium' else 'low' end else case when d >= 5 then 'medium' else 'low' end end as severity,
  case when feature in ('dead_air', 'loudness_drop', 'long_static_shot') or (feature = 'long_sentences' and longest > 40) then 'supported' else 'provisional' end as evidence_strength from fa where feature <> 'no_hook_yet' or end_ms - start_ms >= 5000)"""
SF = f"""{RUN}, pay as (select stc.run_id, coalesce(p, substance) as pay from stc left join (select run_id, min(first) as p from pro where status in ('fulfilled', 'partial') group by 1) using (run_id)),
 s1 as (select spn.*, t, pay, {END} as fin, kind = 'cta' and coalesce(start_ms < pay, false) as early from spn join dur using (run_id) left join pay using (run_id)), s2 as (select *, kind in ('cta', 'sponsor') and not fin and not early as mid, t - start_ms as len from s1),
 rc as (select spn.run_id, spn.start_ms, spn.end_ms, string_agg(text, ' ' order by talk.start_ms, talk.seg_idx) as text from spn join talk on talk.run_id = spn.run_id and talk.start_ms < spn.end_ms and talk.end_ms > spn.start_ms where kind = 'recap' group by 1, 2, 3),
 hw as (select run_id, 0 as kind, unnest({CONTENT.format('text')}) as item, end_ms from talk union all select run_id, 1, unnest({RUNS.format('text')}), end_ms from talk), h as (select run_id, kind, item, min(end_ms) as heard from hw group by 1, 2, 3),
 nd as (select run_id, start_ms, end_ms, 0 as kind, unnest({CONTENT.format('text')}) as item from rc union all select run_id, start_ms, end_ms, 1, unnest({RUNS.format('text')}) from rc),
 ru as (select nd.run_id, start_ms, end_ms, coalesce(avg(coalesce(heard <= start_ms, false)::int) filter (nd.kind = 1), 0.0) as reuse, coalesce(avg(1 - coalesce(heard <= start_ms, false)::int) filter (nd.kind = 0), 1.0) as novelty from nd left join h on h.run_id = nd.run_id and h.kind = nd.kind and h.item = nd.item group by 1, 2, 3),
 sf as (select run_id, 'delayed_title_payoff' as rule, least(15000, first) as start_ms, first as end_ms, case when first > 90000 and first / t > 0.35 then 'high' else 'medium' end as severity, 'provisional' as evidence_strength from pro join dur using (run_id) where status in ('fulfilled', 'partial') and first > 45000 and first / t > 0.2
  union all select run_id, case when early then 'cta_before_payoff' else 'mid_video_interruption' end, start_ms, end_ms, case when early or kind = 'sponsor' then 'medium' else 'low' end, 'provisional' from s2 where early or mid
  union all select run_id, 'extended_outro', start_ms, t, case when len > 60000 then 'high' when len > 30000 or len > 0.12 * t then 'medium' else 'low' end, 'provisional' from s2 where (kind = 'outro' or (kind in ('cta', 'recap') and fin)) and not early and not mid and len > greatest(20000.0, 0.08 * t)
  union all select run_id, 'redundant_recap', start_ms, end_ms, case when end_ms - start_ms > 30000 then 'medium' else 'low' end, 'supported' from ru where reuse >= 0.5 and novelty < 0.25
  union all select run_id, 'topic_drift', start_ms, end_ms, 'medium', 'provisional' from spn where kind = 'tangent_candidate' and not exists (select 1 from talk where talk.run_id = spn.run_id and talk.start_ms < spn.end_ms + 15000 and talk.end_ms > spn.start_ms and regexp_matches({PLAIN.format('text')}, '{ft.CONNECT_BACK}')))"""
RISK = """bn as (select run_id, t, unnest(range((t + 4999) // 5000)) as bin from dur), bins as (select run_id, bin, bin * 5000 as b0, least(t, (bin + 1) * 5000) as b1 from bn),
 gs as (select * from (values """ + ", ".join(f"('{r[0]}', '{r[2]}', {rules.GROUP_SHARES[r[2]]})" for r in rules.CATALOGUE) + """) g(rule, cause_group, share)),
 xb as (select run_id, rule, start_ms, end_ms, rule || ':' || start_ms || ':' || end_ms as fid, cause_group, share::double as share, case severity when 'high' then 1.0 when 'medium' then 2.0 / 3 else 1.0 / 3 end::double * case evidence_strength when 'supported' then 1.0 else 0.5 end::double as w, unnest(range(start_ms // 5000, (end_ms + 4999) // 5000)) as bin from af join gs using (rule) where end_ms > start_ms),
 xp as (select xb.*, w * greatest(0, least(end_ms, b1) - greatest(start_ms, b0)) / (b1 - b0) as part from xb join bins using (run_id, bin)), xg as (select run_id, bin, cause_group, max(share * part) as weighed from xp where part > 0 group by 1, 2, 3),
 xt as (select run_id, bin, min({'w': -round(share * part, 9), 'a': start_ms, 'f': fid}) as top, list_sort(list_distinct(list(fid))) as ids from xp where part > 0 group by 1, 2), xs as (select run_id, bin, sum(weighed) as risk from xg group by 1, 2),
 tr as (select bins.run_id, bins.bin, b0 as start_ms, b1 as end_ms, round(round_even(100 * coalesce(risk, 0.0), 3), 2) as risk, top.f as top_finding, coalesce(len(ids), 0)::int as n_findings from bins left join xt using (run_id, bin) left join xs using (run_id, bin))"""


@query(f"with {FF} select * from ff")
def r01_feature_findings(spark, d):
    return whole.per_run(_segments(spark, d), series.FEATURES, series.ROW, lambda s: series.as_columns(series.feature_findings(s)))


@query(f"with {SF} select * from sf")
def r03_structure_findings(spark, d):
    return whole.per_run(_segments(spark, d), series.STRUCTURE, series.ROW, lambda s: series.as_columns(series.structure_findings(s)))


@query(f"""with {RUN}, q as (select pro.run_id, promise, string_agg(text, ' ' order by talk.start_ms, text) as payoff_quote from pro join talk on talk.run_id = pro.run_id and talk.start_ms <= first and first < talk.end_ms group by 1, 2)
 select run_id, promise, status, coalesce(first, -1) as first_fulfil_ms, coalesce(round_even(first / t, 4), -1.0) as relative, coalesce(payoff_quote, '') as payoff_quote from pro join dur using (run_id) left join q using (run_id, promise)""")  # fmt: skip
def r26_promise_ledger(spark, d):
    r = Run(spark, d)
    return rules.promise_ledger(r.runs, r.promises, r.segments).fillna(-1, ["first_fulfil_ms"]).fillna(-1.0, ["relative"])


@query(rf"""with recursive {QA}, {CONC[CONC.index('w0 as'):]}, {LOAD[LOAD.index('e as'):]}, dur as (select run_id, max(end_ms) as t from talk group by 1), sub as (select * from qk where kind <> 'framing' and not rhetorical),
 cw as (select run_id, start_ms // 60000 as win, count(*) filter ({WORDS.format('text')} > 30) as long, max(markers) as markers, bool_and(punctuated) as punctuated from conc group by 1, 2), dn as (select load.*, win - row_number() over (partition by run_id order by win) as k from load join cw using (run_id, win) where load = 'high' and (long > 0 or mean_words >= 22) and cw.markers = 0 and punctuated),
 rq as (select a.run_id, a.start_ms, a.end_ms, list_sort(list({{'s': b.start_ms, 'q': b.sent}}) filter (b.kind <> 'immediate' and b.start_ms >= a.start_ms - 60000)) as recent, max(coalesce(b.answer_ms, 4000000000000000000)) filter (b.start_ms < a.start_ms - 60000) as open_until from sub a join sub b on b.run_id = a.run_id and b.start_ms <= a.start_ms group by a.run_id, a.sent, a.start_ms, a.end_ms),
 r2 as (select *, recent[1].s as a from rq where len(recent) >= 2 and open_until > start_ms), r3 as (select *, case when lag(end_ms) over (partition by run_id order by start_ms) >= a then 0 else 1 end as new from r2), r4 as (select *, sum(new) over (partition by run_id order by start_ms) as k from r3),
 x as (select run_id, 'dense_new_terms' as rule, min(start_ms) as start_ms, max(end_ms) as end_ms, 'medium' as severity from dn group by run_id, k
  union all select run_id, case when answer is null then 'question_without_callback' else 'delayed_question_callback' end, start_ms, end_ms, case when answer is null then 'medium' else 'low' end from sub where answer is null or gap_ms > 60000
  union all select run_id, 'stacked_open_questions', min(a), max(end_ms), case when len(list_distinct(flatten(list(recent)))) >= 3 then 'medium' else 'low' end from r4 group by run_id, k)
 select run_id, rule, start_ms, least(end_ms, t) as end_ms, severity, 'provisional' as evidence_strength from x join dur using (run_id)""")  # fmt: skip
def r13_relation_findings(spark, d):
    r = Run(spark, d, stored=True)
    out = _shown(rules.relation_findings(r.runs, r.segments, r.promises, r.keep("sentences", lambda: st.sentences(r.segments))))
    # Terms and abstract stretches have queries of their own; the texts have neither.
    return out.where("rule not in ('unconfirmed_title_promise', 'extended_abstraction', 'term_used_before_explanation')")


@query(f"with {RUN} select run_id, 'unconfirmed_title_promise' as rule, 0 as start_ms, least(30000, t) as end_ms, case status when 'unaddressed' then 'medium' else 'low' end as severity, 'provisional' as evidence_strength from pro join dur using (run_id) where status in ('unaddressed', 'uncertain')")
def r04_unconfirmed_promises(spark, d):
    r = Run(spark, d)
    return _shown(rules.relation_findings(r.runs, r.segments, r.promises)).where("rule = 'unconfirmed_title_promise'")


GROUPS, FEATURE = {r[0]: r[2] for r in rules.CATALOGUE}, {r[0]: r[5] for r in rules.CATALOGUE}
BOTH = tuple(dict.fromkeys((*series.FEATURES, *series.STRUCTURE)))


def _risk(spark, d):
    """run_id, bin, start_ms, end_ms, risk, top_finding, n_findings."""
    make = lambda s: whole.risk_bins(s.T, series.both(s), GROUPS, rules.GROUP_SHARES, SEVERITY, EVIDENCE)
    x = whole.per_run(_segments(spark, d), BOTH, "bin bigint, start_ms bigint, end_ms bigint, risk double, top_finding string, n_findings int", make)
    return x.withColumn("risk", F.round(F.bround(100 * F.col("risk"), 3), 2))


AF = f"{FF}, {SF[len(RUN) + 2:]}, af as (select * from ff union all select * from sf), {RISK}"


@query(f"with {AF} select * from tr")
def a04_text_risk(spark, d):
    return _risk(spark, d)


@query(f"with {AF} select sec.run_id, sec.t::int as t, risk from sec join tr on tr.run_id = sec.run_id and tr.bin = sec.t // 5")
def a05_risk_per_second(spark, d):
    last = F.ceil(F.col("end_ms") / 1000).cast("int") - 1
    return _risk(spark, d).select("run_id", F.explode(F.sequence((F.col("start_ms") / 1000).cast("int"), last)).alias("t"), "risk")


@query(f"""with {AF}, m as (select run_id, k * 20 as s, least(k * 20 + 10, t // 1000) as e, (['dead_air', 'slow_pace', 'outro', 'payoff_pending'])[(run_id + k) % 4 + 1] as mf from (select run_id, t, unnest(range(1, t // 20000 + 1)) as k from dur) where least(k * 20 + 10, t // 1000) > k * 20), g as (select *, rule || ':' || start_ms || ':' || end_ms as fid from af),
 fr2 as (select g.*, row_number() over (partition by run_id order by start_ms, fid) as rank from g), mg as (select *, case mf when 'dead_air' then 'delivery' when 'slow_pace' then 'delivery' when 'outro' then 'interruptions' else 'opening_promise' end as grp from m),
 cat as (select * from (values {", ".join(f"('{r[0]}', '{r[2]}', '{r[5] or ''}')" for r in rules.CATALOGUE)}) c(rule, cause_group, feature)),
 j as (select mg.run_id, s * 1000 as start_ms, e * 1000 as end_ms, fid, rank, case when feature = mf then 0 when cause_group = grp then 1 end as lev from mg left join (select fr2.*, cause_group, feature from fr2 join cat using (rule)) f on f.run_id = mg.run_id and f.start_ms < e * 1000 and f.end_ms > s * 1000)
 select run_id, start_ms, end_ms, coalesce(string_agg(fid, ',' order by rank), '') as finding_ids, arg_min(fid, lev * 1000000 + rank) filter (lev is not null) as best_finding from j group by 1, 2, 3""")  # fmt: skip
def j16_attached_findings(spark, d):
    make = lambda s: whole.attach(series.moments(s), series.both(s), GROUPS, FEATURE)
    x = whole.per_run(_segments(spark, d), BOTH, "start_ms bigint, end_ms bigint, finding_ids array<string>, best_finding string", make)
    return x.withColumn("finding_ids", F.array_join("finding_ids", ","))


@query()
def r27_full_analysis(spark, d):
    """All findings of all rules, ranked; duplicates point to what they repeat."""
    r = Run(spark, d, stored=True)
    related = rules.relation_findings(r.runs, r.segments, r.keep("promises", lambda: r.promises), r.keep("sentences", lambda: st.sentences(r.segments)))
    told = whole.per_run(r.segments, series.EVERY, series.ROW, lambda s: series.as_columns(series.feature_findings(s, every=True) + series.structure_findings(s)))
    every = r.keep("every", lambda: merges.strongest(rules.described(told).unionByName(related)))
    ranked = merges.rank_findings(every.select("run_id", "finding_id", "cause_group", "severity", "evidence_strength", "safe_edit", "start_ms", "end_ms"), rules.first_payoff(r.promises, r.structure))
    return every.select("run_id", "finding_id", "rule", "severity", "start_ms", "end_ms").join(ranked, ["run_id", "finding_id"])


@query(f"with recursive {CONC} select run_id, count(*) as sentences, coalesce(sum(markers), 0)::bigint as markers from conc group by 1")
def f07_markers(spark, d):
    r = Run(spark, d)
    return st.concreteness(st.sentences(r.segments)).groupBy("run_id").agg(F.count("*").alias("sentences"), F.sum("markers").cast("bigint").alias("markers"))
