"""The operators over the test tables, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import checks, intervals, passes, retrieval, risk, scoring, sequences, vectors, whole
from tidemark.plans import series
from tidemark.plans.inputs import ISS, SEG, WORDS, issues, runs, segments, spans, table, turns, union_sql
from tidemark.plans.registry import query
from tidemark.sources.text import subtitle_lines
from tidemark.streaming import jobs


@query(f"with {SEG} select * from seg")
def s06_timed_segments(spark, d):
    return segments(spark, d)


@query(f"""with {SEG} select run_id, seg_idx, (seg_idx + 1)::varchar || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> '
 || printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || text as cue from seg""")  # fmt: skip
def s14_subtitles(spark, d):
    return subtitle_lines(segments(spark, d))


@query("select p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:40] as slug, 'ev_' || sha256(p_partkey::varchar || '|' || p_name)[1:24] as part_ref from part")
def f17_slugs_and_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", ft.slug(F.col("p_name")).alias("slug"), ft.hashed_id("ev_", F.col("p_partkey").cast("string"), F.col("p_name")).alias("part_ref"))


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


CONTENT = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')), lambda w: length(w) > 2 and not list_contains([" + sql_list(ft.COMMON_WORDS) + "], w))"
TOPIC = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9'']+')), lambda w: length(w) > 2 and not list_contains([" + sql_list(ft.STOP_WORDS) + "], w))"
_PLAIN = "list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+(?:''[\\p{{L}}\\p{{N}}]+)?'), lambda w: not list_contains([" + sql_list(ft.COMMON_WORDS) + "], w))"
RUNS = "list_transform([" + _PLAIN + "], lambda ws: list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))))[1]"


@query(f"select doc_id, len({CONTENT.format('text')})::int as n_content, len({TOPIC.format('text')})::int as n_topic from documents")
def f01_content_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(ft.content_words(F.col("text"))).alias("n_content"), F.size(ft.topic_words(F.col("text"))).alias("n_topic"))


@query(f"with {SEG} select run_id, seg_idx, array_to_string(list_sort({RUNS.format('text')}), '|') as runs from seg")
def f02_content_runs(spark, d):
    return segments(spark, d).select("run_id", "seg_idx", F.array_join(F.array_sort(ft.content_runs(F.col("text"))), "|").alias("runs"))


@query(f"with {ISS}, {union_sql('iss', 'u')} select * from u")
def w01_interval_union(spark, d):
    return intervals.union(issues(spark, d))


@query(f"with {ISS}, {union_sql('iss', 'u', gap=2000)} select * from u")
def w03_gap_tolerant_union(spark, d):
    return intervals.union(issues(spark, d), gap_ms=2000)


@query(f"""with {ISS}, a as (select * from iss where event_type <> 'error'), b as (select * from iss where event_type = 'error'), {union_sql('a', 'ua')}, {union_sql('b', 'ub')},
 e as (select ua.run_id, ua.start_ms, ua.end_ms, greatest(ua.start_ms, ub.start_ms) as h0, least(ua.end_ms, ub.end_ms) as h1 from ua join ub on ua.run_id = ub.run_id and ua.start_ms < ub.end_ms and ub.start_ms < ua.end_ms
   union all select run_id, start_ms, end_ms, end_ms, end_ms from ua),
 x as (select run_id, coalesce(lag(h1) over (partition by run_id, start_ms, end_ms order by h0, h1), start_ms) as a, h0 as b from e) select run_id, a as start_ms, b as end_ms from x where b > a""")  # fmt: skip
def w04_subtract(spark, d):
    i = issues(spark, d)
    return intervals.subtract(i.where("event_type != 'error'"), i.where("event_type = 'error'"), 60_000)


@query(f"""with {ISS}, {union_sql('iss', 'u')}, r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1),
 e as (select u.run_id, start_ms, least(end_ms, t) as end_ms from u join r using (run_id) where start_ms < t union all select run_id, t, t from r),
 x as (select run_id, coalesce(lag(end_ms) over (partition by run_id order by start_ms, end_ms), 0) as a, start_ms as b from e) select run_id, a as start_ms, b as end_ms from x where b > a""")  # fmt: skip
def w05_complement(spark, d):
    i = issues(spark, d)
    return intervals.complement(i, runs(i).select("run_id", F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").alias("end_ms")))


@query(f"with {ISS}, {union_sql('iss', 'u')}, x as (select run_id, lag(end_ms) over (partition by run_id order by start_ms) as a, start_ms as b from u) select run_id, a as start_ms, b as end_ms from x where b - a >= 5000")
def w06_gaps(spark, d):
    return intervals.gaps(issues(spark, d), 5000)


@query(f"""with {ISS}, x as (select run_id, place, place - row_number() over (partition by run_id order by place) as k from iss where value > 10)
 select run_id, min(place) as first, max(place) as last, count(*) as steps from x group by run_id, k having count(*) >= 3""")  # fmt: skip
def w09_runs(spark, d):
    return intervals.runs_of(issues(spark, d), F.col("value") > 10, 3, "place")


@query(f"""with {ISS}, b as (select *, unnest(range(start_ms // 5000, (end_ms + 4999) // 5000)) as bin from iss)
 select run_id, feature, bin, round(max(least(1.0, value / 100) * (least(end_ms, (bin + 1) * 5000) - greatest(start_ms, bin * 5000)) / 5000.0), 10) as value from b group by 1, 2, 3""")  # fmt: skip
def w11_rasterise(spark, d):
    out = intervals.rasterise(issues(spark, d), 5000, F.least(F.lit(1.0), F.col("value") / 100), ("feature",))
    return out.withColumn("value", F.round("value", 10))


@query(f"""with {ISS}, a as (select * from iss where event_type = 'view'), b as (select * from iss where event_type = 'click')
 select a.run_id, a.issue_id as a, b.issue_id as b, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) as overlap from a join b on a.run_id = b.run_id and a.start_ms < b.end_ms and b.start_ms < a.end_ms""")  # fmt: skip
def j02_overlap_join(spark, d):
    i = issues(spark, d).select("run_id", "issue_id", "event_type", "start_ms", "end_ms")
    a = i.where("event_type = 'view'").select("run_id", F.col("issue_id").alias("a"), "start_ms", "end_ms")
    b = i.where("event_type = 'click'").select("run_id", F.col("issue_id").alias("b"), "start_ms", "end_ms")
    x = intervals.overlap_join(a, b, 20_000)
    return x.select("run_id", "a", "b", intervals.overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("right_start"), F.col("right_end")).alias("overlap"))


@query(f"with {ISS} select p.run_id, p.issue_id as point, i.issue_id as inside from iss p join iss i on p.run_id = i.run_id and i.start_ms <= p.start_ms and p.start_ms < i.end_ms and i.issue_id <> p.issue_id")
def j03_point_in_interval(spark, d):
    i = issues(spark, d)
    p = i.select("run_id", F.col("issue_id").alias("point"), F.col("start_ms").alias("at_ms"))
    return intervals.point_join(p, i.select("run_id", F.col("issue_id").alias("inside"), "start_ms", "end_ms"), 20_000).where("point != inside").select("run_id", "point", "inside")


@query(f"""with {ISS}, p as (select * from iss where event_type = 'purchase'), c as (select * from iss where event_type = 'click')
 select p.run_id, p.issue_id, coalesce(max_by(c.issue_id, c.start_ms), -1) as click from p left join c on c.run_id = p.run_id and c.start_ms <= p.start_ms group by 1, 2""")  # fmt: skip
def j04_as_of(spark, d):
    i = issues(spark, d).withColumn("at_ms", F.col("start_ms"))
    p = i.where("event_type = 'purchase'").select("run_id", "issue_id", "at_ms")
    return intervals.as_of(p, i.where("event_type = 'click'"), F.col("issue_id")).select("run_id", "issue_id", F.coalesce("last.value", F.lit(-1)).alias("click"))


@query(f"""with {ISS}, p as (select * from iss where event_type = 'signup'), c as (select * from iss where event_type = 'error')
 select p.run_id, p.issue_id, arg_min(c.issue_id, abs(c.start_ms - p.start_ms) * 2 + (c.start_ms > p.start_ms)::int) as near_id, min(abs(c.start_ms - p.start_ms)) as distance_ms from p join c on c.run_id = p.run_id group by 1, 2""")  # fmt: skip
def j05_nearest(spark, d):
    i = issues(spark, d).withColumn("at_ms", F.col("start_ms"))
    p = i.where("event_type = 'signup'").select("run_id", "issue_id", "at_ms")
    return intervals.nearest(p, i.where("event_type = 'error'").select("run_id", "at_ms", F.col("issue_id").alias("fact_id"))).select("run_id", "issue_id", "near_id", "distance_ms")


@query(f"""with {ISS}, b as (select * from iss where event_type = 'error'), {union_sql('b', 'c')}
 select p.run_id, p.issue_id, p.start_ms - coalesce(sum(greatest(0, least(c.end_ms, p.start_ms) - c.start_ms)), 0)::bigint as new_ms from iss p left join c on c.run_id = p.run_id and c.start_ms <= p.start_ms group by p.run_id, p.issue_id, p.start_ms""")  # fmt: skip
def w31_time_remap(spark, d):
    i = issues(spark, d)
    return intervals.remap(i.select("run_id", "issue_id", F.col("start_ms").alias("at_ms")), i.where("event_type = 'error'")).select("run_id", "issue_id", "new_ms")


@query(f"""with {SEG}, w as (select run_id, seg_idx, unnest({CONTENT.format('text')}) as w from seg),
 wn as (select run_id, seg_idx, (min(seg_idx) over (partition by run_id, w) = seg_idx)::int as new from w), wa as (select run_id, seg_idx, avg(new) as new_share from wn group by 1, 2),
 t as (select run_id, seg_idx, unnest({RUNS.format('text')}) as g from seg),
 tn as (select run_id, seg_idx, (min(seg_idx) over (partition by run_id, g) <> seg_idx)::int as old from t), ta as (select run_id, seg_idx, avg(old) as reused_share from tn group by 1, 2),
 x as (select seg.run_id, seg.seg_idx, {WORDS.format('text')}::int as n_words, coalesce(new_share, 1.0) as new_share, coalesce(reused_share, 0.0) as reused_share from seg left join wa using (run_id, seg_idx) left join ta using (run_id, seg_idx))
 select run_id, seg_idx, n_words, round(new_share, 6) as new_share, round(reused_share, 6) as reused_share, reused_share >= 0.5 and new_share < 0.25 and n_words >= 6 as repeats from x""")  # fmt: skip
def w17_novelty(spark, d):
    x = whole.per_run(segments(spark, d, spread=True), ("n", "words", "tokens"), "seg_idx int, n_words int, new_share double, reused_share double, repeats boolean", series.novelty)
    return x.withColumns({"new_share": F.round("new_share", 6), "reused_share": F.round("reused_share", 6)})


@query("with x as (select source as run_id, doc_id, lag(lang) over (partition by source order by doc_id) as previous, lang from documents where lang is not null) select * from x where previous <> lang")
def w19_switches(spark, d):
    return sequences.switches(table(spark, d, "documents").select(F.col("source").alias("run_id"), "doc_id", "lang"), "lang", "doc_id")


@query()
def w21_paragraphs(spark, d):
    return passes.paragraphs(segments(spark, d))


@query(f"""with {SEG}, x as (select run_id, seg_idx as passage, start_ms, max(end_ms) over w as end_ms, string_agg(text, ' ') over w as text, max(seg_idx) over (partition by run_id) as last from seg window w as (partition by run_id order by seg_idx rows between current row and 2 following))
 select run_id, passage, start_ms, end_ms, text from x where passage + 2 <= last or passage = 0""")  # fmt: skip
def w27_passages(spark, d):
    return sequences.passages(segments(spark, d))


@query("""with m as (select l_suppkey, list_sort(list(l_quantity)) as v from lineitem group by 1 having count(*) >= 6), n as (select l_suppkey, v, v[len(v) // 2 + 1] as mid from m),
 x as (select l_suppkey, mid - 0.8 * greatest(list_sort(list_transform(v, lambda q: abs(q - mid)))[len(v) // 2 + 1], 0.005) as "limit" from n) select l_orderkey, l_linenumber, l_suppkey, l_quantity, "limit" from lineitem join x using (l_suppkey) where l_quantity < "limit" """)  # fmt: skip
def a36_outliers(spark, d):
    return sequences.outliers_below(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", factor=0.8)


_PROFILE = "(values ('narrative', 0.30, 0), ('visual', 0.25, 1), ('pacing', 0.20, 2), ('text', 0.15, 3), ('technical', 0.10, 4)) p(track, weight, place)"
RISK = f"""{ISS}, r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1), b as (select run_id, t, unnest(range((t + 4999) // 5000)) as bin from r),
bins as (select run_id, bin, bin * 5000 as b0, least(t, (bin + 1) * 5000) as b1 from b),
h as (select *, unnest(range(start_ms // 5000, (end_ms + 4999) // 5000)) as bin from iss),
hp as (select h.run_id, h.bin, track, cause_group, issue_id, case severity when 'low' then 1.0/3 when 'medium' then 2.0/3 else 1.0 end::double * case evidence_status when 'supported' then 1.0 else 0.5 end::double * greatest(0, least(end_ms, b1) - greatest(start_ms, b0)) / (b1 - b0) as part from h join bins using (run_id, bin)),
g as (select run_id, bin, track, cause_group, max(part) as part, list(distinct issue_id) as ids from hp where part > 0 group by 1, 2, 3, 4),
pt as (select run_id, bin, track, max(part) as risk, flatten(list(ids)) as ids, max({{'w': round(weight * part, 9), 'p': -place, 'g': cause_group}}) as top from g join {_PROFILE} using (track) group by 1, 2, 3),
sp as (select run_id, unnest(list_distinct([track, 'visual'])) as track, start_ms, start_ms + 30000 as end_ms from iss where issue_id % 2 = 0), {union_sql('sp', 'su', 'run_id, track')},
sb as (select *, unnest(range(start_ms // 5000, (end_ms + 4999) // 5000)) as bin from su),
cov as (select sb.run_id, track, bin, sum(greatest(0, least(end_ms, b1) - greatest(start_ms, b0))) / any_value(b1 - b0) as c from sb join bins using (run_id, bin) group by 1, 2, 3),
cells as (select bins.*, weight, coalesce(c, 0.0) as c, least(1.0, coalesce(risk, 0.0)) as risk, ids, top from bins cross join {_PROFILE} left join pt using (run_id, bin, track) left join cov using (run_id, bin, track)),
tot as (select run_id, bin, b0 as start_ms, b1 as end_ms, sum(weight::double * c * risk) as lower, sum(weight::double * least(1.0, c * risk + 1 - c)) as upper, sum(weight::double * c) as coverage, max(top) as top, list_sort(list_distinct(flatten(list(ids) filter (ids is not null)))) as issue_ids from cells group by 1, 2, 3, 4),
rb as (select run_id, bin, start_ms, end_ms, round(least(1.0, lower), 6) as lower, round(least(1.0, upper), 6) as upper, round(least(1.0, coverage), 6) as coverage, case when coverage >= 1 - 1e-9 then round(least(1.0, lower), 6) end as point, top.g as dominant_cause, coalesce(issue_ids, []) as issue_ids from tot)"""


def _bins(spark, d):
    i = issues(spark, d)
    return risk.risk_bins(runs(i), i, spans(i))


@query(f"with {RISK} select run_id, bin, start_ms, end_ms, lower, upper, coverage, point, dominant_cause, len(issue_ids)::int as n_issues from rb")
def a01_risk_bins(spark, d):
    return _bins(spark, d).withColumn("n_issues", F.size("issue_ids")).drop("issue_ids")


@query(f"""with {RISK}, f as (select *, case when lag(dominant_cause) over w = dominant_cause and lag(end_ms) over w = start_ms then 0 else 1 end as new from rb where dominant_cause is not null window w as (partition by run_id order by bin)),
 q as (select *, sum(new) over (partition by run_id order by bin) as region from f), x as (select run_id, dominant_cause, min(start_ms) as start_ms, max(end_ms) as end_ms, max(lower) as max_risk from q group by run_id, region, dominant_cause),
 y as (select *, round(max_risk * (end_ms - start_ms) / 1000, 6) as score from x), z as (select *, row_number() over (partition by run_id order by score desc, start_ms) as rank from y) select * from z where rank <= 5""")  # fmt: skip
def t01_top_regions(spark, d):
    return risk.top_regions(_bins(spark, d))


@query(f"""with {RISK}, x as (select *, max(end_ms) over (partition by run_id) / 1000.0::double as t from rb), hz as (select *, (end_ms - start_ms) / 1000.0::double as dt, (case when start_ms < 30000 then -ln(0.8) / 30 else -ln(0.45 / 0.8) / (t - 30) end + 0.35 / t * upper) as h from x where t >= 60),
 s as (select *, exp(-sum(h * dt) over w) as s1 from hz window w as (partition by run_id order by bin rows unbounded preceding)), s2 as (select *, coalesce(lag(s1) over (partition by run_id order by bin), 1.0) as s0 from s)
 select run_id, bin, round(s0, 6) as survival_start, round(s1, 6) as survival_end, round(sum(s0 * (1 - exp(-h * dt)) / h) over (partition by run_id order by bin rows unbounded preceding), 4) as watched_s from s2""")  # fmt: skip
def m11_survival(spark, d):
    return risk.survival(_bins(spark, d), "upper")


def _features(spark, d):
    i = issues(spark, d)
    f = intervals.rasterise(i, 1000, F.least(F.lit(1.0), F.col("value") / 50), ("feature",))
    return runs(i), f.select("run_id", F.col("bin").cast("int").alias("t"), "feature", "value")


_W = "case feature when 'repetition' then 0.7 when 'slow_pace' then 0.4 when 'cta_or_sponsor' then 0.8 when 'dead_air' then 1.0 else 0.0 end::double"
CURVE = f"""{ISS}, r as (select run_id, (max(place) + 1) * 10 as n, ((max(place) + 1) * 10)::double as t_s from iss group by 1), g as (select run_id, n, t_s, unnest(range(n)) as t from r),
fb as (select *, unnest(range(start_ms // 1000, (end_ms + 999) // 1000)) as t from iss), f as (select run_id, t, feature, max(least(1.0, value / 50) * (least(end_ms, (t + 1) * 1000) - greatest(start_ms, t * 1000)) / 1000.0::double) as v from fb group by 1, 2, 3),
p as (select run_id, t, coalesce(max(v * {_W}) filter (feature = 'repetition'), 0) + coalesce(max(v * {_W}) filter (feature = 'cta_or_sponsor'), 0) + coalesce(max(v * {_W}) filter (feature in ('slow_pace', 'dead_air')), 0) as pos, max(case when feature = 'concrete' then greatest(-0.1, -0.2 * v) end) as neg from f group by 1, 2),
x0 as (select g.*, coalesce(case when pos > 0 then pos else neg end, 0.0) as lp, case when t_s > 30 then 30.0 else 0.0 end::double as t0, case when t_s > 30 then -ln(0.8) else 0.0 end as h30, greatest(case when t_s > 30 then 30.0 else 0.0 end::double, t_s * 0.95) as te from g left join p using (run_id, t)),
x1 as (select *, (-ln(0.45) - h30) / (pow(least(t_s, te), 0.6) - pow(t0, 0.6) + 1.5 * greatest(0.0, pow(t_s, 0.6) - pow(te, 0.6))) as lam from x0),
x2 as (select *, case when t + 1 <= t0 then h30 * pow((t + 1) / 30.0::double, 0.6) else h30 + lam * (pow(least((t + 1)::double, te), 0.6) - pow(t0, 0.6) + 1.5 * greatest(0.0, pow((t + 1)::double, 0.6) - pow(te, 0.6))) end as c1,
  case when t <= t0 then case when t0 > 0 then h30 * pow(t / 30.0::double, 0.6) else 0.0 end else h30 + lam * (pow(least(t::double, te), 0.6) - pow(t0, 0.6) + 1.5 * greatest(0.0, pow(t::double, 0.6) - pow(te, 0.6))) end as c0 from x1),
x3 as (select *, c1 - c0 as h0, (c1 - c0) * exp(lp) as h from x2), x4 as (select *, exp(-sum(h) over (partition by run_id order by t rows unbounded preceding)) as s1 from x3), x5 as (select *, coalesce(lag(s1) over (partition by run_id order by t), 1.0) as s0 from x4)"""


@query(f"""with {CURVE} select run_id, t::int as t, round(h0, 8) as baseline_hazard, round(h, 8) as hazard, round(s1, 6) as retention, round(s0 - s1, 6) as loss, round(case when h > h0 then s0 * (exp(-h0) - exp(-h)) else 0.0 end, 6) as excess_loss,
 round(sum(s0 * (1 - exp(-h)) / h) over (partition by run_id order by t rows unbounded preceding), 4) as watched_s from x5""")  # fmt: skip
def m04_retention_curve(spark, d):
    return scoring.curve(*_features(spark, d))


@query()
def t02_drop_moments(spark, d):
    return scoring.drop_moments(scoring.curve(*_features(spark, d)))


def _conversation_search(spark, d):
    t = turns(spark, d)
    p = sequences.passages(t.select("run_id", "seg_idx", "start_ms", "end_ms", "text"))
    return t.where("seg_idx = 0").select("run_id", F.col("seg_idx").alias("query_id"), "text"), p


_STEM = "case when ends_with(w, 'ing') and length(w) > 6 then w[:-4] when ends_with(w, 'ed') and length(w) > 5 then w[:-3] when ends_with(w, 'es') and length(w) > 5 then w[:-3] when ends_with(w, 's') and length(w) > 4 then w[:-2] else w end"
_NUMBERS = "case w " + " ".join(f"when '{k}' then '{v}'" for k, v in ft.NUMBER_WORDS.items()) + " else w end"
_NAMED = "replace(replace(replace(lower(text), 'mr. beast', 'mrbeast'), 'mr beast', 'mrbeast'), 'mr b ', 'mrbeast ')"
_TERMS = "select {0}, " + _STEM + " as term from (select {0}, w0, " + _NUMBERS.replace("case w ", "case w0 ").replace("else w end", "else w0 end") + " as w from (select {0}, unnest(string_split(regexp_replace(" + _NAMED + ", '[^\\p{{L}}\\p{{N}}\\p{{M}}'']', ' ', 'g'), ' ')) as w0 from {1}) where w0 <> '') where not list_contains([" + sql_list(ft.STOP_WORDS) + "], w) and (length(w0) > 1 or regexp_matches(w0, '^\\p{{Nd}}$'))"
_ALIKE = "(values " + ", ".join(f"('{k}', '{v}')" for k, vs in ft.SYNONYMS.items() for v in vs) + ") s(term, w)"
BM25 = f"""tw as (select conv_id as run_id, turn as seg_idx, text from conversations), pp as (select run_id, seg_idx as passage, string_agg(text, ' ') over (partition by run_id order by seg_idx rows between current row and 2 following) as text, max(seg_idx) over (partition by run_id) as last from tw),
ps as (select run_id, passage, text from pp where passage + 2 <= last or passage = 0), t0 as ({_TERMS.format('run_id, passage', 'ps')}), t1 as (select run_id, passage, term, count(*) as tf from t0 group by 1, 2, 3),
ix as (select *, sum(tf) over (partition by run_id, passage) as len from t1), n as (select run_id, count(*) as n from ps group by 1), df as (select run_id, term, count(*) as df from ix group by 1, 2), mean as (select run_id, sum(tf) / any_value(n) as mean from ix join n using (run_id) group by 1),
qt as (select run_id, seg_idx as query_id, text from tw where seg_idx = 0), q0 as ({_TERMS.format('run_id, query_id', 'qt')}), q1 as (select * from q0 union all select run_id, query_id, {_STEM} from q0 join {_ALIKE} using (term)), q as (select run_id, query_id, term, count(*) as qn from q1 group by 1, 2, 3),
sc as (select run_id, query_id, passage, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * len / mean))), 5) as score, count(*) as matched from q join df using (run_id, term) join ix using (run_id, term) join n using (run_id) join mean using (run_id) group by 1, 2, 3)"""


@query(f"select doc_id, term, count(*) as n from ({_TERMS.format('doc_id', 'documents')}) group by 1, 2")
def f03_search_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(retrieval.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"with {BM25} select * from sc")
def q02_bm25(spark, d):
    return retrieval.bm25(*_conversation_search(spark, d))


@query(f"""with {BM25}, de as (select run_id, 0::bigint as query_id, passage, row_number() over (partition by run_id order by passage desc) as dense_rank from ps), le as (select *, row_number() over (partition by run_id, query_id order by score desc, passage) as lexical_rank from sc)
 select de.run_id, de.query_id, de.passage, dense_rank, coalesce(lexical_rank, 0) as lexical_rank, round(1 / (60 + dense_rank) + coalesce(1 / (60 + lexical_rank), 0.0), 8) as score from de left join le using (run_id, query_id, passage)""")  # fmt: skip
def q04_rank_fusion(spark, d):
    q, p = _conversation_search(spark, d)
    dense = p.join(q.select("run_id", "query_id"), "run_id").select("run_id", "query_id", "passage", F.col("passage").cast("double").alias("score"))
    return retrieval.fuse(dense, retrieval.bm25(q, p)).fillna(0, ["lexical_rank"])


@query("""with v as (select label as run_id, vec_id as place, embedding::double[] as e from embeddings), p as (select x.run_id, x.place as a, y.place as b, list_cosine_similarity(x.e, y.e) as c from v x join v y on x.run_id = y.run_id and abs(x.place - y.place) > 1),
 k as (select *, row_number() over (partition by run_id, a order by round(c, 10) desc, b desc) as k from p) select run_id, a, b, round(c, 4) as cosine from k where k <= 3 and c >= 0.3 and a < b""")  # fmt: skip
def j09_similar_pairs(spark, d):
    """Least similarity 0.3: the table's vectors have no pair at the default."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("run_id"), F.col("vec_id").alias("place"), "embedding")
    return retrieval.similar_pairs(v, least=0.3)


def _all_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.lit(0).alias("run_id"), F.col("vec_id").alias("place"), "embedding")
    return vectors.fit(v, whole=256), v.where("place % 100 = 0")


@query("""with v as (select vec_id as place, embedding::double[] as e from embeddings), p as (select x.place as a, y.place as b, list_cosine_similarity(x.e, y.e) as c from v x join v y on x.place <> y.place where x.place % 100 = 0),
 k as (select *, row_number() over (partition by a order by round(c, 10) desc, b desc) as rank from p) select a, b, rank, round(c, 4) as cosine from k where rank <= 3""")  # fmt: skip
def j09_nearest_exact(spark, d):
    """Every hundredth vector against all: lists of one large run, left out by their bounds."""
    return vectors.search(*_all_vectors(spark, d)).select("a", "b", "rank", F.round("cosine", 4).alias("cosine"))


@query()
def j09_nearest_indexed(spark, d):
    """The same from the nearest lists alone; the tests measure its recall."""
    return vectors.search(*_all_vectors(spark, d), exact=False).select("a", "b", "rank", F.round("cosine", 4).alias("cosine"))


@query("""select 'lineitem' as "table", 'unique' as rule, l_orderkey::varchar || '/' || l_partkey::varchar as row_key from lineitem group by l_orderkey, l_partkey having count(*) > 1
 union all select 'customer', 'c_nationkey exists', c_custkey::varchar from customer where c_nationkey not in (select n_nationkey from nation)
 union all select 'orders', 'status', o_orderkey::varchar from orders where o_orderstatus not in ('F', 'O') union all select 'orders', 'price', o_orderkey::varchar from orders where not o_totalprice > 1000""")  # fmt: skip
def d01_quality_gate(spark, d):
    li, c, o = (table(spark, d, n) for n in ("lineitem", "customer", "orders"))
    rules = {"status": F.col("o_orderstatus").isin("F", "O"), "price": F.col("o_totalprice") > 1000}
    return checks.duplicates(li, "lineitem", ["l_orderkey", "l_partkey"]).unionByName(checks.orphans(c, "customer", "c_nationkey", table(spark, d, "nation"), "n_nationkey", ["c_custkey"])).unionByName(checks.violations(o, "orders", rules, ["o_orderkey"]))


@query("select k, 'unlisted' as rule from (select distinct o_custkey as k from orders where o_custkey not in (select c_custkey from customer)) union all select c_custkey, 'missing' from customer where c_custkey not in (select o_custkey from orders)")
def d10_set_differences(spark, d):
    return checks.not_unlisted(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def a19_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("select lang, count(*) filter (quality = 1) as accepted, count(*) filter (quality = 0) as dismissed, round(count(*) filter (quality = 1) / count(*), 6) as precision from documents join (select doc_id, max(quality) as quality from labels group by 1) using (doc_id) group by lang")
def a20_precision(spark, d):
    r = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ok = F.count_if(F.col("quality") == 1)
    return table(spark, d, "documents").select("doc_id", "lang").join(r, "doc_id").groupBy("lang").agg(ok.alias("accepted"), F.count_if(F.col("quality") == 0).alias("dismissed"), F.round(ok / F.count("*"), 6).alias("precision"))


@query("select user_id, arg_max(event_type, {'a': ts, 'b': event_id}) as status, max(ts) as at from events group by 1")
def a34_latest_status(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))


@query("select event_type, time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def x05_tumbling(spark, d):
    return jobs.binned(table(spark, d, "events"), "1 hour", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")], ["event_type"])


@query("""with e as (select *, time_bucket(interval '1 hour', ts) as h from events), w as (select event_type, h as window_start from e union all select event_type, h - interval '1 hour' from e)
 select event_type, window_start, window_start + interval '2 hours' as window_end, count(*) as n from w group by 1, 2, 3""")  # fmt: skip
def x06_sliding(spark, d):
    return jobs.binned(table(spark, d, "events"), "2 hours", [F.count("*").alias("n")], ["event_type"], slide="1 hour")


@query("""with x as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events), y as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from x)
 select user_id, count(*) as n, min(ts) as window_start, max(ts) + interval '6 hours' as window_end from y group by user_id, s""")  # fmt: skip
def x07_sessions(spark, d):
    return jobs.sessions(table(spark, d, "events"), "6 hours", [F.count("*").alias("n")], ["user_id"])


@query("with x as (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rank from customer) select c_custkey, c_nationkey, c_acctbal, rank from x where rank <= 5")
def t03_capped(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return sequences.capped(c, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5)


@query("""with x as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, count(*) over (partition by user_id) as n from events)
 select user_id, event_id from x where n <= 8 or round_even(round_even(i * 7 / greatest(n - 1, 1), 0) * (n - 1) / 7, 0) = i""")  # fmt: skip
def t08_evenly(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id")).select("user_id", "event_id", "o")
    return sequences.evenly(e, ["user_id"], "o", 8).select("user_id", "event_id")
