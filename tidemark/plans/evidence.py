"""Queries over findings, cut plans, selections and run summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import findings, intervals, passes, retrieval, risk, scoring, sequences, whole
from tidemark.plans import series
from tidemark.plans.inputs import ISS, PLAIN, SEG, WORDS, issues, runs, segments, spans, table, turns, union_sql
from tidemark.plans.queries import BM25, CURVE, RISK, _conversation_search, _features
from tidemark.plans.registry import SQL, query

FEATURES = """r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1), fb as (select *, unnest(range(start_ms // 1000, (end_ms + 999) // 1000)) as s from iss),
 f as (select run_id, s::int as t, feature, max(least(1.0, value / 50) * (least(end_ms, (s + 1) * 1000) - greatest(start_ms, s * 1000)) / 1000.0::double) as value from fb group by 1, 2, 3)"""


@query(f"""with {ISS}, {FEATURES}, k as (select f.*, f.t - row_number() over (partition by run_id, feature order by f.t) as k from f where value > 0 and feature in ('slow_pace', 'dead_air')),
 g as (select run_id, feature, min(t)::bigint * 1000 as start_ms, (max(t)::bigint + 1) * 1000 as end0, max(value) as strength from k group by run_id, feature, k), x as (select run_id, feature, start_ms, least(end0, r.t) as end_ms, strength from g join r using (run_id))
 select run_id, feature, start_ms, end_ms, round(strength, 6) as strength, case when feature = 'dead_air' then case when end_ms - start_ms >= 6000 then 'high' when end_ms - start_ms >= 3000 then 'medium' else 'low' end when strength >= 0.6 then 'medium' else 'low' end as severity,
 case feature when 'dead_air' then 'supported' else 'provisional' end as evidence from x""")  # fmt: skip
def r20_finding_runs(spark, d):
    r, f = _features(spark, d)
    return findings.finding_runs(f, r).withColumn("strength", F.round("strength", 6))


@query(rf"""with {SEG}, nov as ({SQL["w17_novelty"]}), f as (select run_id, seg_idx, start_ms, end_ms from nov join seg using (run_id, seg_idx) where repeats and not regexp_matches({PLAIN.format('text')}, '{ft.ADVANCE}') and not regexp_matches({PLAIN.format('text')}, '{ft.RECAP}')),
 k as (select *, seg_idx - row_number() over (partition by run_id order by seg_idx) as k from f), x as (select run_id, min(seg_idx) as first, max(seg_idx) as last, count(*) as steps, min(start_ms) as start_ms, max(end_ms) as end_ms from k group by run_id, k having count(*) >= 2),
 cue as (select * from seg where regexp_matches(regexp_replace(lower(text), '[^\w\s'']', ' ', 'g'), '{ft.REPLAY.replace("'", "''")}'))
 select run_id, first, last, steps, start_ms, end_ms from x where not exists (select 1 from cue c where c.run_id = x.run_id and c.end_ms >= x.start_ms - 12000 and c.start_ms <= x.start_ms + 3000)""")  # fmt: skip
def e05_repetition_runs(spark, d):
    return whole.per_run(segments(spark, d, spread=True), series.REPEATS, "first int, last int, steps bigint, start_ms bigint, end_ms bigint", series.repetition_runs)


@query(f"""with {ISS}, {FEATURES}, top as (select run_id, t, feature from (select *, row_number() over (partition by run_id, t order by value desc, feature) as rank from f where value > 0) where rank = 1),
 k as (select *, t - row_number() over (partition by run_id, feature order by t) as k from top) select run_id, feature, min(t) as first, max(t) as last from k group by run_id, feature, k having max(t) - min(t) >= 1""")  # fmt: skip
def w10_dominant_runs(spark, d):
    return findings.dominant_runs(_features(spark, d)[1])


@query(f"""with {ISS}, x as (select *, max(end_ms) over (partition by run_id, cause_group order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as seen from iss)
 select run_id, issue_id, start_ms > 500 and (seen is null or start_ms - seen > 5000) as is_new from x""")  # fmt: skip
def w30_new_texts(spark, d):
    return findings.new_texts(issues(spark, d), F.col("cause_group")).select("run_id", "issue_id", "is_new")


@query(f"""with {SEG}, r as (select run_id, max(end_ms) as t from seg group by 1), n0 as (select *, ceil(t / 20000)::bigint as n0 from r), n1 as (select run_id, t, case when n0 > 1 and t - (n0 - 1) * 20000 < 2000 then n0 - 1 else n0 end as n from n0),
 c as (select *, unnest(range(n)) as clip from n1), x as (select run_id, t, clip, clip * 20000 as start_ms, case when clip = n - 1 then t else (clip + 1) * 20000 end as end_ms from c)
 select run_id, clip, start_ms, end_ms, greatest(0, start_ms - 2000) as context_start, least(t, end_ms + 2000) as context_end from x""")  # fmt: skip
def w23_clips(spark, d):
    return findings.clips(segments(spark, d).groupBy("run_id").agg(F.max("end_ms").alias("duration_ms")))


@query(f"""with {SEG}, b as (select *, {WORDS.format('text')} as n, unnest(range(start_ms // 5000, (end_ms + 4999) // 5000)) as bin from seg)
 select run_id, bin, round(sum(n * (least(end_ms, (bin + 1) * 5000) - greatest(start_ms, bin * 5000)) / (end_ms - start_ms)), 6) as amount from b group by 1, 2""")  # fmt: skip
def j25_words_per_bin(spark, d):
    return findings.spread_over_bins(segments(spark, d), ft.word_count(F.col("text")), 5000).withColumn("amount", F.round("amount", 6))


@query(f"""with {ISS}, r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1), b as (select * from iss where event_type = 'error'), {union_sql('b', 'c')},
 m as (select i.run_id, i.issue_id, any_value(i.end_ms - i.start_ms) - coalesce(sum(greatest(0, least(c.end_ms, i.end_ms) - greatest(c.start_ms, i.start_ms))) filter (c.run_id is not null), 0) as left_ms from iss i left join c on c.run_id = i.run_id and c.start_ms < i.end_ms and i.start_ms < c.end_ms group by 1, 2),
 l as (select run_id, count(*) as n_spans, count(*) filter (left_ms <= 0) as n_removed from m group by 1), s as (select run_id, sum(greatest(0, least(end_ms, t) - start_ms))::bigint as removed from c join r using (run_id) group by 1)
 select run_id, t as before_ms, coalesce(removed, 0) as removed_ms, t - coalesce(removed, 0) as after_ms, n_spans, n_removed from r left join s using (run_id) left join l using (run_id)""")  # fmt: skip
def m14_cut_plan(spark, d):
    i = issues(spark, d)
    return findings.cut_plan(runs(i), i, i.where("event_type = 'error'"))


@query(f"with {RISK} select run_id, track, bin, round(c, 6) as coverage from cov where c is not null")
def a02_covered_share(spark, d):
    i = issues(spark, d)
    return risk.coverage(spans(i), risk.grid(runs(i))).withColumn("coverage", F.round("coverage", 6))


@query(f"with {RISK} select run_id, track, sum(end_ms - start_ms)::bigint as observed_ms from su group by 1, 2")
def a23_observed_time(spark, d):
    u = intervals.union(spans(issues(spark, d)), keys=("run_id", "track"))
    return u.groupBy("run_id", "track").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("observed_ms"))


@query(f"""with {CURVE}, w as (select run_id, t, s1, sum(s0 * (1 - exp(-h)) / h) over (partition by run_id order by t rows unbounded preceding) as watched from x5), e as (select run_id, max(t) + 1 as seconds, max_by(watched, t) as watched, max_by(s1, t) as kept from w group by 1)
 select run_id, seconds::int as seconds, round(watched, 4) as watched_s, round(round(watched, 4) / seconds, 6) as viewed, round(kept, 6) as at_end from e""")  # fmt: skip
def a18_run_summary(spark, d):
    c = scoring.curve(*_features(spark, d)).groupBy("run_id").agg((F.max("t") + 1).alias("seconds"), F.max_by("watched_s", "t").alias("watched_s"), F.max_by("retention", "t").alias("at_end"))
    return c.withColumn("viewed", F.round(F.col("watched_s") / F.col("seconds"), 6))


@query("""with c as (select user_id, event_type, count(*) as n, avg(value) as mean from events group by 1, 2), x as (select *, row_number() over (partition by user_id order by n desc, mean desc, event_type) as k from c)
 select user_id, event_type as reading, n, round(mean, 6) as mean from x where k = 1""")  # fmt: skip
def a25_representative(spark, d):
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    best = c.groupBy("user_id").agg(F.min_by(F.struct("event_type", "n", "mean"), F.struct((-F.col("n")).alias("n"), (-F.col("mean")).alias("m"), "event_type")).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("reading"), "b.n", F.round("b.mean", 6).alias("mean"))


@query("""select o_orderkey, o_orderstatus, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey), '') as parts, count(l_orderkey) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def j15_enriched(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(li, "o_orderkey", "left")
    parts = F.array_join(F.transform("ls", lambda x: F.concat_ws(":", x.l_linenumber, x.l_partkey)), ",")
    return o.select("o_orderkey", "o_orderstatus", F.coalesce(parts, F.lit("")).alias("parts"), F.coalesce(F.size("ls"), F.lit(0)).cast("bigint").alias("n"))


@query(f"""with {ISS}, {union_sql('iss', 'u')}, x as (select run_id, lag(end_ms) over (partition by run_id order by start_ms) as a, start_ms as b from u), g as (select run_id, a as start_ms, b as end_ms, row_number() over (partition by run_id order by b - a desc, a) as rank from x where b - a >= 2000)
 select * from g where rank <= 6""")  # fmt: skip
def t13_longest_gaps(spark, d):
    g = intervals.gaps(issues(spark, d), 2000)
    return sequences.capped(g, ["run_id"], [F.desc(F.col("end_ms") - F.col("start_ms")), F.col("start_ms")], 6)


@query(f"with {ISS} select run_id, string_agg(place, ',' order by place) as places, string_agg(event_type, ',' order by place) as kinds, count(*)::int as n from iss group by 1")
def s17_packed_series(spark, d):
    p = issues(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "event_type"))).alias("s"))
    return p.select("run_id", F.array_join(F.col("s.place").cast("array<string>"), ",").alias("places"), F.array_join("s.event_type", ",").alias("kinds"), F.size("s").alias("n"))


@query("""with x as (select conv_id as run_id, turn as seg_idx, length(text) as n, (sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding))::bigint as upto from conversations)
 select run_id, seg_idx, n, upto from x where upto <= 400""")  # fmt: skip
def k19_within_budget(spark, d):
    w = Window.partitionBy("run_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, 0)
    t = turns(spark, d).select("run_id", "seg_idx", F.length("text").alias("n"))
    return t.withColumn("upto", F.sum("n").over(w)).where("upto <= 400")


@query(f"""with {BM25}, sn as (select run_id, query_id, passage, round(score + case when passage * 10000 - 20000 <= 30000 and 30000 <= (least(passage + 2, last) + 1) * 10000 + 20000 then 1.5 else 0 end, 5) as score from sc join (select run_id, max(seg_idx) as last from tw group by 1) using (run_id))
 select * from sn""")  # fmt: skip
def q03_location_prior(spark, d):
    q, p = _conversation_search(spark, d)
    near = F.when((F.col("start_ms") - 20_000 <= 30_000) & (F.col("end_ms") + 20_000 >= 30_000), 1.5).otherwise(0.0)
    x = retrieval.bm25(q, p).join(p.select("run_id", "passage", "start_ms", "end_ms"), ["run_id", "passage"])
    return x.select("run_id", "query_id", "passage", F.round(F.col("score") + near, 5).alias("score"))


@query()
def q06_top_passages(spark, d):
    q, p = _conversation_search(spark, d)
    x = retrieval.bm25(q, p).join(p.select("run_id", F.col("passage").cast("bigint").alias("passage"), "start_ms", "end_ms"), ["run_id", "passage"])
    return findings.top_passages(x, 3)


@query()
def k20_batches(spark, d):
    return passes.batches(segments(spark, d), "seg_idx", F.length("text"), 12, 2000)
