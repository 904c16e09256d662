"""Queries over features, windows of segments, rollups and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import features, intervals, merges, risk, whole
from tidemark.plans import series
from tidemark.plans.inputs import ISS, PLAIN, SEG, STEP_MS, WORDS, issues, runs, segments, spans, table, turns, union_sql
from tidemark.plans.queries import RISK, RUNS
from tidemark.plans.registry import query

DUR = "dur as (select run_id, max(end_ms) as t from seg group by 1)"
PUT = """pb as (select p.*, t, unnest(range(start_ms // 1000, (end_ms + 999) // 1000)) as s from p join dur using (run_id)),
 f as (select run_id, s::int as t, max(v * greatest(0, least(end_ms, (s + 1) * 1000, pb.t) - greatest(start_ms, s * 1000)) / (least((s + 1) * 1000, pb.t) - s * 1000)) as value from pb where s * 1000 < pb.t group by 1, 2)"""


def _script(spark, d):
    s = segments(spark, d)
    return s.groupBy("run_id").agg(F.max("end_ms").alias("duration_ms")), s


def _rounded(df, digits=6):
    return df.withColumn("value", F.round("value", digits))


@query(rf"""with {SEG}, {DUR}, p as (select *, 1.0::double as v from seg where regexp_matches({PLAIN.format('text')}, '(?i)[0-9]|\b(for example|for instance|such as|let''s say|imagine|like when)\b')), {PUT}
 select run_id, t, 'concrete' as feature, round(value, 6) as value from f""")  # fmt: skip
def e06_concrete(spark, d):
    return _rounded(features.concrete(*_script(spark, d)))


@query(rf"""with {SEG}, {DUR}, ln as (select *, list_max(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda q: {WORDS.format('q')})) as n from seg where regexp_matches(text, '[.!?]')),
 p as (select *, greatest(0.0, least(1.0, (n - 10) / 20))::double as v from ln where n > 10), {PUT} select run_id, t, 'long_sentences' as feature, round(value, 6) as value from f""")  # fmt: skip
def e07_long_sentences(spark, d):
    return _rounded(features.long_sentences(*_script(spark, d), least=10))


@query(rf"""with {ISS}, r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1), x as (select run_id, start_ms // 1000 + unnest(range(60)) as t, unnest(range(60)) as k from iss where event_type = 'signup')
 select run_id, x.t::int as t, 'open_loop' as feature, round(max(1 - k / 60), 6) as value from x join r using (run_id) where x.t * 1000 < r.t group by 1, 2""")  # fmt: skip
def e12_open_loop(spark, d):
    i = issues(spark, d)
    return _rounded(features.pulse(runs(i), i.where("event_type = 'signup'").select("run_id", F.col("start_ms").alias("at_ms")), "open_loop", 60))


def _shots(spark, d):
    i = issues(spark, d)
    b = i.where("event_type in ('view', 'signup')").select("run_id", F.col("start_ms").alias("at_ms"), F.col("event_type").alias("source"))
    return runs(i), i, features.shots(b, runs(i))


SHOTS = f"""{ISS}, r as (select run_id, (max(place) + 1) * 10000 as t from iss group by 1), b as (select run_id, start_ms as cut_ms, min(event_type) as began_by from iss where event_type in ('view', 'signup') group by 1, 2),
 sh as (select run_id, row_number() over w - 1 as shot, cut_ms as start_ms, coalesce(lead(cut_ms) over w, t) as end_ms, began_by, lead(began_by) over w as ended_by from b join r using (run_id) where cut_ms < t window w as (partition by run_id order by cut_ms))"""


@query(f"with {SHOTS} select * from sh")
def w08_shots(spark, d):
    return _shots(spark, d)[2]


@query(f"""with {SHOTS}, m as (select sh.run_id, sh.shot, sh.start_ms, sh.end_ms, iss.value as motion from sh join iss on iss.run_id = sh.run_id and iss.start_ms = sh.start_ms),
 l as (select run_id, greatest(8000.0, 3 * median(end_ms - start_ms))::double as lim, list_sort(list(motion)) as ms from m group by 1 having count(*) >= 4), q as (select m.*, lim, ms[round_even(0.25 * (len(ms) - 1), 0)::int + 1] as low from m join l using (run_id)),
 x as (select *, unnest(range(ceil((start_ms + lim) / 1000)::int, ceil(end_ms / 1000)::int)) as t from q where end_ms - start_ms > lim and motion <= low)
 select run_id, t::int as t, 'long_static_shot' as feature, round(max(greatest(0.0, least(1.0, 0.5 + 0.5 * (t * 1000 - start_ms - lim) / lim))), 6) as value from x group by 1, 2""")  # fmt: skip
def e13_static_shots(spark, d):
    _, i, shots = _shots(spark, d)
    return _rounded(features.static_shots(shots.join(i.select("run_id", "start_ms", F.col("value").alias("motion")), ["run_id", "start_ms"])))


@query(f"""with {SHOTS}, x as (select run_id, start_ms // 1000 + unnest(range(3)) as t, unnest(range(3)) as k from sh where start_ms > 0)
 select run_id, x.t::int as t, 'fresh_visual_change' as feature, round(max(1 - k / 3), 6) as value from x join r using (run_id) where x.t * 1000 < r.t group by 1, 2""")  # fmt: skip
def e14_visual_change(spark, d):
    r, _, shots = _shots(spark, d)
    return _rounded(features.pulse(r, shots.where("start_ms > 0").select("run_id", F.col("start_ms").alias("at_ms")), "fresh_visual_change"))


@query(f"""with {SHOTS}, s as (select run_id, place * 10 + 5 as t from iss), c as (select run_id, start_ms as cut_ms from sh)
 select s.run_id, s.t::int as t, (s.t * 1000 - max(cut_ms) filter (cut_ms <= s.t * 1000)) / 1000 as since_s, (min(cut_ms) filter (cut_ms > s.t * 1000) - s.t * 1000) / 1000 as until_s from s left join c using (run_id) group by s.run_id, s.t""")  # fmt: skip
def w33_cut_distances(spark, d):
    _, i, shots = _shots(spark, d)
    return features.cut_distances(i.select("run_id", (F.col("place") * 10 + 5).cast("int").alias("t")), shots.select("run_id", F.col("start_ms").alias("at_ms")))


@query(f"with {ISS} select run_id, place, round(avg(value) over (partition by run_id order by place rows between 2 preceding and 2 following), 6) as smooth from iss")
def w14_moving_mean(spark, d):
    return features.smoothed(issues(spark, d).select("run_id", "place", "value"), "value", "place").select("run_id", "place", F.round("smooth", 6).alias("smooth"))


@query(f"""with {ISS}, x as (select run_id, place, case when event_type <> 'error' then value end as v from iss)
 select run_id, place, case when count(v) over w >= 5 then round(median(v) over w, 6) end as usual from x window w as (partition by run_id order by place range between 10 preceding and 1 preceding)""")  # fmt: skip
def w13_trailing_median(spark, d):
    i = issues(spark, d).select("run_id", "place", "event_type", "value")
    return features.trailing_median(i, F.when(F.col("event_type") != "error", F.col("value")), "place").select("run_id", "place", F.round("usual", 6).alias("usual"))


@query(f"""with {ISS}, x as (select run_id, place, place - row_number() over (partition by run_id order by place) as k from iss where value < 20)
 select run_id, min(place) * 10000 as start_ms, (max(place) + 1) * 10000 as end_ms, count(*) as windows from x group by run_id, k having count(*) >= 2""")  # fmt: skip
def w16_adjacent_windows(spark, d):
    i = issues(spark, d).withColumn("end_ms", F.col("start_ms") + STEP_MS)
    return features.adjacent_windows(i, F.col("value") < 20)


@query(f"""with {RISK}, sx as (select run_id, start_ms, start_ms + floor(coverage * (end_ms - start_ms))::bigint as end_ms from rb where coverage > 0), {union_sql('sx', 'su2')} select * from su2""")
def w32_coverage_spans(spark, d):
    i = issues(spark, d)
    b = risk.risk_bins(runs(i), i, spans(i)).where("coverage > 0")
    return intervals.union(b.select("run_id", "start_ms", (F.col("start_ms") + F.floor(F.col("coverage") * (F.col("end_ms") - F.col("start_ms")))).alias("end_ms")))


@query(f"with {SHOTS} select run_id, start_ms // 60000 as win, count(*) as cuts from sh where start_ms > 0 group by 1, 2")
def a07_cuts_per_window(spark, d):
    _, _, shots = _shots(spark, d)
    return shots.where("start_ms > 0").groupBy("run_id", F.floor(F.col("start_ms") / 60_000).alias("win")).agg(F.count("*").alias("cuts"))


@query(f"""with {ISS} select run_id, start_ms // 60000 as win, round(median(value), 6) as mid, round(stddev_pop(value), 6) as spread, round(avg((event_type <> 'error')::int), 6) as voiced from iss group by 1, 2""")
def a08_window_statistics(spark, d):
    i = issues(spark, d)
    voiced = F.avg((F.col("event_type") != "error").cast("int"))
    return i.groupBy("run_id", F.floor(F.col("start_ms") / 60_000).alias("win")).agg(F.round(F.median("value"), 6).alias("mid"), F.round(F.stddev_pop("value"), 6).alias("spread"), F.round(voiced, 6).alias("voiced"))


@query(f"""with {SEG}, t as (select distinct run_id, seg_idx, unnest({RUNS.format('text')}) as g from seg),
 n as (select run_id, seg_idx, count(*) as n from t group by 1, 2), p as (select x.run_id, x.seg_idx, y.seg_idx as earlier, count(*) as k from t x join t y on x.run_id = y.run_id and x.g = y.g and y.seg_idx < x.seg_idx group by 1, 2, 3),
 q as (select p.*, k / n as share, row_number() over (partition by run_id, seg_idx order by k desc, earlier) as rank from p join n using (run_id, seg_idx)) select run_id, seg_idx, earlier, round(share, 6) as share from q where rank = 1""")  # fmt: skip
def j08_best_earlier(spark, d):
    x = whole.per_run(segments(spark, d, spread=True), ("tokens",), "seg_idx int, earlier int, share double", series.best_earlier)
    return x.withColumn("share", F.round("share", 6))


@query(f"""with {ISS} select run_id, event_type, start_ms // 60000 as win, array_to_string(list_sort(list_distinct(list(cause_group))), ',') as causes, array_to_string(list_sort(list(issue_id)), ',') as ids, max(value) as worst from iss group by 1, 2, 3""")
def u03_merge_same(spark, d):
    i = issues(spark, d).withColumn("win", F.floor(F.col("start_ms") / 60_000))
    return merges.merge_same(i, ["run_id", "event_type", "win"], {"causes": F.col("cause_group"), "ids": F.col("issue_id")}, [F.max("value").alias("worst")]).withColumns({"causes": F.array_join("causes", ","), "ids": F.array_join(F.col("ids").cast("array<string>"), ",")})


@query("""with a as (select l_partkey as part, 0 as p, max(l_extendedprice) as price from lineitem where l_discount > 0.05 group by 1 union all select p_partkey, 1, p_retailprice from part)
 select part, case p when 0 then 'sold' else 'listed' end as source, round(price, 2) as price from (select *, row_number() over (partition by part order by p) as k from a) where k = 1""")  # fmt: skip
def u04_first_wins(spark, d):
    sold = table(spark, d, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_extendedprice").alias("price"))
    listed = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price"))
    return merges.first_wins([("sold", sold), ("listed", listed)], ["part"]).withColumn("price", F.round("price", 2))


@query(r"""with x as (select conv_id as run_id, turn as seg_idx, trim(regexp_replace(lower(text), '[^0-9a-z\x{80}-\x{ffff}]+', ' ', 'g'), ' ') as said from conversations)
 select run_id, said, min(seg_idx) as first, count(*) - 1 as replays from x where said <> '' group by 1, 2""")
def u07_first_said(spark, d):
    t = turns(spark, d).withColumn("said", ft.normalise(F.col("text"))).where("said != ''")
    return t.groupBy("run_id", "said").agg(F.min("seg_idx").alias("first"), (F.count("*") - 1).alias("replays"))


@query("""with t as (select lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9'']+'))) as term from documents), n as (select lang, count(*) as n from documents group by 1)
 select t.lang, term, count(*) as df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from t join n on t.lang is not distinct from n.lang group by 1, 2 having count(*) >= 5""")  # fmt: skip
def a26_corpus_statistics(spark, d):
    docs = table(spark, d, "documents").select("lang", "text")
    return merges.document_frequencies(docs, ["lang"], ft.tokens(F.col("text")), least=5).withColumn("idf", F.round("idf", 6))


@query(f"""with {ISS}, x as (select *, row_number() over (partition by run_id order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, case evidence_status when 'supported' then 0 else 1 end, start_ms, issue_id) as rank from iss)
 select run_id, issue_id, severity, evidence_status, rank from x""")  # fmt: skip
def t05_issue_order(spark, d):
    return merges.issue_order(issues(spark, d)).select("run_id", "issue_id", "severity", "evidence_status", "rank")


def _findings(spark, d):
    i = issues(spark, d)
    return i.select("run_id", F.col("issue_id").alias("finding_id"), "cause_group", "severity", F.col("evidence_status").alias("evidence_strength"), (F.col("event_type") == "error").alias("safe_edit"), "start_ms", "end_ms")


@query()
def t04_ranked_findings(spark, d):
    return merges.rank_findings(_findings(spark, d))


@query("with x as (select doc_id, regexp_extract_all(text, '[^.!?]+') as s from documents) select doc_id, coalesce(list_max(list_transform(s, lambda q: %s)), 0)::int as longest from x" % WORDS.format("q"))
def f08_longest_sentence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), features.longest_sentence(F.col("text"))).otherwise(0).alias("longest"))


@query("""with w as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before from conversations)
 select conv_id as run_id, count(*) as turns, count(*) filter (before = role) as repeats, count(distinct role) as roles from w group by 1""")  # fmt: skip
def turn_summary(spark, d):
    w = table(spark, d, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    return w.groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("turns"), F.count_if(F.col("before") == F.col("role")).alias("repeats"), F.countDistinct("role").alias("roles"))
