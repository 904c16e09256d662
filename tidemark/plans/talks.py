"""Queries over sentences: questions, concreteness, terms, load and rhythm."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as ft
from tidemark.operators import sentences as st
from tidemark.plans.inputs import PLAIN, TALK, WORDS, talk
from tidemark.plans.queries import TOPIC, sql_list
from tidemark.plans.registry import query
from tidemark.sources.working import written


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SENT = rf"""{TALK}, p0 as (select *, string_split(regexp_replace(trim(text, ' '), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) as ps from talk),
p1 as (select run_id, seg_idx, start_ms, end_ms, regexp_matches(text, '[.?!A-Z]') as punctuated, unnest(range(len(ps))) as pos, trim(unnest(ps), ' ') as text from p0),
p2 as (select *, {WORDS.format('text')} as n from p1 where text <> ''),
p3 as (select *, sum(n) over (partition by run_id, seg_idx order by pos) as upto, greatest(sum(n) over (partition by run_id, seg_idx), 1) as whole, row_number() over (partition by run_id order by seg_idx, pos) as i,
  coalesce(regexp_matches(lag(text) over (partition by run_id order by seg_idx, pos), '[.?!]$'), true) or not regexp_matches(text, '[.?!]') as new from p2),
p4 as (select *, floor(start_ms + (end_ms - start_ms) * (upto - n) / whole)::bigint as a, floor(start_ms + (end_ms - start_ms) * upto / whole)::bigint as b, sum(new::int) over (partition by run_id order by i) as stretch from p3),
p5 as (select *, row_number() over (partition by run_id, stretch order by i) as k from p4),
g as (select run_id, stretch, k, n, i as head, regexp_matches(text, '[.?!]$') as ends from p5 where k = 1
  union all select p5.run_id, p5.stretch, p5.k, case when not g.ends and g.n + p5.n <= 40 then g.n + p5.n else p5.n end, case when not g.ends and g.n + p5.n <= 40 then g.head else p5.i end, regexp_matches(p5.text, '[.?!]$') from g join p5 on p5.run_id = g.run_id and p5.stretch = g.stretch and p5.k = g.k + 1),
s0 as (select p5.run_id, g.head, min(a) as start_ms, arg_max(b, i) as end_ms, string_agg(text, ' ' order by i) as text, arg_min(punctuated, i) as punctuated from p5 join g on g.run_id = p5.run_id and g.stretch = p5.stretch and g.k = p5.k group by 1, 2),
sent as materialized (select run_id, row_number() over (partition by run_id order by head) - 1 as sent, start_ms, end_ms, text, punctuated from s0)"""

QA = rf"""{SENT}, k0 as (select *, array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ') as key, ends_with(text, '?') as asks from sent), k1 as (select *, min(sent) over (partition by run_id, key) as said from k0),
q0 as (select *, min(sent) over (partition by run_id, key) as asked from k1 where asks and {WORDS.format('text')} >= 4), q1 as (select *, {TOPIC.format('text')} as topic from q0 where asked = sent), q as materialized (select *, len(topic) as m from q1 where len(topic) >= 2),
aw as (select run_id, sent as a, start_ms as a_start, unnest({TOPIC.format('text')}) as word from k1 where not asks and said = sent),
n0 as (select q.run_id, q.sent, m, a, a_start, count(*) as k, list_sort(list(word)) as shared from (select run_id, sent, end_ms, m, unnest(topic) as word from q) q join aw using (run_id, word) where a > q.sent and a_start - end_ms <= 600000 group by 1, 2, 3, 4, 5),
lx as (select run_id, sent, arg_min({{'a': a, 'at': a_start, 'shared': shared}}, a) as l from n0 where k >= 2 or (m <= 3 and k >= greatest(1, m // 2 + 1)) group by 1, 2),
c0 as (select q.run_id, q.sent, arg_min({{'a': c.sent, 'at': c.start_ms}}, c.sent) as c from q join k1 c on c.run_id = q.run_id and c.sent between q.sent + 1 and q.sent + 3 where c.start_ms - q.end_ms <= 10000 and not c.asks and regexp_matches({PLAIN.format('c.text')}, '{ft.ANSWER}') group by 1, 2),
j as (select q.*, l, c, nx.sent as nx, nx.start_ms as nx_at, nx.text as nx_text, nx.asks as nx_asks from q left join lx using (run_id, sent) left join c0 using (run_id, sent) left join k1 nx on nx.run_id = q.run_id and nx.sent = q.sent + 1),
j1 as (select *, c is not null and (l is null or l.at > c.at) as by_cue from j), j2 as (select *, case when by_cue then c.a else l.a end as a1, case when by_cue then c.at else l.at end as at1 from j1),
j3 as (select *, (a1 is null or at1 - end_ms > 10000) and nx is not null and not nx_asks and nx_at - end_ms <= 3000 and regexp_matches({PLAIN.format('text')}, '{ft.QUESTION}') and ({WORDS.format('nx_text')} <= 3 or regexp_matches({PLAIN.format('nx_text')}, '{quoted(ft.ANSWER_OPENER)}')) as by_next from j2),
qa as (select run_id, sent, start_ms, end_ms, text, not regexp_matches({PLAIN.format('text')}, '{ft.QUESTION}') as rhetorical, case when by_next then nx else a1 end as answer, case when by_next then nx_at else at1 end as answer_ms, case when by_next or by_cue then '' else coalesce(array_to_string(l.shared, ','), '') end as shared,
  case when by_next or by_cue then 'adjacent_answer_cue' when a1 is not null then 'lexical_overlap' end as detection from j3),
qk as (select *, answer_ms - end_ms as gap_ms, case when start_ms < 60000 then 'framing' when answer is null then 'no_callback' when answer_ms - end_ms <= 10000 then 'immediate' when answer_ms - end_ms <= 60000 then 'short' else 'open_loop' end as kind from qa)"""

CONC = rf"""{SENT}, w0 as (select *, regexp_extract_all(lower(text), '[a-z0-9'']+') as ws from sent), conc as (select run_id, sent, start_ms, end_ms, text, punctuated, len(ws) as n,
  len(regexp_extract_all({PLAIN.format('text')}, '{quoted(ft.EXAMPLES)}')) + case when punctuated then len(list_filter(regexp_extract_all(regexp_replace({PLAIN.format('text')}, '(^|[.?!]\s)[A-Z][a-z]+', '\1_', 'g'), '\b[A-Z][a-z]+'), lambda m: not list_contains([{sql_list(ft.STOP_WORDS)}], lower(m)))) else 0 end as markers,
  len(list_filter(ws, lambda w: list_contains([{sql_list(ft.ABSTRACT_WORDS)}], w))) as abstract from w0 where len(ws) > 0)"""
LOAD = rf"""{SENT}, e as (select run_id, arg_max(end_ms, sent) as t from sent group by 1), win as (select run_id, t, unnest(range((t + 59999) // 60000)) as win from e), sw as (select *, start_ms // 60000 as win, {WORDS.format('text')} as n from sent),
nw as (select run_id, win, count(*) as new_terms from (select run_id, w, min(win) as win from (select run_id, win, unnest({TOPIC.format('text')}) as w from sw) group by 1, 2) group by 1, 2), x0 as (select run_id, win, count(*) as sentences, round_even(avg(n), 1) as mean_words from sw group by 1, 2),
x1 as (select run_id, win, win * 60000 as start_ms, least(t, (win + 1) * 60000) as end_ms, coalesce(sentences, 0) as sentences, coalesce(mean_words, 0.0) as mean_words, coalesce(new_terms, 0) as new_terms from win left join x0 using (run_id, win) left join nw using (run_id, win)),
load as (select *, case when win = 0 then 'normal' when mid > 0 and new_terms > 1.5 * mid then 'high' when mid > 0 and new_terms < 0.5 * mid then 'low' else 'normal' end as load from (select *, median(new_terms) filter (sentences > 0) over (partition by run_id) as mid from x1))"""


def _sents(spark, d):
    return st.sentences(talk(spark, d))


@query(f"with recursive {SENT} select * from sent")
def w22_sentences(spark, d):
    return _sents(spark, d)


@query(f"with recursive {QA} select run_id, sent, rhetorical, coalesce(answer, -1) as answer, coalesce(answer_ms, -1) as answer_ms, coalesce(gap_ms, -1) as gap_ms, shared, kind, detection from qk")
def j06_questions(spark, d):
    q = st.questions(_sents(spark, d))
    return q.fillna(-1, ["answer", "answer_ms", "gap_ms"]).select("run_id", "sent", "rhetorical", "answer", "answer_ms", "gap_ms", F.array_join("shared", ",").alias("shared"), "kind", "detection")


@query(f"with recursive {CONC} select run_id, sent, markers, abstract, round_even(greatest(-1.0, least(1.0, (markers - abstract) / greatest(3.0, n / 6))), 2) as score from conc")
def f09_concreteness(spark, d):
    return st.concreteness(_sents(spark, d)).select("run_id", "sent", "markers", "abstract", "score")


@query(rf"""with recursive {SENT}, d0 as (select run_id, sent as explained, start_ms as explained_ms, regexp_extract_all({PLAIN.format('text')}, '{quoted(ft.DEFINITION)}', 1) as ts from sent), d1 as (select run_id, explained, explained_ms, unnest(range(len(ts))) as nth, trim(lower(unnest(ts)), ' ') as term from d0),
 d as (select * from (select *, list_filter(regexp_split_to_array(term, '\s+'), lambda w: w <> '') as ws from d1) where len(ws) between 2 and 4 and not list_contains([{sql_list(ft.STOP_WORDS)}], ws[1])),
 u as (select d.run_id, term, explained, explained_ms, nth, min({{'used': s.sent, 'used_ms': s.start_ms}}) as u from d join sent s on s.run_id = d.run_id and s.sent < d.explained and regexp_matches({PLAIN.format('lower(s.text)')}, '\b' || term || '\b') group by 1, 2, 3, 4, 5)
 select run_id, term, explained, explained_ms, u.used as used, u.used_ms as used_ms, explained_ms - u.used_ms as gap_ms from u""")  # fmt: skip
def j07_term_dependencies(spark, d):
    return st.term_dependencies(written(_sents(spark, d), "sentences"))


@query(f"with recursive {LOAD} select run_id, win, start_ms, end_ms, sentences, mean_words, new_terms, load from load")
def a13_new_terms(spark, d):
    return st.cognitive_load(_sents(spark, d))


@query(rf"""with recursive {SENT}, e as (select run_id, arg_max(end_ms, sent) as t from sent group by 1), win as (select run_id, t, unnest(range((t + 29999) // 30000)) as win from e), s as (select run_id, start_ms // 30000 as win, {WORDS.format('text')} as n from sent where punctuated),
 x as (select run_id, win, count(*) as sentences, case when count(*) >= 3 and avg(n) > 0 then round_even(stddev_pop(n) / avg(n), 2) end as variation from s group by 1, 2)
 select run_id, win, win * 30000 as start_ms, least(t, (win + 1) * 30000) as end_ms, coalesce(sentences, 0) as sentences, variation, coalesce(variation < 0.25, false) as flat from win left join x using (run_id, win)""")  # fmt: skip
def a14_rhythm(spark, d):
    return st.rhythm(_sents(spark, d))


@query(f"""with recursive {QA}, {CONC.removeprefix(SENT + ', ')}, q9 as (select run_id, count(*) as questions, count(*) filter (kind = 'immediate') as answered_immediately, count(*) filter (kind = 'open_loop') as open_loops, count(*) filter (kind = 'no_callback') as no_callback from qk group by 1),
 c9 as (select run_id, round_even(count(*) filter (markers > 0) / count(*), 2) as concrete_share from conc group by 1), s9 as (select run_id, count(*) as sentences, coalesce(sum(end_ms - start_ms) filter (not punctuated), 0)::bigint as unpunctuated_ms from sent group by 1)
 select run_id, sentences, unpunctuated_ms, coalesce(questions, 0) as questions, coalesce(answered_immediately, 0) as answered_immediately, coalesce(open_loops, 0) as open_loops, coalesce(no_callback, 0) as no_callback, coalesce(concrete_share, 0.0) as concrete_share from s9 left join q9 using (run_id) left join c9 using (run_id)""")  # fmt: skip
def a15_relation_summary(spark, d):
    return st.summary(written(_sents(spark, d), "sentences"))


@query(rf"""with recursive {CONC}, x as (select *, row_number() over (partition by run_id order by sent) as nth from conc), y as (select *, nth - row_number() over (partition by run_id order by sent) as k from x where markers = 0 and punctuated)
 select run_id, min(start_ms) as start_ms, max(end_ms) as end_ms, count(*) as sentences, sum(abstract)::bigint as abstract from y group by run_id, k having max(end_ms) - min(start_ms) >= 5000 and count(*) >= 1 and sum(abstract) >= 0""")  # fmt: skip
def r11_plain_stretches(spark, d):
    return st.abstract_stretches(st.concreteness(_sents(spark, d)).withColumn("abstract", F.col("abstract") + 1), 5000).withColumn("abstract", F.col("abstract") - F.col("sentences"))
