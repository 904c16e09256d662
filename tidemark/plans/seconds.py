"""Queries over per-second features; words, sound, shots, texts and structure are derived from the lines of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import word_count
from tidemark.operators import features, signals, whole
from tidemark.plans import series
from tidemark.plans.inputs import KINDS, STATUSES, TALK, WORDS, talk
from tidemark.plans.queries import CONTENT
from tidemark.plans.registry import query
from tidemark.sources.working import written


def pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Run:
    """The inputs of a run, from the lines of a document. For plans that use them many times, they are written once (stored=True). spread: lines are dealt out by run."""

    def __init__(self, spark, sf_dir, stored=False, spread=False):
        self.kept = {} if stored else None
        self.segments = self.keep("segments", lambda: talk(spark, sf_dir, spread))
        self.runs = self.keep("runs", lambda: self.segments.groupBy("run_id").agg(F.max("end_ms").alias("duration_ms")))

    def keep(self, name, make) -> DataFrame:
        """make(), or of a stored run what it wrote under this name before."""
        if self.kept is None:
            return make()
        if name not in self.kept:
            self.kept[name] = written(make(), f"run-{name}")
        return self.kept[name]

    @property
    def words(self) -> DataFrame:
        s = self.segments.withColumns({"n": word_count(F.col("text")), "step": F.when(F.col("seg_idx") % 4 == 1, 250).otherwise(400)}).where("n > 0")
        at = F.col("start_ms") + F.col("i") * F.col("step")
        return s.select("run_id", "seg_idx", "start_ms", "step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n").cast("bigint") - 1)).alias("i")).select("run_id", "seg_idx", at.alias("start_ms"), (at + F.col("step") - 50).alias("end_ms"))

    @property
    def speech(self) -> DataFrame:
        return self.segments.where("seg_idx % 5 != 3").select("run_id", "start_ms", "end_ms")

    @property
    def silence(self) -> DataFrame:
        return self.segments.where("seg_idx % 7 = 5 and end_ms - start_ms > 1000").select("run_id", (F.col("start_ms") + 500).alias("start_ms"), (F.col("end_ms") - 500).alias("end_ms"))

    def _grid(self, step: int) -> DataFrame:
        return self.runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("duration_ms") - 1) / step))).alias("k"))

    @property
    def rms(self) -> DataFrame:
        t = F.col("k") * 500
        level = F.when((F.floor(t / 4000) + F.col("run_id")) % 5 == 0, None).when((F.floor(t / 3000) + F.col("run_id")) % 3 == 0, -70.0).otherwise(-20.0 - F.col("k") % 7)
        return self._grid(500).select("run_id", t.alias("t_ms"), level.alias("dbfs"))

    @property
    def loudness(self) -> DataFrame:
        return self._grid(1000).select("run_id", (F.col("k") * 1000).alias("t_ms"), (-14.0 - (F.floor(F.col("k") / 4) * 3 + F.col("run_id")) % 7 * 4.0 - F.floor(F.col("k") / 30) % 2 * 8.0).alias("lufs"))

    @property
    def pitch(self) -> DataFrame:
        k = F.col("k")
        return self._grid(10_000).select("run_id", (k * 10_000).alias("start_ms"), ((k + 1) * 10_000).alias("end_ms"), ((F.col("run_id") + F.floor(k / 3) * 5) % 11 * 3.0).alias("pitch_std_hz"), ((k * 7 + F.col("run_id")) % 10 / 10).alias("voiced"))

    @property
    def cuts(self) -> DataFrame:
        return self.segments.where("seg_idx % 2 = 0").select("run_id", F.col("start_ms").alias("at_ms"))

    @property
    def shots(self) -> DataFrame:
        s = features.shots(self.cuts.withColumn("source", F.lit("cut")), self.runs)
        return s.withColumn("motion", (F.col("run_id") * 3 + F.col("shot") * 7) % 20 / 100)

    @property
    def tracks(self) -> DataFrame:
        return self.segments.select("run_id", "seg_idx", "start_ms", F.least("end_ms", F.col("start_ms") + 6000).alias("end_ms"), "text", ((F.col("run_id") + F.col("seg_idx")) % 10 / 10).alias("confidence"))

    @property
    def structure(self) -> DataFrame:
        at = lambda i, c: F.max(F.when(F.col("seg_idx") == i, F.col(c)))
        return self.segments.groupBy("run_id").agg(at(1, "start_ms").alias("hook_ms"), at(1, "end_ms").alias("hook_end_ms"), at(5, "start_ms").alias("first_substance_ms"))

    @property
    def promises(self) -> DataFrame:
        s = self.segments.withColumns({"later": F.lead("start_ms", 3).over(Window.partitionBy("run_id").orderBy("seg_idx")), "status": pick(STATUSES, (F.col("run_id") + F.col("seg_idx")) % 4)})
        kept = F.when(F.col("status").isin("fulfilled", "partial"), F.col("later"))
        return s.where("seg_idx % 6 = 2").select("run_id", F.col("seg_idx").alias("promise"), "status", F.col("start_ms").alias("setup_ms"), kept.alias("first_fulfil_ms"))

    @property
    def spans(self) -> DataFrame:
        k = (F.col("run_id") + F.col("seg_idx")) % 9
        return self.segments.where((F.col("seg_idx") > 0) & (k < 8)).select("run_id", "seg_idx", pick(KINDS, k).alias("kind"), "start_ms", "end_ms")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


RUN = f"""{TALK}, dur as (select run_id, max(end_ms) as t from talk group by 1), sec as (select run_id, t as dur, unnest(range((t + 999) // 1000)) as t from dur),
wd as (select run_id, seg_idx, start_ms + i * step as start_ms, start_ms + i * step + step - 50 as end_ms from (select run_id, seg_idx, start_ms, case when seg_idx % 4 = 1 then 250 else 400 end as step, unnest(range({WORDS.format('text')})) as i from talk)),
sp as (select run_id, start_ms, end_ms from talk where seg_idx % 5 <> 3), sil as (select run_id, start_ms + 500 as start_ms, end_ms - 500 as end_ms from talk where seg_idx % 7 = 5 and end_ms - start_ms > 1000),
rms as (select run_id, k * 500 as t_ms, case when (k * 500 // 4000 + run_id) % 5 = 0 then null when (k * 500 // 3000 + run_id) % 3 = 0 then -70.0 else -20.0 - k % 7 end::double as dbfs from (select run_id, unnest(range((t - 1) // 500 + 1)) as k from dur)),
loud as (select run_id, k * 1000 as t_ms, (-14.0 - (k // 4 * 3 + run_id) % 7 * 4.0 - k // 30 % 2 * 8.0)::double as lufs from (select run_id, unnest(range((t - 1) // 1000 + 1)) as k from dur)),
pit as (select run_id, k * 10000 as start_ms, (k + 1) * 10000 as end_ms, ((run_id + k // 3 * 5) % 11 * 3.0)::double as std, (k * 7 + run_id) % 10 / 10 as voiced from (select run_id, unnest(range((t - 1) // 10000 + 1)) as k from dur)),
cut as (select run_id, start_ms as at_ms from talk where seg_idx % 2 = 0), sht as (select run_id, row_number() over w - 1 as shot, at_ms as start_ms, coalesce(lead(at_ms) over w, t) as end_ms, (run_id * 3 + (row_number() over w - 1) * 7) % 20 / 100 as motion from cut join dur using (run_id) where at_ms < t window w as (partition by run_id order by at_ms)), trk as (select run_id, seg_idx, start_ms, least(end_ms, start_ms + 6000) as end_ms, text, (run_id + seg_idx) % 10 / 10 as confidence from talk),
stc as (select run_id, max(start_ms) filter (seg_idx = 1) as hook_ms, max(end_ms) filter (seg_idx = 1) as hook_end_ms, max(start_ms) filter (seg_idx = 5) as substance from talk group by 1),
pr0 as (select *, lead(start_ms, 3) over (partition by run_id order by seg_idx) as later, ({_list(STATUSES)})[(run_id + seg_idx) % 4 + 1] as status from talk), pro as (select run_id, seg_idx as promise, status, start_ms as setup_ms, case when status in ('fulfilled', 'partial') then later end as first from pr0 where seg_idx % 6 = 2),
spn as (select run_id, seg_idx, ({_list(KINDS)})[(run_id + seg_idx) % 9 + 1] as kind, start_ms, end_ms from talk where seg_idx > 0 and (run_id + seg_idx) % 9 < 8)"""


def put_sql(source: str, name: str) -> str:
    """select of a feature's seconds from spans (run_id, start_ms, end_ms)."""
    return f"""select run_id, s::int as t, '{name}' as feature, round(max(greatest(0, least(end_ms, (s + 1) * 1000, t) - greatest(start_ms, s * 1000)) / (least((s + 1) * 1000, t) - s * 1000)), 6) as value
 from (select p.*, t, unnest(range(start_ms // 1000, (end_ms + 999) // 1000)) as s from ({source}) p join dur using (run_id) where end_ms > start_ms) where s * 1000 < t group by 1, 2"""


def steady_sql(source: str, flag: str, least: int) -> str:
    return f"(select * from (select *, count(*) over (partition by run_id, k) as n_steady from (select *, t - row_number() over (partition by run_id order by t) as k from {source} where {flag})) where n_steady >= {least})"


PACE = f"""{RUN}, w1 as (select *, count(*) over (partition by run_id) as n_all, lead(start_ms) over (partition by run_id order by start_ms, end_ms) as nx from wd), w2 as (select run_id, start_ms, end_ms, row_number() over (partition by run_id order by start_ms, end_ms) as i, coalesce(greatest(0, least(500, nx - end_ms)), 0) as gap from w1 where n_all >= 50),
pc0 as (select sec.run_id, sec.t, count(*) as n, sum(end_ms - start_ms) + sum(gap) - arg_max(gap, i) as speak from sec join w2 on w2.run_id = sec.run_id and w2.start_ms >= sec.t * 1000 - 10000 and w2.start_ms < sec.t * 1000 + 10000 group by 1, 2),
pc1 as (select run_id, t::int as t, 60000 * n / speak as wpm from pc0 where speak > 4000 and n >= 8), loc as (select *, median(wpm) over (partition by run_id) as usual from pc1)"""
PAUSE = f"""{RUN}, sd as (select rms.run_id, dbfs, row_number() over (partition by rms.run_id order by dbfs) as i, count(*) over (partition by rms.run_id) as n from sp join rms on rms.run_id = sp.run_id and sp.start_ms <= t_ms and t_ms < sp.end_ms where dbfs is not null),
lim as (select run_id, greatest(-45.0, coalesce(dbfs - 20.0, -45.0)) as lim from dur left join (select run_id, dbfs from sd where i = n // 2 + 1) using (run_id)),
g0 as (select run_id, coalesce(lag(end_ms) over (partition by run_id order by start_ms, end_ms), 0) as start_ms, start_ms as end_ms from (select * from sp union all select run_id, t, t from dur where run_id in (select run_id from sp))), g1 as (select * from g0 where end_ms - start_ms >= 2000),
g2 as (select g1.run_id, g1.start_ms, g1.end_ms, avg((coalesce(dbfs, -120.0) < lim)::int) filter (t_ms is not null) as quiet from g1 join lim using (run_id) left join rms on rms.run_id = g1.run_id and g1.start_ms <= t_ms and t_ms < g1.end_ms group by 1, 2, 3),
b0 as (select run_id, start_ms, end_ms, case when quiet is null then 'no speech' else 'no speech, quiet' end as source from g2 where quiet is null or quiet >= 0.6 union all select run_id, start_ms, end_ms, 'silence' from sil where end_ms - start_ms >= 2000),
b1 as (select *, max(end_ms) over (partition by run_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as reach from b0), b2 as (select *, sum(case when reach is null or start_ms > reach then 1 else 0 end) over (partition by run_id order by start_ms, end_ms) as k from b1),
b3 as (select run_id, min(start_ms) as start_ms, max(end_ms) as end_ms, array_to_string(list_sort(list_distinct(list(source))), ' + ') as source from b2 group by run_id, k), pau as (select b3.* from b3 join dur using (run_id) where start_ms >= 1000 and end_ms <= t - 1000)"""
LEVEL = f"""{PAUSE}, said as (select distinct run_id, unnest(range(start_ms // 1000, (end_ms + 999) // 1000)) as t from sp), v0 as (select sec.run_id, sec.t::int as t, lufs, said.t is not null as speaks from sec left join loud on loud.run_id = sec.run_id and loud.t_ms // 1000 = sec.t left join said on said.run_id = sec.run_id and said.t = sec.t),
v1 as (select *, median(lufs) filter (speaks and lufs > -60) over (partition by run_id) as usual, count(lufs) filter (speaks and lufs > -60) over (partition by run_id) as n_said from v0), lev as (select run_id, t, lufs, speaks, usual from v1 where n_said >= 20)"""


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


def _local(r: Run) -> DataFrame:
    return signals.local_pace(r.runs, r.words)


def _levels(r: Run) -> DataFrame:
    return signals.levels(r.runs, r.loudness, r.speech)


def _pauses(r: Run) -> DataFrame:
    return signals.pauses(r.runs, r.speech, r.silence, r.rms)


@query(f"with {RUN} " + put_sql("select run_id, least(substance, coalesce(hook_end_ms, 0)) as start_ms, substance as end_ms from stc where substance > 0 and substance - least(substance, coalesce(hook_end_ms, 0)) > 15000", "setup_before_substance"))
def e01_setup(spark, d):
    r = Run(spark, d)
    return _rounded(signals.setup(r.runs, r.structure))


@query(f"with {RUN} " + put_sql("select run_id, 0 as start_ms, least(30000, coalesce(hook_ms, 30000)) as end_ms from stc", "no_hook_yet"))
def e02_no_hook(spark, d):
    r = Run(spark, d)
    return _rounded(signals.no_hook(r.runs, r.structure))


@query(f"""with {RUN}, p as (select pro.*, t, coalesce(status in ('fulfilled', 'partial') and first > 45000 and first > 0.2 * t, false) as late, status in ('unaddressed', 'uncertain') as open from pro join dur using (run_id)),
 x as (select run_id, late, unnest(case when late then range(15, least((t + 999) // 1000, first // 1000)) when open then range(60, (t + 999) // 1000) else [] end) as t from p)
 select run_id, t::int as t, 'payoff_pending' as feature, round(max(case when late then greatest(0.0, least(1.0, (t - 15) / 60)) else 0.5 end), 6) as value from x group by 1, 2""")  # fmt: skip
def e03_payoff_pending(spark, d):
    r = Run(spark, d)
    return _rounded(signals.payoff_pending(r.runs, r.promises))


@query(f"""with {RUN}, w as (select run_id, seg_idx, unnest({CONTENT.format('text')}) as w from talk), fw as (select *, min(seg_idx) over (partition by run_id, w) as first from w),
 ins as (select sec.run_id, sec.t, seg_idx, min(seg_idx) over (partition by sec.run_id, sec.t) as lo from sec join talk on talk.run_id = sec.run_id and talk.end_ms > sec.t * 1000 - 10000 and talk.start_ms < sec.t * 1000 + 10000),
 n as (select ins.run_id, ins.t, count(distinct w) as n, count(distinct w) filter (first >= lo) as new from ins join fw on fw.run_id = ins.run_id and fw.seg_idx = ins.seg_idx group by 1, 2), v as (select run_id, t, new / n as novelty from n where n >= 8),
 x as (select v.*, 0.6 * coalesce(mid, 0.5) as lim from v left join (select run_id, median(novelty) as mid from v where t >= 60 group by 1) using (run_id))
 select run_id, t::int as t, 'low_novelty' as feature, round(greatest(0.0, least(1.0, (lim - novelty) / lim)), 6) as value from {steady_sql('x', 't >= 30 and novelty < lim', 10)}""")  # fmt: skip
def e04_low_novelty(spark, d):
    x = whole.per_run(Run(spark, d, spread=True).segments, ("words",), "t int, value double", series.low_novelty)
    return _rounded(x.select("run_id", "t", F.lit("low_novelty").alias("feature"), "value"))


@query(f"""with {PACE} select run_id, t, 'slow_pace' as feature, round(greatest(0.0, least(1.0, (0.8 * usual - wpm) / (0.3 * usual))), 6) as value from loc where wpm < 0.8 * usual
 union all select run_id, t, 'fast_pace', round(greatest(0.0, least(1.0, (wpm - 1.2 * usual) / (0.3 * usual))), 6) from loc where wpm > 1.2 * usual""")  # fmt: skip
def e08_pace(spark, d):
    return _rounded(signals.pace(_local(Run(spark, d, spread=True))))


@query(f"with {PAUSE} select * from pau")
def w02_pauses(spark, d):
    return _pauses(Run(spark, d))


@query(f"with {PAUSE} " + put_sql("select * from pau", "dead_air"))
def e10_dead_air(spark, d):
    r = Run(spark, d)
    return _rounded(signals.dead_air(r.runs, _pauses(r)))


END = "(start_ms >= t - 45000 or start_ms >= 0.85 * t)"


@query(f"with {RUN} select * from (" + put_sql(f"select run_id, start_ms, end_ms from spn join dur using (run_id) where kind in ('cta', 'sponsor') and not {END}", "cta_or_sponsor") + ") union all select * from ("
       + put_sql(f"select run_id, start_ms, case when kind in ('cta', 'sponsor') then end_ms else t end as end_ms from spn join dur using (run_id) where (kind in ('cta', 'sponsor', 'recap') and {END}) or kind = 'outro'", "outro") + ")")
def e11_interruptions(spark, d):
    r = Run(spark, d)
    return _rounded(signals.interruptions(r.runs, r.spans))


TEXTS = "k as (select *, trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ') as key from trk where confidence >= 0.5 and length(trim(text, ' ')) >= 3)"


@query(f"""with {RUN}, {TEXTS}, n as (select *, max(end_ms) over (partition by run_id, key order by start_ms, end_ms rows between unbounded preceding and 1 preceding) as seen from k), e as (select run_id, start_ms from n where start_ms > 500 and (seen is null or start_ms - seen > 5000)),
 x as (select run_id, start_ms // 1000 + unnest(range(3)) as s, unnest(range(3)) as j from e) select run_id, s::int as t, 'new_onscreen_text' as feature, round(max(1 - j / 3), 6) as value from x join dur using (run_id) where s < (t + 999) // 1000 group by 1, 2""")  # fmt: skip
def e15_new_onscreen_text(spark, d):
    r = Run(spark, d)
    return _rounded(signals.new_onscreen_text(r.runs, r.tracks))


@query(f"""with {PACE}, {TEXTS}, o as (select sec.run_id, sec.t, sum({WORDS.format('text')}) as n from sec join k on k.run_id = sec.run_id and k.start_ms <= sec.t * 1000 + 500 and sec.t * 1000 + 500 < k.end_ms group by 1, 2)
 select o.run_id, o.t::int as t, 'dense_text_fast_speech' as feature, round(least(1.0, n / 24), 6) as value from o join loc on loc.run_id = o.run_id and loc.t = o.t where n >= 12 and wpm > 1.1 * usual""")  # fmt: skip
def e16_dense_text(spark, d):
    r = Run(spark, d, spread=True)
    return _rounded(signals.dense_text(r.tracks, _local(r)))


@query(f"""with {LEVEL}, q as (select distinct run_id, t from ({put_sql('select * from pau', 'q')})), b as (select *, median(case when speaks then lufs end) over w as mid, count(case when speaks then lufs end) over w as n from lev window w as (partition by run_id order by t range between 10 preceding and 1 preceding)),
 x as (select b.* from b left join q on q.run_id = b.run_id and q.t = b.t where q.t is null) select run_id, t, 'loudness_drop' as feature, 1.0::double as value from {steady_sql('x', 'speaks and n >= 5 and lufs <= mid - 10', 3)}""")  # fmt: skip
def e17_loudness_drop(spark, d):
    r = Run(spark, d)
    return signals.loudness_drop(_levels(r), signals.dead_air(r.runs, _pauses(r)))


@query(f"with {LEVEL} select run_id, t, 'energy_lift' as feature, 1.0::double as value from {steady_sql('lev', 'speaks and lufs >= usual + 4', 3)}")
def e18_energy_lift(spark, d):
    return signals.energy_lift(_levels(Run(spark, d)))


@query(f"""with {LEVEL}, v as (select *, count(*) over (partition by run_id) as n, median(std) over (partition by run_id) as mid from pit where voiced >= 0.3), f as (select v.run_id, v.start_ms, v.end_ms, any_value(std) < 0.6 * any_value(mid) and coalesce(avg(lufs) < any_value(usual) - 3, false) as flat from v join lev on lev.run_id = v.run_id and lev.t * 1000 >= v.start_ms and lev.t * 1000 < v.end_ms where n >= 4 group by 1, 2, 3),
 a as (select *, case when lag(end_ms) over (partition by run_id order by start_ms) = start_ms then 0 else 1 end as new from f where flat), c as (select *, sum(new) over (partition by run_id order by start_ms) as k from a), e as (select run_id, min(start_ms) as start_ms, max(end_ms) as end_ms from c group by run_id, k having count(*) >= 2)
 select distinct lev.run_id, lev.t, 'flat_low_energy' as feature, 1.0::double as value from e join lev on lev.run_id = e.run_id and lev.t * 1000 >= e.start_ms and lev.t * 1000 < e.end_ms""")  # fmt: skip
def e19_flat_low_energy(spark, d):
    r = Run(spark, d)
    return signals.flat_low_energy(_levels(r), r.pitch)


@query(f"""with {PACE}, ml as (select *, median(lufs) over (partition by run_id) as mid from loud), c0 as (select sec.run_id, sec.t, max(at_ms // 1000) filter (at_ms // 1000 <= sec.t) as last, min(at_ms // 1000) filter (at_ms // 1000 > sec.t) as nxt from sec join cut using (run_id) group by 1, 2),
 c as (select run_id, t, greatest(-1.0, least(1.0, (usual - wpm) / usual)) as c from loc union all select run_id, t_ms // 1000 - 1, greatest(-1.0, least(1.0, (mid - lufs) / 6.0)) from ml where t_ms >= 1000
   union all select run_id, t, case when least(coalesce(t - last, 1000000000), coalesce(nxt - t, 1000000000)) <= 2 then -0.6 when coalesce(t - last, 1000000000) >= 8 then 0.3 else 0.0 end from c0),
 r as (select sec.run_id, sec.t, coalesce(avg(c), 0.0) as raw from sec left join c on c.run_id = sec.run_id and c.t = sec.t group by 1, 2), v as (select run_id, t, avg(raw) over (partition by run_id order by t rows between 2 preceding and 2 following) as v from r)
 select run_id, t::int as t, case when v > 0 then 'micro_slowdown' else 'micro_pickup' end as feature, round_even(least(1.0, abs(v)), 4) as value from v where round_even(abs(v), 4) > 0.02""")  # fmt: skip
def e20_micro_variation(spark, d):
    r = Run(spark, d)
    return signals.micro_variation(r.runs, _local(r), r.loudness, r.cuts).where("value > 0.02")


@query(f"""with {RUN} select run_id, count(*) filter (seg_idx % 4 = 1) as fast_words, count(*) as words, round(sum(end_ms - start_ms) / 60000.0, 6) as minutes from wd group by 1""")
def a32_speech_totals(spark, d):
    w = Run(spark, d).words
    return w.groupBy("run_id").agg(F.count_if(F.col("seg_idx") % 4 == 1).alias("fast_words"), F.count("*").alias("words"), F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 60000.0, 6).alias("minutes"))


@query(f"with {RUN} select run_id, seg_idx, start_ms, end_ms from trk where confidence >= 0.7 and length(trim(text, ' ')) >= 20")
def p04_sure_texts(spark, d):
    return signals.readable(Run(spark, d).tracks, 0.7, 20).select("run_id", "seg_idx", "start_ms", "end_ms")


_FILL = "(length({0}) - length(replace({0}, {1}, ''))) // length({1})"


@query(f"""with {RUN}, n as (select run_id, seg_idx, start_ms, end_ms, replace(' ' || regexp_replace(lower(text), '[^\\w\\s'']', ' ', 'g') || ' ', ' ', '  ') as t from talk),
 c as (select run_id, seg_idx, start_ms, end_ms, list_sum(list_transform({_list(f" {f.replace(' ', '  ')} " for f in features.FILLERS)}, lambda f: {_FILL.format('t', 'f')}))::bigint as n from n)
 select run_id, seg_idx, n, round_even(n / ((end_ms - start_ms) / 60000), 2) as per_min from c""")  # fmt: skip
def a12_filler_counts(spark, d):
    s = Run(spark, d).segments.withColumn("n", features.filler_count(F.col("text")).cast("bigint"))
    return s.select("run_id", "seg_idx", "n", F.bround(F.col("n") / ((F.col("end_ms") - F.col("start_ms")) / 60000), 2).alias("per_min"))
