"""Per-second features from words, sound, shots, on-screen text and the structure of a run, as long tables (run_id, t, feature, value).

runs: run_id, duration_ms. segments: run_id, seg_idx, start_ms, end_ms, text. words: run_id, start_ms, end_ms. speech: run_id, start_ms,
end_ms. loudness: run_id, t_ms, lufs. Without its input a feature has no rows. All limits are relative to the run itself.
Tables of seconds are joined by sorting (hint "merge"): packed they look small, and would be sent whole through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_words, word_count
from tidemark.operators.features import adjacent_windows, clip, pulse, put, trailing_median
from tidemark.operators.findings import new_texts
from tidemark.operators.intervals import RUN, to_bins

REACH_MS = 10_000
# The floor of quiet, how far under usual speech it lies, and the share of a gap that must be quiet.
QUIET_DBFS, BELOW_SPEECH_DB, QUIET_SHARE = -45.0, 20.0, 0.6


def seconds(runs: DataFrame) -> DataFrame:
    """run_id, t, duration_ms for every second that a run touches."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / 1000)).cast("int")
    return runs.select(RUN, "duration_ms", F.explode(F.sequence(F.lit(0), n - 1)).alias("t"))


def feature(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(RUN, F.col("t").cast("int").alias("t"), F.lit(name).alias("feature"), value.cast("double").alias("value"))


def steady(df: DataFrame, flag: Column, least: int) -> DataFrame:
    """df's seconds at which flag holds for at least `least` seconds in a row."""
    x = df.where(flag).withColumn("_k", F.col("t") - F.row_number().over(Window.partitionBy(RUN).orderBy("t")))
    return x.withColumn("_n", F.count("*").over(Window.partitionBy(RUN, "_k"))).where(F.col("_n") >= least).drop("_k", "_n")


def window_novelty(runs: DataFrame, segments: DataFrame, least_words: int = 8) -> DataFrame:
    """run_id, t, novelty: share of the content words said within ten seconds of t that were not said before that stretch.

    Seconds that see the same segments share one count. Where these follow each other by number, a word counts in the segment that has no
    earlier one of the stretch with it: each segment keeps how many words it has, how many are new in the run, and where the others stood
    shortly before, so that no word is listed per stretch. Other stretches list their words.
    """
    first, last = F.floor((F.col("start_ms") - REACH_MS) / 1000) + 1, F.ceil((F.col("end_ms") + REACH_MS) / 1000) - 1
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / 1000)) - 1
    near = segments.join(runs, RUN).select(RUN, "seg_idx", F.greatest(F.lit(0), first).alias("a"), F.least(n, last).alias("b")).where("a <= b")
    near = near.select(RUN, "seg_idx", F.explode(F.sequence("a", "b")).alias("t"))
    seen = near.groupBy(RUN, "t").agg(F.min("seg_idx").alias("lo"), F.max("seg_idx").alias("hi"), F.count("*").alias("segs"))
    words = segments.select(RUN, "seg_idx", "start_ms", "end_ms", F.explode(content_words(F.col("text"))).alias("w"))
    w = Window.partitionBy(RUN, "w")
    told = words.withColumn("last", F.lag(F.struct("seg_idx", "end_ms")).over(w.orderBy("seg_idx")))
    # Two segments of a stretch are less than its length apart.
    close = F.when(F.col("start_ms") - F.col("last.end_ms") < 2 * REACH_MS, F.col("last.seg_idx"))
    told = told.groupBy(RUN, "seg_idx").agg(F.count("*").alias("n"), F.count_if(F.col("last").isNull()).alias("new"), F.collect_list(close).alias("before"))
    whole = F.col("hi") - F.col("lo") + 1 == F.col("segs")
    x = seen.where(whole).select(RUN, "lo", "hi").distinct().select(RUN, "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("seg_idx")).join(told.hint("merge"), [RUN, "seg_idx"])
    again = F.size(F.filter("before", lambda b: b >= F.col("lo")))
    x = x.groupBy(RUN, "lo", "hi").agg(F.sum(F.col("n") - again).alias("n"), F.sum("new").alias("new")).where(F.col("n") >= least_words)
    x = seen.where(whole).join(x.hint("merge"), [RUN, "lo", "hi"]).select(RUN, "t", "n", "new")
    rest = near.join(seen.where(~whole).select(RUN, "t").hint("merge"), [RUN, "t"]).groupBy(RUN, "t").agg(F.array_sort(F.collect_list("seg_idx")).alias("segs"))
    known = words.select(RUN, "seg_idx", "w", F.min("seg_idx").over(w).alias("first"))
    y = rest.select(RUN, "segs").distinct().select(RUN, "segs", F.explode("segs").alias("seg_idx")).join(known.hint("merge"), [RUN, "seg_idx"]).groupBy(RUN, "segs", "w").agg(F.first("first").alias("first"))
    y = y.groupBy(RUN, "segs").agg(F.count("*").alias("n"), F.count_if(F.col("first") >= F.element_at("segs", 1)).alias("new")).where(F.col("n") >= least_words)
    x = x.unionByName(rest.join(y.hint("merge"), [RUN, "segs"]).select(RUN, "t", "n", "new"))
    return x.select(RUN, F.col("t").cast("int").alias("t"), (F.col("new") / F.col("n")).alias("novelty"))


def low_novelty(runs: DataFrame, segments: DataFrame, share: float = 0.6, least_s: int = 10) -> DataFrame:
    """Stretches of least_s seconds, from 30 s on, whose novelty is under `share` of the run's median after the first minute (0.5 without one)."""
    x = window_novelty(runs, segments)
    mid = x.where("t >= 60").groupBy(RUN).agg(F.median("novelty").alias("mid"))
    x = x.join(mid, RUN, "left").withColumn("limit", share * F.coalesce("mid", F.lit(0.5)))
    return feature(steady(x, (F.col("t") >= 30) & (F.col("novelty") < F.col("limit")), least_s), "low_novelty", clip((F.col("limit") - F.col("novelty")) / F.col("limit")))


def local_pace(runs: DataFrame, words: DataFrame, least_words: int = 50) -> DataFrame:
    """run_id, t, wpm, usual: words per speaking minute within ten seconds of t (gaps between words count up to half a second), and the
    run's median; for runs of at least least_words words."""
    w = Window.partitionBy(RUN)
    timed = words.where("start_ms is not null")
    gap = F.greatest(F.lit(0), F.least(F.lit(500), F.lead("start_ms").over(w.orderBy("start_ms", "end_ms")) - F.col("end_ms")))
    timed = timed.select(RUN, F.floor(F.col("start_ms") / 1000).cast("int").alias("t"), F.struct("start_ms", "end_ms").alias("at"), (F.col("end_ms") - F.col("start_ms")).alias("len"), F.coalesce(gap, F.lit(0)).alias("gap"))
    said = timed.groupBy(RUN, "t").agg(F.count("*").alias("n"), F.sum(F.col("len") + F.col("gap")).alias("spoken"), F.max_by("gap", "at").alias("last"))
    # Every second up to the last word, even beyond the run's end: each second with words also makes those that follow it without, and the
    # first one those before it, so that nothing is joined by second.
    said = said.withColumns({"_words": F.sum("n").over(w), "_lead": F.lead("t").over(w.orderBy("t")), "_lag": F.lag("t").over(w.orderBy("t"))}).where(F.col("_words") >= least_words)
    said = said.join(runs.select(RUN, F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / 1000)).cast("int").alias("_n")), RUN)
    every = F.sequence(F.when(F.col("_lag").isNull(), F.least(F.lit(0), F.col("t"))).otherwise(F.col("t")), F.coalesce(F.col("_lead") - 1, F.greatest(F.col("_n") - 1, F.col("t"))))
    own = lambda c: F.when(F.col("t") == F.col("_t"), F.col(c)).alias(c)
    d = said.withColumn("_t", F.explode(every)).where("_t >= 0").select(RUN, "_n", F.col("_t").alias("t"), own("n"), own("spoken"), own("last"))
    # Sums around a second are differences of running sums; the last word's gap is the last one up to the frame's end.
    upto, ahead, behind = w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0), REACH_MS // 1000 - 1, REACH_MS // 1000 + 1
    d = d.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(upto) for c in ("n", "spoken")} | {"last": F.last("last", ignorenulls=True).over(upto)})
    around = lambda c: F.coalesce(F.lead(c, ahead).over(w.orderBy("t")), F.max_by(c, "t").over(w)) - F.lag(c, behind, 0).over(w.orderBy("t"))
    last = F.coalesce(F.lead("last", ahead).over(w.orderBy("t")), F.max_by("last", "t").over(w))
    x = d.select(RUN, "t", "_n", around("n").alias("n"), (around("spoken") - last).alias("speak")).where("t < _n")
    x = x.select(RUN, "t", F.when((F.col("speak") > 4000) & (F.col("n") >= 8), 60_000 * F.col("n") / F.col("speak")).alias("wpm")).where("wpm is not null")
    return x.withColumn("usual", F.median("wpm").over(w))


def pace(local: DataFrame) -> DataFrame:
    """slow_pace and fast_pace: under 0.8 and over 1.2 of the run's usual pace."""
    x, usual = F.col("wpm"), F.col("usual")
    slow, fast = x < 0.8 * usual, x > 1.2 * usual
    value = F.when(slow, clip((0.8 * usual - x) / (0.3 * usual))).otherwise(clip((x - 1.2 * usual) / (0.3 * usual)))
    out = local.where(slow | fast).select(RUN, F.col("t").cast("int").alias("t"), F.when(slow, "slow_pace").otherwise("fast_pace").alias("feature"), value.cast("double").alias("value"))
    return out


def quiet_share(gaps: DataFrame, rms: DataFrame, limit: DataFrame) -> DataFrame:
    """gaps with quiet: the share of their level measurements (run_id, t_ms, dbfs; null: digital silence) under the run's limit; null without any."""
    width = 10_000
    level = rms.select(RUN, "t_ms", F.coalesce("dbfs", F.lit(-120.0)).alias("_v"), F.floor(F.col("t_ms") / width).alias("bin"))
    inside = to_bins(gaps.select(RUN, "start_ms", "end_ms"), width).join(level.hint("merge"), [RUN, "bin"]).where((F.col("start_ms") <= F.col("t_ms")) & (F.col("t_ms") < F.col("end_ms"))).join(limit, RUN)
    q = inside.groupBy(RUN, "start_ms", "end_ms").agg(F.avg((F.col("_v") < F.col("limit")).cast("int")).alias("quiet"))
    return gaps.join(q.hint("merge"), [RUN, "start_ms", "end_ms"], "left")


def quiet_limit(runs: DataFrame, speech: DataFrame, rms: DataFrame) -> DataFrame:
    """run_id, limit: QUIET_DBFS, or if higher BELOW_SPEECH_DB under the upper median level of speech."""
    width = 10_000
    level = rms.where("dbfs is not null").withColumn("bin", F.floor(F.col("t_ms") / width))
    inside = to_bins(speech, width).join(level.hint("merge"), [RUN, "bin"]).where((F.col("start_ms") <= F.col("t_ms")) & (F.col("t_ms") < F.col("end_ms")))
    w = Window.partitionBy(RUN)
    x = inside.withColumns({"_i": F.row_number().over(w.orderBy("dbfs")), "_n": F.count("*").over(w)}).where(F.col("_i") == F.floor(F.col("_n") / 2) + 1)
    return runs.join(x.select(RUN, "dbfs"), RUN, "left").select(RUN, F.greatest(F.lit(QUIET_DBFS), F.coalesce(F.col("dbfs") - BELOW_SPEECH_DB, F.lit(QUIET_DBFS))).alias("limit"))


def pauses(runs: DataFrame, speech: DataFrame, silence: DataFrame, rms: DataFrame, least_ms: int = 2000, edge_ms: int = 1000) -> DataFrame:
    """run_id, start_ms, end_ms, source: gaps without speech whose level is quiet (or unknown) and measured silences, joined where they
    touch, without the first and last second of a run. Runs without any speech interval have no speech gaps."""
    ends = runs.join(speech.select(RUN).distinct(), RUN, "left_semi").select(RUN, F.col("duration_ms").alias("start_ms"), F.col("duration_ms").alias("end_ms"))
    w = Window.partitionBy(RUN).orderBy("start_ms", "end_ms")
    free = speech.select(RUN, "start_ms", "end_ms").unionByName(ends).select(RUN, F.lag("end_ms", 1, 0).over(w).alias("start_ms"), F.col("start_ms").alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    free = quiet_share(free, rms, quiet_limit(runs, speech, rms)).where(F.col("quiet").isNull() | (F.col("quiet") >= QUIET_SHARE))
    free = free.select(RUN, "start_ms", "end_ms", F.when(F.col("quiet").isNull(), "no speech").otherwise("no speech, quiet").alias("source"))
    both = free.unionByName(silence.where(F.col("end_ms") - F.col("start_ms") >= least_ms).select(RUN, "start_ms", "end_ms", F.lit("silence").alias("source")))
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_k", F.when(reach.isNull() | (F.col("start_ms") > reach), 1).otherwise(0)).withColumn("_k", F.sum("_k").over(w))
    out = both.groupBy(RUN, "_k").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.array_sort(F.collect_set("source")), " + ").alias("source")).drop("_k")
    return out.join(runs.select(RUN, "duration_ms"), RUN).where((F.col("start_ms") >= edge_ms) & (F.col("end_ms") <= F.col("duration_ms") - edge_ms)).drop("duration_ms")


def dead_air(runs: DataFrame, quiet: DataFrame) -> DataFrame:
    return put(runs, quiet, "dead_air", F.lit(1.0))


# Least setup after the hook, and how late (and after which share of the run) a payoff counts as delayed.
SETUP_MS, PAYOFF_MS, PAYOFF_SHARE = 15_000, 45_000, 0.20


def setup(runs: DataFrame, structure: DataFrame) -> DataFrame:
    """setup_before_substance: from the hook's end to the first point, where that takes more than SETUP_MS. structure: run_id, hook_ms,
    hook_end_ms, first_substance_ms."""
    s = structure.where("first_substance_ms > 0").select(RUN, F.least("first_substance_ms", F.coalesce("hook_end_ms", F.lit(0))).alias("start_ms"), F.col("first_substance_ms").alias("end_ms"))
    return put(runs, s.where(F.col("end_ms") - F.col("start_ms") > SETUP_MS), "setup_before_substance", F.lit(1.0))


def no_hook(runs: DataFrame, structure: DataFrame) -> DataFrame:
    """no_hook_yet: the first half minute up to the hook; runs with a structure only."""
    s = structure.select(RUN, F.lit(0).cast("bigint").alias("start_ms"), F.least(F.lit(30_000), F.coalesce("hook_ms", F.lit(30_000))).cast("bigint").alias("end_ms"))
    return put(runs, s, "no_hook_yet", F.lit(1.0))


def delayed(p: Column, first: Column, duration: Column) -> Column:
    return p.isin("fulfilled", "partial") & (first > PAYOFF_MS) & (first > PAYOFF_SHARE * duration)


def payoff_pending(runs: DataFrame, promises: DataFrame) -> DataFrame:
    """A ramp from 15 s on until a delayed payoff; 0.5 after a minute for promises that are unaddressed or uncertain. promises: run_id,
    promise, status, first_fulfil_ms."""
    p = promises.join(runs, RUN)
    n = F.ceil(F.col("duration_ms") / 1000).cast("int")
    late, open_ = delayed(F.col("status"), F.col("first_fulfil_ms"), F.col("duration_ms")), F.col("status").isin("unaddressed", "uncertain")
    first, last = F.when(late, 15).when(open_, 60), F.when(late, F.least(n, F.floor(F.col("first_fulfil_ms") / 1000).cast("int"))).otherwise(n) - 1
    x = p.select(RUN, late.alias("late"), first.alias("a"), last.alias("b")).where("a <= b").select(RUN, "late", F.explode(F.sequence("a", "b")).alias("t"))
    x = x.groupBy(RUN, "t").agg(F.max(F.when(F.col("late"), clip((F.col("t") - 15) / 60)).otherwise(0.5)).alias("value"))
    return feature(x, "payoff_pending", F.col("value"))


def near_end(start: Column, duration: Column) -> Column:
    return (start >= duration - 45_000) | (start >= 0.85 * duration)


def interruptions(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """cta_or_sponsor and outro: requests and sponsors within the run, and its ending from there on. spans: run_id, kind, start_ms, end_ms."""
    s = spans.join(runs, RUN)
    end, ask = near_end(F.col("start_ms"), F.col("duration_ms")), F.col("kind").isin("cta", "sponsor")
    mid = s.where(ask & ~end).select(RUN, "start_ms", "end_ms")
    # Of those that last to the end of the run the first covers all others.
    tail = s.where((F.col("kind") == "outro") | ((F.col("kind") == "recap") & end)).groupBy(RUN).agg(F.min("start_ms").alias("start_ms"), F.max("duration_ms").alias("end_ms"))
    out = s.where(ask & end).select(RUN, "start_ms", "end_ms").unionByName(tail)
    return put(runs, mid, "cta_or_sponsor", F.lit(1.0)).unionByName(put(runs, out, "outro", F.lit(1.0)))


def readable(tracks: DataFrame, least_confidence: float = 0.5, least_length: int = 3) -> DataFrame:
    """On-screen texts (run_id, start_ms, end_ms, text, confidence) that are sure and long enough."""
    return tracks.where((F.coalesce("confidence", F.lit(0.0)) >= least_confidence) & (F.length(F.trim("text")) >= least_length))


def new_onscreen_text(runs: DataFrame, tracks: DataFrame) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    new = new_texts(readable(tracks), key).where("is_new").select(RUN, F.col("start_ms").alias("at_ms"))
    return pulse(runs, new, "new_onscreen_text", 3)


def dense_text(tracks: DataFrame, local: DataFrame, least_words: int = 12) -> DataFrame:
    """dense_text_fast_speech: least_words words on screen at mid-second while speech is over 1.1 of its usual pace."""
    x = readable(tracks).withColumn("_n", word_count(F.col("text")))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("start_ms") - 500) / 1000)), F.ceil((F.col("end_ms") - 500) / 1000) - 1
    x = x.select(RUN, "_n", first.cast("int").alias("a"), last.cast("int").alias("b")).where("a <= b").select(RUN, "_n", F.explode(F.sequence("a", "b")).alias("t"))
    fast = local.where(F.col("wpm") > 1.1 * F.col("usual")).select(RUN, F.lit(None).cast("int").alias("_n"), F.col("t").cast("int").alias("t"), F.lit(1).alias("_fast"))
    # A second is of one side, or of both: counted together, where both lie by run already.
    x = x.select("*", F.lit(None).cast("int").alias("_fast")).unionByName(fast).groupBy(RUN, "t").agg(F.sum("_n").alias("n"), F.max("_fast").alias("_fast"))
    x = x.where((F.col("n") >= least_words) & F.col("_fast").isNotNull())
    return feature(x, "dense_text_fast_speech", clip(F.col("n") / 24))


def levels(runs: DataFrame, loudness: DataFrame, speech: DataFrame, least: int = 20) -> DataFrame:
    """run_id, t, lufs, speaks, usual: loudness per second and the run's median while someone speaks (above -60), from `least` values on."""
    loud = loudness.where("lufs is not null").select(RUN, F.floor(F.col("t_ms") / 1000).cast("int").alias("t"), "lufs")
    said = to_bins(speech, 1000).select(RUN, F.col("bin").cast("int").alias("t")).distinct().withColumn("speaks", F.lit(True))
    x = seconds(runs).select(RUN, "t").join(loud.hint("merge"), [RUN, "t"], "left").join(said.hint("merge"), [RUN, "t"], "left").fillna(False, ["speaks"])
    spoken = F.when(F.col("speaks") & (F.col("lufs") > -60), F.col("lufs"))
    w = Window.partitionBy(RUN)
    return x.withColumns({"usual": F.median(spoken).over(w), "_n": F.count(spoken).over(w)}).where(F.col("_n") >= least).drop("_n")


def loudness_drop(level: DataFrame, quiet: DataFrame, db: float = 10.0, least_s: int = 3) -> DataFrame:
    """Seconds of speech `db` or more under the median of the ten seconds of speech before, three in a row, outside dead air (quiet: run_id, t)."""
    x = trailing_median(level.drop("usual"), F.when(F.col("speaks"), F.col("lufs")), out="before").join(quiet.select(RUN, "t").distinct().withColumn("_q", F.lit(True)).hint("merge"), [RUN, "t"], "left")
    low = F.col("speaks") & F.col("_q").isNull() & (F.col("lufs") <= F.col("before") - db)
    return feature(steady(x, low, least_s), "loudness_drop", F.lit(1.0))


def energy_lift(level: DataFrame, db: float = 4.0, least_s: int = 3) -> DataFrame:
    return feature(steady(level, F.col("speaks") & (F.col("lufs") >= F.col("usual") + db), least_s), "energy_lift", F.lit(1.0))


def flat_windows(level: DataFrame, pitch: DataFrame, least: int = 4) -> DataFrame:
    """Voiced pitch windows (run_id, start_ms, end_ms, pitch_std_hz, voiced) with flat: little variation for the run, and quieter than usual."""
    w = Window.partitionBy(RUN)
    v = pitch.where(F.col("pitch_std_hz").isNotNull() & (F.coalesce("voiced", F.lit(0.0)) >= 0.3)).withColumns({"_n": F.count("*").over(w), "_mid": F.median("pitch_std_hz").over(w)}).where(F.col("_n") >= least)
    inside = to_bins(v.select(RUN, "start_ms", "end_ms"), 1000).withColumn("t", F.col("bin").cast("int")).join(level.hint("merge"), [RUN, "t"])
    loud = inside.groupBy(RUN, "start_ms", "end_ms").agg((F.avg("lufs") < F.first("usual") - 3).alias("quiet"))
    x = v.join(loud.hint("merge"), [RUN, "start_ms", "end_ms"]).withColumn("flat", (F.col("pitch_std_hz") < 0.6 * F.col("_mid")) & F.coalesce("quiet", F.lit(False)))
    return x.drop("_n", "_mid", "quiet")


def flat_low_energy(level: DataFrame, pitch: DataFrame) -> DataFrame:
    """Two or more flat windows, each of which starts where the one before ends."""
    x = adjacent_windows(flat_windows(level, pitch), F.col("flat"))
    x = x.select(RUN, F.explode(F.sequence(F.floor(F.col("start_ms") / 1000), F.ceil(F.col("end_ms") / 1000) - 1)).alias("t")).distinct()
    return feature(x.join(level.select(RUN, "t").hint("merge"), [RUN, "t"], "left_semi"), "flat_low_energy", F.lit(1.0))


def micro_variation(runs: DataFrame, local: DataFrame, loudness: DataFrame, cuts: DataFrame) -> DataFrame:
    """micro_slowdown and micro_pickup: per second the mean of pace, loudness and cut timing against the run's own norm, each in [-1, 1], as a
    five-second mean; small ones are left out. cuts: run_id, at_ms."""
    unit = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    a = local.select(RUN, "t", unit((F.col("usual") - F.col("wpm")) / F.col("usual")).alias("c"))
    mid = F.median("lufs").over(Window.partitionBy(RUN))
    b = loudness.where("lufs is not null").select(RUN, (F.floor(F.col("t_ms") / 1000) - 1).cast("int").alias("t"), unit((mid - F.col("lufs")) / 6.0).alias("c")).where("t >= 0")
    cut = cuts.select(RUN, F.floor(F.col("at_ms") / 1000).cast("int").alias("t"), F.lit(1).alias("cut"))
    every = seconds(runs).select(RUN, "t")
    grid = every.join(cut.select(RUN).distinct(), RUN, "left_semi").select(RUN, "t", F.lit(None).cast("int").alias("cut")).unionByName(cut)
    mark = F.when(F.col("cut") == 1, F.col("t"))
    w = Window.partitionBy(RUN).orderBy("t")
    back = Window.partitionBy(RUN).orderBy(F.desc("t"))
    last, nxt = F.max(mark).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.min(mark).over(back.rangeBetween(Window.unboundedPreceding, -1))
    far = F.lit(10**9)
    since, until = F.coalesce(F.col("t") - last, far), F.coalesce(nxt - F.col("t"), far)
    c = grid.withColumns({"_since": since, "_until": until}).where("cut is null").select(RUN, "t", F.when(F.least("_since", "_until") <= 2, -0.6).when(F.col("_since") >= 8, 0.3).otherwise(0.0).alias("c"))
    raw = a.unionByName(b).unionByName(c).groupBy(RUN, "t").agg(F.avg("c").alias("raw"))
    x = every.join(raw.hint("merge"), [RUN, "t"], "left").withColumn("v", F.avg(F.coalesce("raw", F.lit(0.0))).over(w.rowsBetween(-2, 2)))
    slow = feature(x.where("v >= 0.02"), "micro_slowdown", F.bround(F.least(F.lit(1.0), F.col("v")), 4))
    return slow.unionByName(feature(x.where("v <= -0.02"), "micro_pickup", F.bround(F.least(F.lit(1.0), -F.col("v")), 4)))
