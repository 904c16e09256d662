"""Selections, small sets and rollups over the records of runs, and logs read as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_runs, word_count
from tidemark.operators.intervals import RUN, dealt, overlap_join, to_bins

# Statuses that end a job, the least length of scripts (words, seconds) and the range of recordings (seconds).
ENDED = ("complete", "partial", "failed", "cancelled")
SCRIPT_WORDS, SCRIPT_S, RECORDING_S = 20, (10, 3600), (300, 900)


def sliced(rows: DataFrame, a: int, b: int) -> DataFrame:
    """Rows that touch [a, b)."""
    return rows.where((F.col("start_ms") < b) & (F.col("end_ms") > a))


def chosen(issues: DataFrame, tag: str | None = None, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Issues (tags array, type, review_status) that fit what is asked for."""
    out = issues
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if kind is not None:
        out = out.where(F.col("type") == kind)
    return out if status is None else out.where(F.col("review_status") == status)


def plausible(segments: DataFrame, least_words: int = 6, most_per_s: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): segments of least_words words or more that are spoken faster than most_per_s words a second are dropped."""
    n = word_count(F.col("text"))
    fast = (n >= least_words) & (n / F.greatest(F.lit(0.001), (F.col("end_ms") - F.col("start_ms")) / 1000) > most_per_s)
    return segments.where(~fast), segments.where(fast)


def scope(runs: DataFrame) -> DataFrame:
    """runs (run_id, kind, duration_ms, n_words) with the reason why they are out of scope, or none."""
    s = F.col("duration_ms") / 1000
    reason = F.when((F.col("kind") == "script") & (F.col("n_words") < SCRIPT_WORDS), "too few words").when((F.col("kind") == "script") & ~s.between(*SCRIPT_S), "script length").when((F.col("kind") == "recording") & ~s.between(*RECORDING_S), "recording length")
    return runs.withColumn("reason", reason)


def citations(rows: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped per run): citations that start inside their run, a second long at least, ended with it."""
    x = rows.join(runs.select(RUN, "duration_ms"), RUN)
    good = (F.col("start_ms") >= 0) & (F.col("start_ms") < F.col("duration_ms"))
    kept = x.where(good).withColumn("end_ms", F.least(F.greatest("end_ms", F.col("start_ms") + 1000), "duration_ms")).drop("duration_ms")
    return kept, x.groupBy(RUN).agg(F.count_if(~good).alias("dropped"))


def found(rows: DataFrame, column: str, words: str) -> DataFrame:
    """Rows whose column holds the words, whatever their case."""
    return rows.where(F.contains(F.lower(F.col(column)), F.lit(words.lower())))


def newest(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The newest rows of each key (order: newest last, ids to break ties)."""
    by = [F.desc(c) for c in order]
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_k") <= most).drop("_k")


def word_sets(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    """pairs with what two arrays of words share, what only the first has, and all."""
    return pairs.withColumns({"shared": F.array_sort(F.array_intersect(a, b)), "only_first": F.array_sort(F.array_except(a, b)), "either": F.array_sort(F.array_union(a, b))})


def unknown(given: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids (run_id, key) that were given but are not known."""
    return given.select(RUN, key).distinct().join(known.select(RUN, key), [RUN, key], "left_anti")


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_millis(b.cast("timestamp")) - F.unix_millis(a.cast("timestamp"))) / 1000


def box_of(quad: Column) -> Column:
    """The upright box around four points (arrays of x and y): struct<x0, y0, x1, y1>."""
    x, y = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    return F.struct(F.array_min(x).alias("x0"), F.array_min(y).alias("y0"), F.array_max(x).alias("x1"), F.array_max(y).alias("y1"))


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area of two boxes over the area of both."""
    side = lambda p, q, r, s: F.greatest(F.lit(0.0), F.least(q, s) - F.greatest(p, r))
    both = side(a.x0, a.x1, b.x0, b.x1) * side(a.y0, a.y1, b.y0, b.y1)
    area = lambda v: (v.x1 - v.x0) * (v.y1 - v.y0)
    either = area(a) + area(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def box_zone(box: Column) -> Column:
    """Which of nine zones of a unit picture the middle of a box lies in."""
    third = lambda v, names: F.when(v < 1 / 3, names[0]).when(v < 2 / 3, names[1]).otherwise(names[2])
    return F.concat_ws("-", third((box.y0 + box.y1) / 2, ("top", "middle", "bottom")), third((box.x0 + box.x1) / 2, ("left", "centre", "right")))


def edit_effect(operation: Column, start: Column, end: Column, destination: Column) -> Column:
    """Seconds that an edit removes, or brings earlier (later: negative); null where that is unknown."""
    return F.when(operation == "cut", (end - start) / 1000).when((operation == "move") & destination.isNotNull(), (start - destination) / 1000)


def shot_metrics(shots: DataFrame, samples: DataFrame) -> DataFrame:
    """shots with mean and largest motion (a shot's first sample, which shows the cut, left out) and mean brightness. samples: run_id, at_ms,
    motion, brightness."""
    x = to_bins(shots.select(RUN, "shot", "start_ms", "end_ms"), 30_000).join(samples.withColumn("bin", F.floor(F.col("at_ms") / 30_000)), [RUN, "bin"]).where("start_ms <= at_ms and at_ms < end_ms")
    x = x.withColumn("_nth", F.row_number().over(Window.partitionBy(RUN, "shot").orderBy("at_ms")))
    m = F.when(F.col("_nth") > 1, F.col("motion"))
    return shots.join(x.groupBy(RUN, "shot").agg(F.avg(m).alias("motion_mean"), F.max(m).alias("motion_max"), F.avg("brightness").alias("brightness_mean")), [RUN, "shot"], "left")


def sample_windows(samples: DataFrame, width: int, full: float = 0.999) -> DataFrame:
    """run_id, win, clipped (share at full scale), rms_db (null: silence), peak, per `width` samples. samples: run_id, i, x."""
    rms = F.sqrt(F.avg(F.col("x") * F.col("x")))
    g = samples.groupBy(RUN, F.floor(F.col("i") / width).alias("win")).agg(F.avg((F.abs("x") >= full).cast("int")).alias("clipped"), rms.alias("_r"), F.max(F.abs("x")).alias("peak"))
    return g.select(RUN, "win", "clipped", F.when(F.col("_r") > 0, 20 * F.log10("_r")).alias("rms_db"), "peak")


def silent_runs(runs: DataFrame, silence: DataFrame, share: float = 0.98) -> DataFrame:
    """runs with silent: measured silence fills at least `share` of the run."""
    s = silence.groupBy(RUN).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_s"))
    return runs.join(s, RUN, "left").withColumn("silent", F.coalesce("_s", F.lit(0)) >= share * F.col("duration_ms")).drop("_s")


def speech_rates(groups: DataFrame, words: DataFrame, gap_ms: int = 500, least: int = 10, aligned: float = 0.9) -> DataFrame:
    """run_id, part, wpm, precision, usual: words a minute of each group of segments (run_id, part, start_ms, end_ms, n_words), over speaking
    time (word times and gaps under gap_ms) where enough words are timed, else over the group's own time; and the run's upper median."""
    w = Window.partitionBy(RUN, "part").orderBy("start_ms", "end_ms")
    t = words.where("start_ms is not null")
    gap = F.lead("start_ms").over(w) - F.col("end_ms")
    t = t.withColumn("_ms", F.col("end_ms") - F.col("start_ms") + F.when((gap > 0) & (gap < gap_ms), gap).otherwise(0))
    said = t.groupBy(RUN, "part").agg(F.sum("_ms").alias("_speak"), F.count("*").alias("_timed"))
    x = groups.join(said, [RUN, "part"], "left").join(words.groupBy(RUN, "part").agg(F.count("*").alias("_all")), [RUN, "part"], "left")
    exact = F.coalesce((F.col("_timed") / F.col("_all") >= aligned) & (F.col("_timed") >= least), F.lit(False))
    minutes = F.when(exact, F.col("_speak")).otherwise(F.col("end_ms") - F.col("start_ms")) / 60_000
    x = x.withColumn("_m", minutes).where("_m > 0.15").select(RUN, "part", F.bround(F.when(exact, F.col("_timed")).otherwise(F.col("n_words")) / F.col("_m"), 0).cast("int").alias("wpm"), F.when(exact, "word").otherwise("segment").alias("precision"))
    v = Window.partitionBy(RUN)
    mid = x.withColumns({"_i": F.row_number().over(v.orderBy("wpm")), "_n": F.count("*").over(v)}).where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(RUN, F.col("wpm").alias("usual"))
    return x.join(mid, RUN)


def workflow_state(stages: DataFrame) -> DataFrame:
    """run_id, state of all stages (status) together: failed before running before partial before complete; empty without any."""
    has = lambda *s: F.max(F.col("status").isin(*s))
    return stages.groupBy(RUN).agg(F.when(has("failed"), "failed").when(has("running", "pending"), "running").when(has("partial"), "partial").otherwise("complete").alias("state"))


def still_texts(texts: DataFrame) -> DataFrame:
    """run_id, still, confidence (the least), texts (distinct, in order) of the on-screen texts of each still."""
    return texts.groupBy(RUN, "still").agg(F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("text")).alias("texts"))


def not_inspected(issues: DataFrame, coverage: DataFrame, least: float = 0.999) -> DataFrame:
    """run_id, issue_id, tracks that are not covered whole in some bin under the issue. coverage: run_id, track, start_ms, end_ms, coverage."""
    x = overlap_join(issues.select(RUN, "issue_id", "start_ms", "end_ms"), coverage.where(F.col("coverage") < least).select(RUN, "track", "start_ms", "end_ms"), 30_000)
    return x.groupBy(RUN, "issue_id").agg(F.array_sort(F.collect_set("track")).alias("tracks"))


def decode_gaps(frames: DataFrame, times: float = 3.0, least_ms: int = 250) -> DataFrame:
    """run_id, start_ms, end_ms of steps between frames (run_id, at_ms) over `times` the run's upper median step and over least_ms."""
    step = F.col("end_ms") - F.col("start_ms")
    x = frames.select(RUN, F.lag("at_ms").over(Window.partitionBy(RUN).orderBy("at_ms")).alias("start_ms"), F.col("at_ms").alias("end_ms")).where("start_ms is not null").withColumn("step", step)
    v = Window.partitionBy(RUN)
    mid = x.withColumns({"_i": F.row_number().over(v.orderBy("step")), "_n": F.count("*").over(v)}).where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(RUN, F.col("step").alias("_mid"))
    return x.join(mid, RUN).where((F.col("step") > times * F.col("_mid")) & (F.col("step") > least_ms)).select(RUN, "start_ms", "end_ms")


def repeated_runs(pairs: DataFrame, segments: DataFrame, share: float = 0.5, least: int = 2) -> DataFrame:
    """run_id, earlier, later, first, last: the longest run (ties: the first) of the later paragraph's segments whose runs of three content words
    mostly occur in the earlier paragraph. pairs: run_id, earlier, later; segments carry their paragraph.

    Texts meet by pair of paragraphs, and their runs of words are made there: these, many times the text, are not moved. A row holds two paragraphs."""
    keys = [RUN, "earlier", "later"]
    p = pairs.select(*keys).distinct()
    sides = p.select(RUN, F.col("later").alias("paragraph"), F.struct("earlier", "later", F.lit(False).alias("old")).alias("p")).unionByName(p.select(RUN, F.col("earlier").alias("paragraph"), F.struct("earlier", "later", F.lit(True).alias("old")).alias("p")))
    d = segments.select(RUN, "paragraph", "seg_idx", "text").join(sides.groupBy(RUN, "paragraph").agg(F.collect_list("p").alias("ps")), [RUN, "paragraph"]).select(RUN, "seg_idx", "text", F.inline("ps"))
    d = d.groupBy(*keys).agg(F.collect_list(F.when(F.col("old"), F.col("text"))).alias("olds"), F.collect_list(F.when(~F.col("old"), F.struct("seg_idx", "text"))).alias("news"))
    d = d.select(*keys, F.array_distinct(F.flatten(F.transform("olds", content_runs))).alias("had"), "news").select(*keys, "had", F.inline("news")).withColumn("g", content_runs(F.col("text")))
    # A segment number that comes twice is one segment.
    x = d.groupBy(*keys, "seg_idx").agg((F.sum(F.size(F.array_intersect("g", "had"))) / F.nullif(F.sum(F.size("g")), F.lit(0))).alias("_s")).where(F.col("_s") >= share)
    x = x.withColumn("_k", F.col("seg_idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("seg_idx")))
    x = x.groupBy(*keys, "_k").agg(F.min("seg_idx").alias("first"), F.max("seg_idx").alias("last"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return x.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), "first", "last")).alias("b")).select(*keys, "b.first", "b.last")


def inherited_causes(issues: DataFrame) -> DataFrame:
    """issues with cause_group taken from the issue before of their type, for as long as each starts before the end of the one before it."""
    w = Window.partitionBy(RUN, "type").orderBy("start_ms", "issue_id")
    new = F.when(F.col("start_ms") < F.lag("end_ms").over(w), 0).otherwise(1)
    x = issues.withColumn("_k", new).withColumn("_k", F.sum("_k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("cause_group", F.first("cause_group").over(Window.partitionBy(RUN, "type", "_k").orderBy("start_ms", "issue_id"))).drop("_k")


def sampling_plan(runs: DataFrame, frames: DataFrame, cuts: DataFrame, most: int = 2000) -> DataFrame:
    """run_id, at_ms, reasons: the frame shown at each second, and the frames on both sides of each cut; at most `most`, cuts first.

    frames and cuts: run_id, at_ms. One sort per run finds the frames on either side.
    """
    ticks = runs.select(RUN, F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / 1000)) - 1)).alias("t"))
    # At one time a cut stands before the frame, a second behind it: rows before and after are then what the cut and the second ask for.
    both = cuts.select(RUN, "at_ms", F.lit(0).alias("side")).unionByName(frames.select(RUN, "at_ms", F.lit(1).alias("side"))).unionByName(ticks.select(RUN, (F.col("t") * 1000).alias("at_ms"), F.lit(2).alias("side")))
    both = dealt(both, RUN, times=4).withColumn("shown", F.when(F.col("side") == 1, F.col("at_ms")))
    before = F.last("shown", ignorenulls=True).over(Window.partitionBy(RUN).orderBy("at_ms", "side").rowsBetween(Window.unboundedPreceding, 0))
    # Spark scans a frame up to the partition's end anew for each row; lead() goes on from row to row.
    after = F.expr(f"lead(shown) ignore nulls over (partition by {RUN} order by at_ms, side)")
    x = both.withColumns({"_before": before, "_after": after}).where("side <> 1")
    grid = F.col("side") == 2
    picks = F.array(F.struct(F.col("_before").alias("at_ms"), F.when(grid, 2).otherwise(1).alias("p")), F.struct(F.when(~grid, F.col("_after")).alias("at_ms"), F.lit(0).alias("p")))
    is_ = lambda p: F.max(F.col("p") == p)
    x = x.select(RUN, F.inline(picks)).where("at_ms is not null").groupBy(RUN, "at_ms").agg(F.min("p").alias("p"), is_(0).alias("_0"), is_(1).alias("_1"), is_(2).alias("_2"))
    x = x.withColumn("reasons", F.array_compact(F.array(*[F.when(F.col(f"_{p}"), F.lit(why)) for p, why in enumerate(("after cut", "before cut", "grid"))]))).drop("_0", "_1", "_2")
    if most >= 2**31 - 1:
        return x.drop("p")
    return x.withColumn("_k", F.row_number().over(Window.partitionBy(RUN).orderBy("p", "at_ms"))).where(F.col("_k") <= most).drop("_k", "p")


def snapped(spans: DataFrame, words: DataFrame, reach_ms: int = 15_000) -> DataFrame:
    """spans (run_id, span, start_ms, end_ms) moved to sentence ends by word times (run_id, start_ms, end_ms, text): the start back to the word
    after the sentence end before it, the end on to the next sentence end within reach_ms, or back to the last word inside. Spans of runs
    without words stay."""
    ends = F.rtrim(F.regexp_replace("text", r"[\"')”]+$", "")).rlike(r"[.?!]$")
    t = words.where("start_ms is not null").select(RUN, F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), ends.alias("e"))
    none = lambda k, n: F.lit(None).cast(k).alias(n)
    ask = lambda c, side: spans.select(RUN, F.col(c).alias("a"), none("bigint", "b"), none("boolean", "e"), "span", F.lit(side).alias("side"))
    both = t.select(RUN, "a", "b", "e", none(dict(spans.dtypes)["span"], "span"), none("string", "side")).unionByName(ask("start_ms", "start")).unionByName(ask("end_ms", "end"))
    # An asked time stands before the words of that time, so one sort serves all.
    both = dealt(both, RUN, times=4).withColumn("at", F.when(F.col("side").isNull(), 1).otherwise(0))
    o = Window.partitionBy(RUN).orderBy("a", "at", "b")
    upto, is_word = o.rowsBetween(Window.unboundedPreceding, 0), F.col("side").isNull()
    new = is_word & F.coalesce(F.last("e", ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    # Of each word the start of its sentence.
    both = both.withColumn("new", new).withColumn("s", F.last(F.when(F.col("new"), F.col("a")), ignorenulls=True).over(upto))
    both = both.withColumns({"word": F.when(is_word, F.struct("a", "b", "e", "s")), "ended": F.when(is_word & F.col("e"), F.struct("a", "b"))})
    # Spark scans a frame up to the partition's end anew for each row; lead() goes on from row to row.
    later = lambda c: F.expr(f"lead({c}) ignore nulls over (partition by {RUN} order by a, at, b)")
    x = both.withColumns({"prev": F.last("word", ignorenulls=True).over(upto), "next": later("word"), "stop": later("ended")}).where("side is not null")
    one = lambda side: x.where(F.col("side") == side).select(RUN, "span", F.col("prev").alias(f"p_{side}"), F.col("next").alias(f"n_{side}"), F.col("stop").alias(f"e_{side}"))
    y = spans.join(one("start"), [RUN, "span"]).join(one("end"), [RUN, "span"])
    start = F.when(F.col("p_start").isNotNull() & ~F.col("p_start.e"), F.col("p_start.s")).when(F.col("n_start").isNotNull(), F.col("n_start.a")).otherwise(F.col("start_ms"))
    y = y.withColumn("_a", start)
    inside = F.col("p_end").isNotNull() & (F.col("p_end.a") >= F.col("_a"))
    end = F.when(inside & F.col("p_end.e"), F.col("p_end.b")).when(inside & (F.col("e_end.b") - F.col("end_ms") <= reach_ms), F.col("e_end.b")).otherwise(F.col("end_ms"))
    return y.withColumn("end_ms", end).withColumn("start_ms", F.col("_a")).select(RUN, "span", "start_ms", "end_ms")


def with_fallback(lexical: DataFrame, dense: DataFrame, passages: DataFrame) -> DataFrame:
    """run_id, query_id, usable, reason: whether dense scores (run_id, query_id, passage, score) cover all passages of their run with finite
    numbers; where not, search goes by the lexical ones alone."""
    n = passages.groupBy(RUN).agg(F.count("*").alias("_n"))
    ok = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    d = dense.groupBy(RUN, "query_id").agg(F.count_if(ok).alias("_ok"), F.count("*").alias("_d"))
    x = lexical.select(RUN, "query_id").distinct().join(n, RUN).join(d, [RUN, "query_id"], "left")
    reason = F.when(F.col("_d").isNull(), "no dense scores").when(F.col("_d") != F.col("_n"), "wrong number of scores").when(F.col("_ok") != F.col("_n"), "invalid scores")
    return x.withColumn("reason", reason).select(RUN, "query_id", F.col("reason").isNull().alias("usable"), "reason")


def around(rows: DataFrame, selections: DataFrame, reach_ms: int = 20_000) -> DataFrame:
    """Rows near a selection (run_id, selection, start_ms, end_ms), with `inside` for those that touch it."""
    wide = selections.select(RUN, "selection", F.col("start_ms").alias("sel_start"), F.col("end_ms").alias("sel_end"), (F.col("start_ms") - reach_ms).alias("start_ms"), (F.col("end_ms") + reach_ms).alias("end_ms"))
    x = overlap_join(wide, rows, 60_000)
    return x.withColumn("inside", (F.col("right_start") < F.col("sel_end")) & (F.col("right_end") > F.col("sel_start"))).drop("start_ms", "end_ms", "sel_start", "sel_end")


def containment_rank(rows: DataFrame, queries: DataFrame, row_id: str) -> DataFrame:
    """run_id, query_id, row_id, hits, rank: rows (with text) by how many of a query's words they hold; those with none left out."""
    q = queries.select(RUN, "query_id", F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("_w"))
    x = rows.join(q, RUN).withColumn("hits", F.size(F.filter("_w", lambda w: F.contains(F.lower(F.col("text")), w)))).where("hits > 0")
    return x.select(RUN, "query_id", row_id, "hits", F.row_number().over(Window.partitionBy(RUN, "query_id").orderBy(F.desc("hits"), row_id)).alias("rank"))


def progress(lines: DataFrame, prefix: str = "PROGRESS ", tail: int = 25) -> tuple[DataFrame, DataFrame]:
    """(latest, tails): the newest progress record of each job (lines: job, n, line; JSON after the prefix), and its last other lines."""
    told = F.startswith(F.col("line"), F.lit(prefix))
    p = lines.where(told).withColumn("record", F.substring("line", len(prefix) + 1, 1 << 20)).groupBy("job").agg(F.max_by("record", "n").alias("record"))
    rest = lines.where(~told).withColumn("_k", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("n")))).where(F.col("_k") <= tail)
    return p, rest.drop("_k")


def interrupted(jobs: DataFrame) -> DataFrame:
    """jobs with the unended ones failed, as after a restart."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*ENDED), F.col("status")).otherwise("failed"))


def uncached(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """hash, text of distinct texts whose score the cache (hash) does not have."""
    return texts.select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")


def paired_log(lines: DataFrame, start: str, end: str, runs: DataFrame) -> DataFrame:
    """run_id, start_ms, end_ms, open: starts and ends logged in seconds (lines: run_id, n, line), paired in order; the last may stay open until
    the run's end."""
    at = lambda p: F.regexp_extract("line", rf"{p}:\s*(-?[0-9.]+)", 1)
    x = lines.select(RUN, "n", F.explode(F.array(F.struct(F.lit("a").alias("side"), at(start).alias("v")), F.struct(F.lit("b").alias("side"), at(end).alias("v")))).alias("p")).select(RUN, "n", "p.side", "p.v").where("v != ''")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy(RUN, "side").orderBy("n")))
    ms = F.round(F.col("v").cast("double") * 1000).cast("bigint")
    p = x.groupBy(RUN, "k").agg(F.max(F.when(F.col("side") == "a", ms)).alias("a"), F.max(F.when(F.col("side") == "b", ms)).alias("b")).where("a is not null").join(runs.select(RUN, "duration_ms"), RUN)
    out = p.select(RUN, F.greatest(F.lit(0), "a").alias("start_ms"), F.least(F.coalesce("b", "duration_ms"), "duration_ms").alias("end_ms"), F.col("b").isNull().alias("open"))
    return out.where("end_ms > start_ms")


def loudness_log(lines: DataFrame) -> DataFrame:
    """run_id, t_ms, lufs: one logged short-term loudness a second (the line nearest after it, within a tenth)."""
    t = F.regexp_extract("line", r"t:\s*([0-9.]+)", 1).try_cast("double")
    v = F.regexp_extract("line", r"S:\s*(-?[0-9.]+)", 1).try_cast("double")
    x = lines.select(RUN, F.round(t * 1000).cast("bigint").alias("t_ms"), v.alias("lufs")).where("t_ms is not null and lufs is not null")
    return x.where(F.col("t_ms") % 1000 < 100)


def pasted_captions(lines: DataFrame) -> DataFrame:
    """run_id, start_ms, text of pasted captions: a time on a line of its own, its text on the next; other lines are titles and left out."""
    w = Window.partitionBy(RUN).orderBy("n")
    time = F.regexp_extract(F.trim(F.lag("line").over(w)), r"^(?:(\d+):)?(\d+):(\d\d)$", 0)
    part = lambda i: F.coalesce(F.regexp_extract("time", r"^(?:(\d+):)?(\d+):(\d\d)$", i).try_cast("bigint"), F.lit(0))
    x = lines.withColumn("time", time).where("time != ''")
    return x.select(RUN, ((part(1) * 3600 + part(2) * 60 + part(3)) * 1000).alias("start_ms"), F.trim("line").alias("text"))


def searched(projects: DataFrame, words: str, statuses: list[str] | None = None) -> DataFrame:
    """project_id, rank of projects (title, status, pinned, created_at) whose title holds the words, pinned ones first, then the newest."""
    x = found(projects, "title", words)
    if statuses:
        x = x.where(F.col("status").isin(statuses))
    return x.select("project_id", F.row_number().over(Window.orderBy(F.desc("pinned"), F.desc("created_at"), "project_id")).alias("rank"))


def distinct_paths(files: DataFrame) -> DataFrame:
    """run_id, path_key, n: paths that differ by case only count once."""
    return files.groupBy(RUN, F.lower("path").alias("path_key")).agg(F.count("*").alias("n"))


def alignment(words: DataFrame) -> DataFrame:
    """run_id, words, aligned, share: how many words have their times."""
    return words.groupBy(RUN).agg(F.count("*").alias("words"), F.count("start_ms").alias("aligned"), F.round(F.count("start_ms") / F.count("*"), 4).alias("share"))


def sections(chapters: DataFrame, payoffs: DataFrame) -> DataFrame:
    """chapters (run_id, chapter, start_ms, end_ms) with seconds, `longest` (ties: the first) and `pays` where the run's first payoff
    (run_id, payoff_ms) lies in it."""
    length = F.col("end_ms") - F.col("start_ms")
    nth = F.row_number().over(Window.partitionBy(RUN).orderBy(F.desc(length), "start_ms"))
    x = chapters.join(payoffs, RUN, "left").withColumns({"seconds": F.round(length / 1000, 1), "longest": nth == 1})
    return x.withColumn("pays", F.coalesce((F.col("payoff_ms") >= F.col("start_ms")) & (F.col("payoff_ms") < F.col("end_ms")), F.lit(False))).drop("payoff_ms")


def hits_at(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """query_id, hit_at_<k>: whether one of the first k results (query_id, rank, start_ms, end_ms) overlaps a gold range of its query."""
    g = gold.select("query_id", F.col("start_ms").alias("g0"), F.col("end_ms").alias("g1"))
    best = results.join(g, "query_id").where("start_ms < g1 and end_ms > g0").groupBy("query_id").agg(F.min("rank").alias("_best"))
    return gold.select("query_id").distinct().join(best, "query_id", "left").select("query_id", *[F.coalesce(F.col("_best") <= k, F.lit(False)).alias(f"hit_at_{k}") for k in ks])


def top_causes(seconds: DataFrame, most: int = 2) -> DataFrame:
    """run_id, t, feature, part, rank: the strongest positive parts of each second (ties: by name)."""
    w = Window.partitionBy(RUN, "t").orderBy(F.desc("part"), "feature")
    return seconds.where("part > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
