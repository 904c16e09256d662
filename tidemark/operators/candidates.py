"""Candidate issues with fixed intervals and the edits they offer: run_id, type, start_ms, end_ms, operation, edit_start, edit_end,
destination_ms, absence. Limits are review triggers, not verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import word_count
from tidemark.operators.findings import announced
from tidemark.operators.intervals import RUN, overlap_join, point_join, union
from tidemark.operators.selects import repeated_runs, snapped
from tidemark.operators.sequences import outliers_below

# Most candidates of a type, least lengths and times (milliseconds), least motion, fastest speech.
MOST = {"dead_air": 6, "technical_audio_fault": 3, "technical_visual_fault": 4, "unnecessary_repetition": 6, "rushed_delivery": 3, "visual_stagnation": 6, "tangent": 4, "disruptive_cta": 3}
INTRO_MS, PAYOFF_MS, STATIC_MS, MOTION, FAST_WPM, FAST_TIMES = 20_000, 60_000, 15_000, 0.02, 190, 1.25


def candidate(df: DataFrame, kind: str, operation: Column, edit_start: Column, edit_end: Column, destination: Column | None = None, absence: bool = False) -> DataFrame:
    long = lambda c: c.cast("bigint")
    to = F.lit(None) if destination is None else destination
    return df.select(RUN, F.lit(kind).alias("type"), long(F.col("start_ms")).alias("start_ms"), long(F.col("end_ms")).alias("end_ms"), operation.alias("operation"), long(edit_start).alias("edit_start"), long(edit_end).alias("edit_end"), long(to).alias("destination_ms"), F.lit(absence).alias("absence")).where("end_ms > start_ms")


def first_of(df: DataFrame, kind: str, order: list) -> DataFrame:
    """The first candidates of a type in each run."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(RUN).orderBy(*order))).where(F.col("_k") <= MOST[kind]).drop("_k")


def slow_intros(structure: DataFrame, words: DataFrame) -> DataFrame:
    """The time before a first point that comes after INTRO_MS; the edit leaves the hook and starts and ends with sentences."""
    s = structure.where(F.col("first_substance_ms") >= INTRO_MS).select(RUN, F.lit(0).cast("bigint").alias("start_ms"), F.col("first_substance_ms").alias("end_ms"), F.when(F.col("hook_end_ms") < F.col("first_substance_ms"), F.col("hook_end_ms")).otherwise(0).alias("a"))
    moved = snapped(s.select(RUN, F.lit(0).alias("span"), F.col("a").cast("bigint").alias("start_ms"), "end_ms"), words).select(RUN, F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    return candidate(s.drop("a").join(moved, RUN), "slow_intro", F.lit("rewrite"), F.col("a"), F.col("b"))


def late_payoffs(runs: DataFrame, promises: DataFrame, structure: DataFrame, segments: DataFrame) -> DataFrame:
    """Promises kept after PAYOFF_MS, whose first delivery may move to the hook, and promises that nothing shows to be kept."""
    kept = promises.where(F.col("status").isin("fulfilled", "partial") & (F.col("first_fulfil_ms") >= PAYOFF_MS)).select(RUN, F.col("first_fulfil_ms").alias("at_ms"))
    kept = point_join(kept, segments.select(RUN, F.col("start_ms").alias("start_ms"), "end_ms"), 30_000).select(RUN, "at_ms", F.col("start_ms").alias("a"), F.col("end_ms").alias("b")).join(structure.select(RUN, "hook_ms"), RUN, "left")
    late = candidate(kept.withColumns({"start_ms": F.lit(0), "end_ms": F.col("at_ms")}), "delayed_payoff", F.lit("move"), F.col("a"), F.col("b"), F.coalesce("hook_ms", F.lit(0)))
    last = segments.groupBy(RUN).agg(F.max(F.struct("start_ms", "end_ms")).alias("last"))
    lost = promises.where(F.col("status").isin("unaddressed", "uncertain")).join(runs, RUN).join(last, RUN)
    lost = lost.withColumns({"start_ms": F.coalesce("setup_ms", F.lit(0)), "end_ms": F.col("duration_ms")})
    return late.unionByName(candidate(lost, "unresolved_promise", F.lit("rewrite"), F.col("last.start_ms"), F.col("last.end_ms"), absence=True))


def tangents(spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Detours whose paragraphs (run_id, start_ms, end_ms, title_cos) all lie under the run's robust limit of relevance to the title."""
    limit = outliers_below(paragraphs.select(RUN, "title_cos"), [RUN], "title_cos").select(RUN, "limit").distinct()
    s = spans.where("kind = 'tangent_candidate'").select(RUN, "start_ms", "end_ms")
    near = overlap_join(s, paragraphs.select(RUN, "start_ms", "end_ms", "title_cos"), 30_000).groupBy(RUN, "start_ms", "end_ms").agg(F.max("title_cos").alias("best"))
    return candidate(first_of(near.join(limit, RUN).where("best < limit"), "tangent", ["start_ms"]), "tangent", F.lit("cut"), F.col("start_ms"), F.col("end_ms"))


def disruptive_requests(runs: DataFrame, spans: DataFrame, structure: DataFrame) -> DataFrame:
    """Requests and sponsors outside the last 45 seconds; they may move to the end, or to a minute after the first point if they come after it."""
    s = first_of(spans.where(F.col("kind").isin("cta", "sponsor")), "disruptive_cta", ["start_ms", "end_ms"]).join(runs, RUN).join(structure.select(RUN, F.coalesce("first_substance_ms", F.lit(0)).alias("sub")), RUN)
    end = F.col("duration_ms") - 1
    to = F.when(F.col("start_ms") < F.col("sub"), end).otherwise(F.greatest(F.col("sub"), F.least(end, F.col("sub") + 60_000)))
    return candidate(s.where(F.col("start_ms") <= F.col("duration_ms") - 45_000), "disruptive_cta", F.lit("move"), F.col("start_ms"), F.col("end_ms"), to)


def repetitions(pairs: DataFrame, segments: DataFrame, words: DataFrame) -> DataFrame:
    """Runs of sentences of a later paragraph that repeat the wording of an earlier one (pairs: run_id, earlier, later), if no replay is
    announced there; the cut starts and ends with sentences. segments carry their paragraph."""
    x = repeated_runs(pairs, segments)
    inside = x.join(segments.select(RUN, "seg_idx", "start_ms", "end_ms"), RUN).where(F.col("seg_idx").between(F.col("first"), F.col("last")))
    x = inside.groupBy(RUN, "earlier", "later").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    x = x.join(announced(segments, x.select(RUN, "start_ms")), [RUN, "start_ms"], "left_anti")
    x = first_of(x, "unnecessary_repetition", ["earlier", "later"]).withColumn("span", F.concat_ws("-", "earlier", "later"))
    s = snapped(x.select(RUN, "span", "start_ms", "end_ms"), words)
    # One interval is one candidate, however many earlier passages it repeats.
    return candidate(s, "unnecessary_repetition", F.lit("cut"), F.col("start_ms"), F.col("end_ms")).dropDuplicates([RUN, "start_ms", "end_ms"])


def dead_air(pauses: DataFrame) -> DataFrame:
    """The longest pauses; a cut leaves 0.3 s on each side."""
    p = first_of(pauses, "dead_air", [F.desc(F.col("end_ms") - F.col("start_ms")), "start_ms"])
    return candidate(p, "dead_air", F.lit("cut"), F.col("start_ms") + 300, F.greatest(F.col("start_ms") + 301, F.col("end_ms") - 300))


def rushed(groups: DataFrame, rates: DataFrame) -> DataFrame:
    """The fastest groups of segments (run_id, part, start_ms, end_ms) over FAST_WPM and over FAST_TIMES the run's usual rate."""
    x = rates.where(F.col("wpm") > F.greatest(F.lit(float(FAST_WPM)), FAST_TIMES * F.col("usual"))).join(groups.select(RUN, "part", "start_ms", "end_ms"), [RUN, "part"])
    return candidate(first_of(x, "rushed_delivery", [F.desc("wpm"), "start_ms"]), "rushed_delivery", F.lit("rewrite"), F.col("start_ms"), F.col("end_ms"))


def clip_faults(windows: DataFrame, gap_ms: int = 2000) -> DataFrame:
    """Windows with clipped samples (fraction), joined over gaps of gap_ms; those with the largest share first."""
    x = union(windows, gap_ms=gap_ms, aggs=(F.max("fraction").alias("fraction"),))
    return candidate(first_of(x, "technical_audio_fault", [F.desc("fraction"), "start_ms"]), "technical_audio_fault", F.lit("adjust_audio"), F.col("start_ms"), F.col("end_ms"))


def black_faults(runs: DataFrame, black: DataFrame, segments: DataFrame) -> DataFrame:
    """Black pictures away from the first and last second; they may be cut only where nobody speaks."""
    b = first_of(black, "technical_visual_fault", ["start_ms"]).join(runs, RUN).where((F.col("start_ms") >= 1000) & (F.col("end_ms") <= F.col("duration_ms") - 1000))
    spoken = overlap_join(b.select(RUN, "start_ms", "end_ms"), segments.select(RUN, "start_ms", "end_ms"), 30_000).select(RUN, "start_ms").distinct().withColumn("_s", F.lit(True))
    return candidate(b.join(spoken, [RUN, "start_ms"], "left"), "technical_visual_fault", F.when(F.col("_s").isNull(), "cut").otherwise("insert_visual"), F.col("start_ms"), F.col("end_ms"))


def stagnation(shots: DataFrame, seen: DataFrame) -> DataFrame:
    """Long shots without motion over which something was observed: without inspection a long shot is only a measurement."""
    x = shots.where((F.col("end_ms") - F.col("start_ms") >= STATIC_MS) & (F.coalesce("motion", F.lit(0.0)) < MOTION))
    x = first_of(x, "visual_stagnation", ["start_ms"])
    looked = overlap_join(x.select(RUN, "start_ms", "end_ms"), seen.select(RUN, "start_ms", "end_ms"), 30_000).select(RUN, "start_ms").distinct()
    return candidate(x.join(looked, [RUN, "start_ms"], "left_semi"), "visual_stagnation", F.lit("insert_visual"), F.col("start_ms"), F.col("end_ms"))


def evidence(*sources: DataFrame) -> DataFrame:
    """run_id, evidence_id, kind, ref_id, start_ms, end_ms of the sources (run_id, kind, ref_id, start_ms, end_ms), one row per thing cited; the
    first source wins."""
    parts = [s.select(RUN, "kind", F.col("ref_id").cast("string").alias("ref_id"), "start_ms", "end_ms", F.lit(i).alias("_i")) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    best = out.groupBy(RUN, "kind", "ref_id").agg(F.min(F.struct("_i", "start_ms", "end_ms")).alias("b"))
    name = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", "kind", "ref_id", F.col(RUN).cast("string")), 256), 1, 24))
    return best.select(RUN, name.alias("evidence_id"), "kind", "ref_id", "b.start_ms", "b.end_ms")


def within_budget(paragraphs: DataFrame, chars: int, least_words: int = 25) -> DataFrame:
    """paragraphs (run_id, paragraph, text) with `shown`: all of the text where the run fits into chars, else each paragraph's first words, cut
    in the same proportion but to least_words at least."""
    total = F.sum(F.length("text")).over(Window.partitionBy(RUN))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    scale = F.least(F.lit(1.0), chars / F.greatest(F.lit(1), total))
    x = paragraphs.withColumns({"_scale": scale, "_n": word_count(F.col("text"))})
    keep = F.greatest(F.lit(least_words), F.floor(F.col("_n") * F.col("_scale")).cast("int"))
    shown = F.concat(F.array_join(F.slice(words, F.lit(1), keep), " "), F.when(keep < F.col("_n"), " …").otherwise(""))
    return x.withColumn("shown", F.when(F.col("_scale") < 1, shown).otherwise(F.col("text"))).drop("_scale", "_n")
