"""Scores under other assumptions: bounds of survival, many assumptions at once, both sides of a cut plan, what coverage inputs allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import risk, scoring
from tidemark.operators.intervals import RUN, remap, subtract, union


def recomputed(runs: DataFrame, features: DataFrame, assumptions: dict[str, scoring.Assumptions]) -> DataFrame:
    """The curve of every run under each named set of assumptions (a few)."""
    out = None
    for name, a in assumptions.items():
        c = scoring.curve(runs, features, a).withColumn("assumptions", F.lit(name))
        out = c if out is None else out.unionByName(c)
    return out


def derived_watch(stored: DataFrame, survival: str = "retention") -> DataFrame:
    """stored per-second rows (run_id, t, a survival column, duration_s) with watched_s: the exact running integral of a piecewise-exponential curve."""
    w = Window.partitionBy(RUN).orderBy("t")
    cur, dt = F.col(survival), F.coalesce("duration_s", F.lit(1.0))
    prev = F.coalesce(F.lag(survival).over(w), F.lit(1.0))
    area = F.when((cur > 0) & (prev > cur), (prev - cur) * dt / F.log(prev / cur)).otherwise(prev * dt)
    return stored.withColumn("_a", area).withColumn("watched_s", F.bround(F.sum("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4)).drop("_a")


def bounds(bins: DataFrame, **assumed) -> DataFrame:
    """Per bin the survival at its end with the largest risk (lower), the least (upper), and both equal where all risk is known (central);
    conditional and absolute drops. Runs under a minute are left out."""
    keep = [RUN, "bin"]
    side = lambda r, n: risk.survival(bins, r, **assumed).select(*keep, F.col("survival_start").alias(f"{n}_start"), F.col("survival_end").alias(f"{n}_end"), F.col("watched_s").alias(f"{n}_watched"))
    x = side("upper", "lower").join(side("lower", "upper"), keep).join(bins.select(*keep, "start_ms", "end_ms", "point"), keep)
    known = F.min(F.col("point").isNotNull()).over(Window.partitionBy(RUN))
    cond = lambda n: F.when(F.col(f"{n}_start") > 0, 1 - F.col(f"{n}_end") / F.col(f"{n}_start")).otherwise(0.0)
    drop = lambda n: F.col(f"{n}_start") - F.col(f"{n}_end")
    return x.select(
        *keep, "start_ms", "end_ms", "lower_end", "upper_end", F.when(known, F.col("upper_end")).alias("central_end"), "lower_watched", "upper_watched",
        F.round(F.least(cond("lower"), cond("upper")), 5).alias("least_conditional"), F.round(F.greatest(cond("lower"), cond("upper")), 5).alias("most_conditional"),
        F.round(F.least(drop("lower"), drop("upper")), 5).alias("least_drop"), F.round(F.greatest(drop("lower"), drop("upper")), 5).alias("most_drop"),
    )


def half_up(x: Column, digits: int) -> Column:
    """x, not negative, rounded in doubles: F.round goes by the decimal text, so that 261.715 (just under it in binary) becomes 261.72."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def scenario_summary(bounded: DataFrame) -> DataFrame:
    """run_id, seconds, least and most watched seconds and share, end share, complete: the last bin's values."""
    last = bounded.groupBy(RUN).agg(F.max_by(F.struct("end_ms", "lower_end", "upper_end", "central_end", "lower_watched", "upper_watched"), "bin").alias("b"))
    s = F.col("b.end_ms") / 1000
    return last.select(RUN, s.alias("seconds"), half_up(F.col("b.lower_watched"), 2).alias("least_watched_s"), half_up(F.col("b.upper_watched"), 2).alias("most_watched_s"), half_up(100 * F.col("b.lower_watched") / s, 2).alias("least_viewed_pct"), half_up(100 * F.col("b.upper_watched") / s, 2).alias("most_viewed_pct"), half_up(100 * F.col("b.lower_end"), 2).alias("least_end_pct"), half_up(100 * F.col("b.upper_end"), 2).alias("most_end_pct"), F.col("b.central_end").isNotNull().alias("complete"))


def scenarios(bins: DataFrame, assumptions: dict[str, dict]) -> DataFrame:
    """scenario_summary of stored bins under each named set of assumptions (at_30s, at_end, kappa)."""
    out = None
    for name, a in assumptions.items():
        s = scenario_summary(bounds(bins, **a)).withColumn("assumptions", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def mapped(spans: DataFrame, cuts: DataFrame, key: str) -> DataFrame:
    """spans with their times after the cuts; those cut altogether are left out. key tells spans of a run apart."""
    ends = spans.select(RUN, key, F.explode(F.array("start_ms", "end_ms")).alias("at_ms"))
    moved = remap(ends, cuts).groupBy(RUN, key).agg(F.min("new_ms").alias("_a"), F.max("new_ms").alias("_b")).where("_b > _a")
    return spans.join(moved, [RUN, key]).withColumns({"start_ms": F.col("_a"), "end_ms": F.col("_b")}).drop("_a", "_b")


def compare_cuts(runs: DataFrame, issues: DataFrame, spans: DataFrame, cuts: DataFrame, resolved: DataFrame | None = None, **assumed) -> DataFrame:
    """scenario_summary of both sides of a cut plan (side: before, after) under the same assumptions. Issues cut altogether, and on the
    `after` side the resolved ones (run_id, issue_id), do not count. Sides under a minute have no row."""
    inside = union(cuts.join(runs, RUN).select(RUN, F.greatest(F.lit(0), "start_ms").alias("start_ms"), F.least("end_ms", "duration_ms").alias("end_ms")))
    removed = inside.groupBy(RUN).agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_r"))
    shorter = runs.join(removed, RUN, "left").select(RUN, (F.col("duration_ms") - F.coalesce("_r", F.lit(0))).alias("duration_ms"))
    left = mapped(issues, inside, "issue_id")
    if resolved is not None:
        left = left.join(resolved.select(RUN, "issue_id"), [RUN, "issue_id"], "left_anti")
    seen = mapped(spans.withColumn("_span", F.concat_ws(":", "track", "start_ms", "end_ms")).dropDuplicates([RUN, "_span"]), inside, "_span").drop("_span")
    side = lambda r, i, s, n: scenario_summary(bounds(risk.risk_bins(r, i, s), **assumed)).withColumn("side", F.lit(n))
    return side(runs, issues, spans, "before").unionByName(side(shorter, left, seen, "after"))


def track_coverage(runs: DataFrame, inputs: DataFrame, holes: DataFrame, inspected: DataFrame) -> DataFrame:
    """run_id, track, start_ms, end_ms that the inputs of a run let one judge. inputs: run_id and flags narrative, audio, words, shots, screen_text;
    holes: undecided narrative spans; inspected: visually inspected spans.

    Narrative is the run less the holes; visuals the inspected spans; pacing needs audio, words and shots; text needs reading of the screen,
    else visual inspection stands in; technical checks need shots and audio, half of the run counts with shots alone.
    """
    r = runs.join(inputs, RUN)
    whole = lambda cond, track, end=F.col("duration_ms"): r.where(cond).select(RUN, F.lit(track).alias("track"), F.lit(0).cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"))
    told = r.where("narrative").select(RUN, F.lit(0).cast("bigint").alias("start_ms"), F.col("duration_ms").cast("bigint").alias("end_ms"))
    narrative = subtract(told, holes, 60_000).withColumn("track", F.lit("narrative"))
    seen = inspected.select(RUN, F.lit("visual").alias("track"), "start_ms", "end_ms")
    stand_in = inspected.join(r.where("not screen_text").select(RUN), RUN).select(RUN, F.lit("text").alias("track"), "start_ms", "end_ms")
    technical = F.when(F.col("audio"), F.col("duration_ms")).otherwise(F.floor(F.col("duration_ms") / 2))
    parts = [seen, whole(F.col("audio") & F.col("words") & F.col("shots"), "pacing"), whole(F.col("screen_text"), "text"), stand_in, whole(F.col("shots"), "technical", technical)]
    out = narrative.select(RUN, "track", "start_ms", "end_ms")
    for p in parts:
        out = out.unionByName(p)
    return union(out, keys=(RUN, "track"))
