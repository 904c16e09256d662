"""Findings from per-second features, cut plans, and selections under limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import ADVANCE, RECAP, REPLAY, edges
from tidemark.operators.intervals import RUN, islands, overlap_ms, remap, to_bins, union
from tidemark.operators.passes import batches  # noqa: F401 (part of this module's interface)
from tidemark.operators.sequences import fold, novelty

# Per feature how strong (or, for dead air, how many seconds long) a stretch must be for medium and for high severity, and
# how well its evidence counts.
LADDERS = {
    "slow_pace": ("strength", 0.6, None, "provisional"),
    "fast_pace": ("strength", 0.6, None, "provisional"),
    "filler_density": ("strength", 0.8, None, "provisional"),
    "dead_air": ("seconds", 3.0, 6.0, "supported"),
}


def severity(feature: Column, strength: Column, seconds: Column) -> Column:
    out = F.lit("low")
    for name, (what, medium, high, _) in LADDERS.items():
        x = strength if what == "strength" else seconds
        step = F.when(x >= high, "high").when(x >= medium, "medium") if high is not None else F.when(x >= medium, "medium")
        out = F.when(feature == name, step.otherwise("low")).otherwise(out)
    return out


def finding_runs(features: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, feature, start_ms, end_ms, strength, severity, evidence: stretches of seconds with a feature that has a ladder."""
    f = features.where(F.col("feature").isin(*LADDERS) & (F.col("value") > 0))
    on = f.withColumn("_k", F.col("t") - F.row_number().over(Window.partitionBy(RUN, "feature").orderBy("t")))
    x = on.groupBy(RUN, "feature", "_k").agg((F.min("t").cast("bigint") * 1000).alias("start_ms"), ((F.max("t").cast("bigint") + 1) * 1000).alias("end_ms"), F.max("value").alias("strength"))
    x = x.join(runs.select(RUN, "duration_ms"), RUN).withColumn("end_ms", F.least("end_ms", "duration_ms"))
    evidence = F.lit(None).cast("string")
    for name, ladder in LADDERS.items():
        evidence = F.when(F.col("feature") == name, F.lit(ladder[3])).otherwise(evidence)
    return x.select(RUN, "feature", "start_ms", "end_ms", "strength", severity(F.col("feature"), F.col("strength"), (F.col("end_ms") - F.col("start_ms")) / 1000).alias("severity"), evidence.alias("evidence"))


def announced(segments: DataFrame, passages: DataFrame, before_ms: int = 12_000, after_ms: int = 3_000) -> DataFrame:
    """Passages (run_id, start_ms) that a cue announces as a replay: in a segment ending at most before_ms before or starting at most
    after_ms after the passage's start."""
    cue = segments.where(F.regexp_replace(F.lower("text"), r"[^\w\s']", " ").rlike(edges(REPLAY)))
    near = cue.select(RUN, (F.col("start_ms") - after_ms).alias("_a"), (F.col("end_ms") + before_ms + 1).alias("_b"))
    marks = to_bins(near, 60_000, "_a", "_b", "_bin").alias("m")
    p = passages.withColumn("_bin", F.floor(F.col("start_ms") / 60_000)).alias("p")
    inside = (F.col("m._a") <= F.col("p.start_ms")) & (F.col("p.start_ms") < F.col("m._b"))
    return p.join(marks, (F.col(f"p.{RUN}") == F.col(f"m.{RUN}")) & (F.col("p._bin") == F.col("m._bin")) & inside, "left_semi").drop("_bin")


def repetition_runs(segments: DataFrame, least: int = 2) -> DataFrame:
    """run_id, first, last, steps, start_ms, end_ms: `least` or more segments in a row that repeat earlier wording without marking progress
    or a recap, and are not announced as a replay."""
    # Only segments without such a mark meet what repeats, and their texts stay where they are.
    free = segments.where(~F.col("text").rlike(edges(ADVANCE)) & ~F.col("text").rlike(edges(RECAP))).select(RUN, "seg_idx", "start_ms", "end_ms")
    on = novelty(segments).where("repeats").select(RUN, "seg_idx").join(free, [RUN, "seg_idx"]).withColumn("_k", F.col("seg_idx") - F.row_number().over(Window.partitionBy(RUN).orderBy("seg_idx")))
    out = on.groupBy(RUN, "_k").agg(F.min("seg_idx").alias("first"), F.max("seg_idx").alias("last"), F.count("*").alias("steps"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).where(F.col("steps") >= least).drop("_k")
    return out.join(announced(segments, out.select(RUN, "start_ms")), [RUN, "start_ms"], "left_anti")


def dominant_runs(features: DataFrame, least: int = 2) -> DataFrame:
    """run_id, feature, first, last: stretches of consecutive seconds whose strongest feature (ties: the least name) stays the same."""
    top = features.where("value > 0").groupBy(RUN, "t").agg(F.min(F.struct((-F.col("value")).alias("v"), "feature")).alias("_b")).select(RUN, "t", F.col("_b.feature").alias("feature"))
    x = top.withColumn("_k", F.col("t") - F.row_number().over(Window.partitionBy(RUN, "feature").orderBy("t")))
    return x.groupBy(RUN, "feature", "_k").agg(F.min("t").alias("first"), F.max("t").alias("last")).where(F.col("last") - F.col("first") + 1 >= least).drop("_k")


def new_texts(tracks: DataFrame, key: Column, first_ms: int = 500, quiet_ms: int = 5000) -> DataFrame:
    """Tracks (run_id, start_ms, end_ms) with is_new: neither there from the start nor seen in the last quiet_ms."""
    w = Window.partitionBy(RUN, "_key").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    x = tracks.withColumn("_key", key).withColumn("_seen", F.max("end_ms").over(w))
    return x.withColumn("is_new", (F.col("start_ms") > first_ms) & (F.col("_seen").isNull() | (F.col("start_ms") - F.col("_seen") > quiet_ms))).drop("_key", "_seen")


def clips(runs: DataFrame, width_ms: int = 20_000, context_ms: int = 2000, tail_ms: int = 2000) -> DataFrame:
    """run_id, clip, start_ms, end_ms, context_start, context_end: equal clips; a tail shorter than tail_ms joins the one before."""
    n = F.ceil(F.col("duration_ms") / width_ms)
    n = F.when((n > 1) & (F.col("duration_ms") - (n - 1) * width_ms < tail_ms), n - 1).otherwise(n)
    x = runs.where("duration_ms > 0").withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("clip"))
    x = x.withColumns({"start_ms": F.col("clip") * width_ms, "end_ms": F.when(F.col("clip") == F.col("_n") - 1, F.col("duration_ms")).otherwise((F.col("clip") + 1) * width_ms)})
    return x.select(RUN, "clip", "start_ms", "end_ms", F.greatest(F.lit(0), F.col("start_ms") - context_ms).alias("context_start"), F.least("duration_ms", F.col("end_ms") + context_ms).alias("context_end"))


def spread_over_bins(df: DataFrame, amount: Column, width_ms: int) -> DataFrame:
    """run_id, bin, amount: each interval's amount dealt to its bins by overlap."""
    x = to_bins(df.withColumn("_a", amount), width_ms)
    part = F.col("_a") * overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("bin") * width_ms, (F.col("bin") + 1) * width_ms) / (F.col("end_ms") - F.col("start_ms"))
    return x.groupBy(RUN, "bin").agg(F.sum(part).alias("amount"))


def cut_plan(runs: DataFrame, spans: DataFrame, cuts: DataFrame, span_id: str = "issue_id") -> DataFrame:
    """run_id, before_ms, removed_ms, after_ms, n_spans, n_removed: what cuts take out of runs and of their spans.

    A span that lies in cuts altogether disappears; both of its ends are mapped in one pass.
    """
    ends = spans.select(RUN, span_id, F.explode(F.array("start_ms", "end_ms")).alias("at_ms"))
    mapped = remap(ends, cuts).groupBy(RUN, span_id).agg((F.max("new_ms") - F.min("new_ms")).alias("left_ms"))
    lost = mapped.groupBy(RUN).agg(F.count("*").alias("n_spans"), F.count_if(F.col("left_ms") <= 0).alias("n_removed"))
    inside = union(cuts).join(runs, RUN).groupBy(RUN).agg(F.sum(overlap_ms(F.col("start_ms"), F.col("end_ms"), F.lit(0), F.col("duration_ms"))).alias("removed_ms"))
    x = runs.join(inside, RUN, "left").join(lost, RUN, "left").fillna(0, ["removed_ms", "n_spans", "n_removed"])
    return x.select(RUN, F.col("duration_ms").alias("before_ms"), "removed_ms", (F.col("duration_ms") - F.col("removed_ms")).alias("after_ms"), "n_spans", "n_removed")


def top_passages(scored: DataFrame, most: int) -> DataFrame:
    """Of each run and query the best-scored passages (ties: the later) that do not overlap, at most `most`; folds stretches of overlapping hits."""
    item = F.struct((-F.col("score")).alias("s"), (-F.col("passage")).alias("p"), F.col("start_ms").alias("a"), F.col("end_ms").alias("b"))
    row = "array<struct<passage:bigint,a:bigint,b:bigint,score:double>>"

    def keep(done: Column, x: Column) -> Column:
        new = F.array(F.struct((-x.p).alias("passage"), x.a.alias("a"), x.b.alias("b"), (-x.s).alias("score"))).cast(row)
        return F.when(~F.exists(done, lambda y: (x.a < y.b) & (x.b > y.a)), F.concat(done, new)).otherwise(done)

    keys = [RUN, "query_id"]
    out = fold(islands(scored, keys=tuple(keys)), [*keys, "island"], item, F.array().cast(row), keep).select(*keys, F.inline("folded"))
    # What one stretch keeps does not depend on the others, so the limit can follow.
    out = out.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("passage")))).where(F.col("_k") <= most)
    return out.select(*keys, "passage", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), "score")
