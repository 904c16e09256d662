"""Per-second hazard, survival and attribution from features, under stated assumptions (a policy, not a calibrated model)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import RUN, dealt
from tidemark.operators.sequences import spaced_top

# Log-hazard weights of features by cause group (in order), and of protective features.
GROUPS = {
    "opening_promise": {"setup_before_substance": 0.6, "no_hook_yet": 0.5, "payoff_pending": 0.5},
    "progress": {"low_novelty": 0.5, "repetition": 0.7},
    "comprehension": {"long_sentences": 0.2, "dense_text_fast_speech": 0.3},
    "interruptions": {"cta_or_sponsor": 0.8, "outro": 0.6},
    "delivery": {"slow_pace": 0.4, "fast_pace": 0.3, "filler_density": 0.3, "dead_air": 1.0, "flat_low_energy": 0.2, "loudness_drop": 0.4},
    "visual_pacing": {"long_static_shot": 0.4},
}
PROTECTIVE = {"open_loop": -0.4, "concrete": -0.2, "fresh_visual_change": -0.15, "new_onscreen_text": -0.15, "energy_lift": -0.1}
PROTECTIVE_CAP, MICRO = -0.1, 0.25


@dataclass(frozen=True)
class Assumptions:
    at_30s: float = 0.80
    at_end: float = 0.45
    shape: float = 0.6
    end_multiplier: float = 1.5
    end_fraction: float = 0.05

    def problems(self) -> list[str]:
        out = []
        if not 0 < self.at_end <= self.at_30s <= 1:
            out.append("need 0 < at_end <= at_30s <= 1")
        for name, low, high in (("shape", 0.3, 1.0), ("end_multiplier", 1.0, 3.0), ("end_fraction", 0.0, 0.2)):
            if not low <= getattr(self, name) <= high:
                out.append(f"{name} must lie in [{low}, {high}]")
        return out


def baseline(t: Column, length: Column, a: Assumptions) -> Column:
    """Cumulative neutral hazard at t seconds of a run of `length` seconds: a power of time that meets both anchors, steeper at the end."""
    k, m = a.shape, a.end_multiplier
    t0 = F.when(length > 30, F.lit(30.0)).otherwise(0.0)
    first = F.when(length > 30, -F.log(F.lit(a.at_30s))).otherwise(0.0)
    turn = F.greatest(t0, length * (1 - a.end_fraction))
    clock = lambda x: F.pow(F.least(x, turn), F.lit(k)) - F.pow(t0, F.lit(k)) + m * F.greatest(F.lit(0.0), F.pow(x, F.lit(k)) - F.pow(turn, F.lit(k)))
    whole = clock(length)
    rate = F.when(whole > 0, (-F.log(F.lit(a.at_end)) - first) / whole).otherwise(0.0)
    return F.when(t <= t0, F.when(t0 > 0, first * F.pow(t / 30.0, F.lit(k))).otherwise(0.0)).otherwise(first + rate * clock(F.least(t, length)))


def weigh(features: DataFrame) -> DataFrame:
    """run_id, t, feature, part, place: each cause group's strongest feature; where a second has none, its strongest protective one, capped."""
    features = dealt(features, RUN, "t")
    rows = [(f, w, g, i) for i, (g, fs) in enumerate(GROUPS.items()) for f, w in fs.items()] + [(f, w, "protective", 99) for f, w in PROTECTIVE.items()]
    dim = features.sparkSession.createDataFrame([(f, w, g, i, j) for j, (f, w, g, i) in enumerate(rows)], "feature string, weight double, cause string, place int, nth int")
    x = features.join(F.broadcast(dim), "feature").withColumn("part", F.col("weight") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value")))).where("part != 0")
    x = x.withColumn("part", F.when(F.col("cause") == "protective", F.greatest(F.lit(PROTECTIVE_CAP), F.col("part"))).otherwise(F.col("part")))
    best = x.groupBy(RUN, "t", "cause", "place").agg(F.max(F.struct(F.abs("part").alias("a"), (-F.col("nth")).alias("n"), "feature", "part")).alias("top"))
    best = best.withColumn("_risks", F.sum(F.when(F.col("cause") != "protective", 1).otherwise(0)).over(Window.partitionBy(RUN, "t")))
    own = best.where((F.col("cause") != "protective") | (F.col("_risks") == 0)).select(RUN, "t", F.col("top.feature").alias("feature"), F.col("top.part").alias("part"))
    # Moment-to-moment texture counts besides the groups, with its sign.
    micro = features.where(F.col("feature").isin("micro_slowdown", "micro_pickup")).groupBy(RUN, "t").agg(F.sum(F.when(F.col("feature") == "micro_slowdown", F.col("value")).otherwise(-F.col("value"))).alias("v"))
    micro = micro.where("v != 0").select(RUN, "t", F.lit("micro_variation").alias("feature"), (MICRO * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v")))).alias("part"))
    return own.unionByName(micro)


def curve(runs: DataFrame, features: DataFrame, a: Assumptions = Assumptions(), scale: float = 1.0) -> DataFrame:
    """Per second: baseline and actual hazard, retention at its end, loss, excess loss over the neutral video, time watched so far.

    runs: run_id, duration_ms (10 s or more). features: run_id, t, feature, value.
    """
    if a.problems():
        raise ValueError("; ".join(a.problems()))
    r = dealt(runs.where("duration_ms >= 10000").select(RUN, (F.col("duration_ms") / 1000).alias("length_s")), RUN)
    s = r.select(RUN, "length_s", F.explode(F.sequence(F.lit(0), F.ceil("length_s").cast("int") - 1)).alias("t"))
    parts = weigh(features).groupBy(RUN, "t").agg(F.sum("part").alias("lp"))
    x = dealt(s, RUN, "t").join(parts, [RUN, "t"], "left")
    x = dealt(x, RUN).withColumn("dt", F.least(F.lit(1.0), F.col("length_s") - F.col("t")))
    t = F.col("t").cast("double")
    x = x.withColumn("h0", (baseline(t + F.col("dt"), F.col("length_s"), a) - baseline(t, F.col("length_s"), a)) / F.col("dt"))
    x = x.withColumn("h", F.col("h0") * F.exp(F.coalesce("lp", F.lit(0.0)) * scale))
    w = Window.partitionBy(RUN).orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("s1", F.exp(-F.sum(F.col("h") * F.col("dt")).over(upto))).withColumn("s0", F.coalesce(F.lag("s1").over(w), F.lit(1.0)))
    area = F.when(F.col("h") > 1e-12, F.col("s0") * -F.expm1(-F.col("h") * F.col("dt")) / F.col("h")).otherwise(F.col("s0") * F.col("dt"))
    x = x.withColumn("area", area)
    excess = F.when(F.col("h") > F.col("h0"), F.col("s0") * (F.exp(-F.col("h0") * F.col("dt")) - F.exp(-F.col("h") * F.col("dt")))).otherwise(0.0)
    return x.select(RUN, "t", F.round("h0", 8).alias("baseline_hazard"), F.round("h", 8).alias("hazard"), F.round("s1", 6).alias("retention"), F.round(F.col("s0") - F.col("s1"), 6).alias("loss"), F.round(excess, 6).alias("excess_loss"), F.round(F.sum("area").over(upto), 4).alias("watched_s"))


def band(runs: DataFrame, features: DataFrame, a: Assumptions = Assumptions(), scales: tuple[float, ...] = (0.5, 1.0, 1.5)) -> DataFrame:
    """Per second the least and largest retention over the scales of all weights: sensitivity, not confidence."""
    out = None
    for k in scales:
        c = curve(runs, features, a, k).select(RUN, "t", "retention")
        out = c if out is None else out.unionByName(c)
    return out.groupBy(RUN, "t").agg(F.min("retention").alias("lower"), F.max("retention").alias("upper"))


def attribution(seconds: DataFrame, parts: DataFrame) -> DataFrame:
    """run_id, feature, excess_loss: each second's excess loss shared over its positive parts, added up."""
    p = parts.where("part > 0").withColumn("share", F.col("part") / F.sum("part").over(Window.partitionBy(RUN, "t")))
    return p.join(seconds.select(RUN, "t", "excess_loss"), [RUN, "t"]).groupBy(RUN, "feature").agg(F.round(F.sum(F.col("share") * F.col("excess_loss")), 5).alias("excess_loss"))


def drop_moments(seconds: DataFrame, width: int = 10, gap: int = 15, most: int = 8) -> DataFrame:
    """run_id, t, window_loss: the windows with most excess loss, starts at least gap apart, in time order."""
    w = Window.partitionBy(RUN).orderBy("t")
    x = seconds.withColumns({"window_loss": F.sum("excess_loss").over(w.rowsBetween(0, width - 1)), "_last": F.max("t").over(Window.partitionBy(RUN))})
    x = x.where((F.col("t") <= F.greatest(F.lit(0), F.col("_last") + 1 - width)) & (F.col("window_loss") > 0)).select(RUN, F.col("t").cast("bigint").alias("t"), F.round("window_loss", 6).alias("window_loss"))
    return spaced_top(x, "window_loss", "t", gap, most, [RUN])


def run_summary(seconds: DataFrame) -> DataFrame:
    return seconds.groupBy(RUN).agg(F.max_by("watched_s", "t").alias("average_s"), F.round(100 * F.max_by("retention", "t"), 2).alias("end_pct"), F.round(F.sum("excess_loss"), 5).alias("excess_loss"))
