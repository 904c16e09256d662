"""Half-open intervals [start_ms, end_ms) of many runs; every operator works per run_id.

Range conditions are joined on (run_id, bin), so they stay equi-joins that Spark can shuffle, broadcast or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = "run_id"


def dealt(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """df by its keys in as many parts as shuffles have by setting: a table of seconds, small when packed, is otherwise joined to few parts and is large where it is sorted.

    times: so many times these parts. Rows that come from a shuffle by the same keys are dealt out anew only if the number differs.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def overlap_ms(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def to_bins(df: DataFrame, width_ms: int, start: str = "start_ms", end: str = "end_ms", out: str = "bin") -> DataFrame:
    """A row per bin that the interval touches; empty intervals give none."""
    last = F.ceil(F.col(end) / width_ms) - 1
    return df.where(F.col(end) > F.col(start)).withColumn(out, F.explode(F.sequence(F.floor(F.col(start) / width_ms), last)))


def overlap_join(left: DataFrame, right: DataFrame, width_ms: int, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals of a run; the right side's start_ms and end_ms come out as right_start, right_end.

    Both sides are dealt into bins; a pair is reported in the first bin that both touch, so it comes out once.
    """
    r = to_bins(right.withColumnsRenamed({"start_ms": "right_start", "end_ms": "right_end"}), width_ms, "right_start", "right_end")
    first = F.floor(F.greatest("start_ms", "right_start") / width_ms) == F.col("bin")
    pairs = to_bins(left, width_ms).join(r.hint("merge"), [RUN, "bin"]).where((F.col("start_ms") < F.col("right_end")) & (F.col("right_start") < F.col("end_ms")) & first).drop("bin")
    if how == "inner":
        return pairs
    keys = [c for c in left.columns]
    return left.join(pairs, keys, "left")


def point_join(points: DataFrame, intervals: DataFrame, width_ms: int, at: str = "at_ms") -> DataFrame:
    """Points with the intervals that contain them."""
    p = points.withColumn("bin", F.floor(F.col(at) / width_ms))
    return p.join(to_bins(intervals, width_ms), [RUN, "bin"]).where((F.col("start_ms") <= F.col(at)) & (F.col(at) < F.col("end_ms"))).drop("bin")


def islands(df: DataFrame, gap_ms: int = 0, keys: tuple[str, ...] = (RUN,)) -> DataFrame:
    """df with `island`: intervals that touch, overlap or lie at most gap_ms apart share one number."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") > reach + gap_ms), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def union(df: DataFrame, gap_ms: int = 0, keys: tuple[str, ...] = (RUN,), aggs: tuple[Column, ...] = ()) -> DataFrame:
    """Disjoint intervals that cover the same time (and gaps up to gap_ms)."""
    out = islands(df.where(F.col("end_ms") > F.col("start_ms")), gap_ms, keys).groupBy(*keys, "island")
    return out.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), *aggs).drop("island")


def complement(df: DataFrame, spans: DataFrame, keys: tuple[str, ...] = (RUN,)) -> DataFrame:
    """What df's intervals leave free within the spans (one start_ms, end_ms per run)."""
    s = spans.select(*keys, F.col("start_ms").alias("span_start"), F.col("end_ms").alias("span_end"))
    inside = union(df, keys=keys).join(s, list(keys)).where((F.col("end_ms") > F.col("span_start")) & (F.col("start_ms") < F.col("span_end")))
    edges = inside.unionByName(s.select(*keys, F.col("span_end").alias("start_ms"), F.col("span_end").alias("end_ms"), "span_start", "span_end"))
    w = Window.partitionBy(*keys, "span_start").orderBy("start_ms", "end_ms")
    return edges.select(*keys, F.greatest(F.coalesce(F.lag("end_ms").over(w), F.col("span_start")), F.col("span_start")).alias("free_start"), F.least("start_ms", "span_end").alias("free_end")).where("free_end > free_start").select(*keys, F.col("free_start").alias("start_ms"), F.col("free_end").alias("end_ms"))


def subtract(df: DataFrame, holes: DataFrame, width_ms: int) -> DataFrame:
    """The union of df less the union of holes."""
    base = union(df)
    cut = overlap_join(base, union(holes), width_ms).select(RUN, "start_ms", "end_ms", F.greatest("start_ms", "right_start").alias("h0"), F.least("end_ms", "right_end").alias("h1"))
    edges = cut.unionByName(base.select(RUN, "start_ms", "end_ms", F.col("end_ms").alias("h0"), F.col("end_ms").alias("h1")))
    w = Window.partitionBy(RUN, "start_ms", "end_ms").orderBy("h0", "h1")
    out = edges.select(RUN, F.coalesce(F.lag("h1").over(w), F.col("start_ms")).alias("a"), F.col("h0").alias("b"))
    return out.where("b > a").select(RUN, F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


def gaps(df: DataFrame, least_ms: int) -> DataFrame:
    """Gaps of at least least_ms between a run's intervals."""
    u = union(df)
    w = Window.partitionBy(RUN).orderBy("start_ms")
    out = u.select(RUN, F.lag("end_ms").over(w).alias("a"), F.col("start_ms").alias("b"))
    return out.where(F.col("b") - F.col("a") >= least_ms).select(RUN, F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))


def runs_of(df: DataFrame, flag: Column, least: int, t: str = "t") -> DataFrame:
    """Stretches of at least `least` consecutive steps t at which flag holds."""
    on = df.where(flag).withColumn("_k", F.col(t) - F.row_number().over(Window.partitionBy(RUN).orderBy(t)))
    return on.groupBy(RUN, "_k").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("steps")).where(F.col("steps") >= least).drop("_k")


def rasterise(df: DataFrame, width_ms: int, value: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per bin the largest value, weighed by the share of the bin that the interval fills."""
    share = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("bin") * width_ms, (F.col("bin") + 1) * width_ms) / width_ms
    return to_bins(df, width_ms).groupBy(RUN, *keys, "bin").agg(F.max(value * share).alias("value"))


def as_of(points: DataFrame, facts: DataFrame, value: Column, at: str = "at_ms", out: str = "last") -> DataFrame:
    """Points with the newest fact at or before them: one sort per run, no join."""
    p = points.select("*", F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    f = facts.select(RUN, at, F.lit(0).alias("_side"), F.struct(value.alias("value"), F.col(at).alias("at_ms")).alias("_v"))
    w = Window.partitionBy(RUN).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.drop("_v").unionByName(f, allowMissingColumns=True)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def nearest(points: DataFrame, facts: DataFrame, at: str = "at_ms", fact_id: str = "fact_id") -> DataFrame:
    """Points with the fact nearest in time (ties: the earlier): the last one before and the first one after, by two windows."""
    p = points.select("*", F.lit(1).alias("_side"))
    f = facts.select(RUN, at, F.lit(0).alias("_side"), F.struct(F.col(at).alias("at_ms"), F.col(fact_id).alias("id")).alias("_v"))
    both = p.unionByName(f, allowMissingColumns=True)
    before = F.last("_v", ignorenulls=True).over(Window.partitionBy(RUN).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_v", ignorenulls=True).over(Window.partitionBy(RUN).orderBy(at, "_side").rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("_before", before).withColumn("_after", after).where("_side = 1")
    left, right = F.col(at) - F.col("_before.at_ms"), F.col("_after.at_ms") - F.col(at)
    pick = F.when(F.col("_after").isNull() | (left <= right), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn("_pick", pick).where("_pick is not null").withColumns({"near_id": F.col("_pick.id"), "distance_ms": F.abs(F.col("_pick.at_ms") - F.col(at))}).drop("_side", "_v", "_before", "_after", "_pick")


def remap(points: DataFrame, cuts: DataFrame, at: str = "at_ms", out: str = "new_ms") -> DataFrame:
    """Times after the cuts are taken out; a time inside a cut moves to its start."""
    c = union(cuts)
    w = Window.partitionBy(RUN).orderBy("start_ms")
    done = c.withColumn("removed", F.sum(F.col("end_ms") - F.col("start_ms")).over(w)).withColumn(at, F.col("start_ms"))
    near = as_of(points, done, F.struct("start_ms", "end_ms", "removed"), at, "_cut")
    v = F.col("_cut.value")
    inside = F.col(at) < v.end_ms
    new = F.when(v.isNull(), F.col(at)).when(inside, v.start_ms - (v.removed - (v.end_ms - v.start_ms))).otherwise(F.col(at) - v.removed)
    return near.withColumn(out, new).drop("_cut")
