"""Per-second features of runs as long tables (run_id, t, feature, value), and what is measured over them.

runs: run_id, duration_ms. Where several sources touch one second, the largest value holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import CONCRETE, content_runs, edges, word_count
from tidemark.operators.intervals import RUN, overlap_ms, to_bins

# Words and phrases that fill pauses.
FILLERS = ("um", "uh", "erm", "uhm", "ah", "hmm", "you know", "i mean", "kind of", "sort of", "basically", "literally")


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def put(runs: DataFrame, spans: DataFrame, feature: str, value: Column) -> DataFrame:
    """The value over each second that a span touches, weighed by the share of the second; the last second may be shorter."""
    x = to_bins(spans.withColumn("_v", value), 1000).join(runs.select(RUN, "duration_ms"), RUN).where(F.col("bin") * 1000 < F.col("duration_ms"))
    stop = F.least((F.col("bin") + 1) * 1000, F.col("duration_ms"))
    share = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("bin") * 1000, stop) / (stop - F.col("bin") * 1000)
    return x.groupBy(RUN, F.col("bin").cast("int").alias("t")).agg(F.max(F.col("_v") * share).alias("value")).select(RUN, "t", F.lit(feature).alias("feature"), "value")


def pulse(runs: DataFrame, events: DataFrame, feature: str, length_s: int = 3) -> DataFrame:
    """1 in the second of an event (at_ms), fading to nothing over length_s seconds; nothing after the run's end."""
    x = events.select(RUN, F.floor(F.col("at_ms") / 1000).alias("_t0"), F.explode(F.sequence(F.lit(0), F.lit(length_s - 1))).alias("_k"))
    x = x.select(RUN, (F.col("_t0") + F.col("_k")).cast("int").alias("t"), (1 - F.col("_k") / length_s).alias("value"))
    x = x.join(runs.select(RUN, F.ceil(F.col("duration_ms") / 1000).alias("_n")), RUN).where((F.col("t") >= 0) & (F.col("t") < F.col("_n")))
    return x.groupBy(RUN, "t").agg(F.max("value").alias("value")).select(RUN, "t", F.lit(feature).alias("feature"), "value")


def longest_sentence(text: Column) -> Column:
    """Words of the longest stretch between sentence marks; 0 for texts without a word."""
    return F.coalesce(F.array_max(F.transform(F.split(text, r"[.!?]+"), word_count)), F.lit(0))


def concrete(runs: DataFrame, segments: DataFrame) -> DataFrame:
    return put(runs, segments.where(F.col("text").rlike(edges(CONCRETE))), "concrete", F.lit(1.0))


def long_sentences(runs: DataFrame, segments: DataFrame, least: int = 30, scale: int = 20) -> DataFrame:
    """Segments with a sentence mark and a sentence of more than `least` words."""
    s = segments.withColumn("_longest", longest_sentence(F.col("text"))).where((F.col("_longest") > least) & F.col("text").rlike("[.!?]"))
    return put(runs, s, "long_sentences", clip((F.col("_longest") - least) / scale))


def filler_count(text: Column) -> Column:
    """Fillers in the text; every listed word or phrase counts by itself, set off by spaces."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\w\s']", " "), F.lit(" "))
    return sum((F.regexp_count(t, F.lit(rf"(?<=\s){w}(?=\s)")) for w in FILLERS[1:]), F.regexp_count(t, F.lit(rf"(?<=\s){FILLERS[0]}(?=\s)")))


def filler_density(runs: DataFrame, segments: DataFrame, reach_s: int = 10, least: int = 2, per_min: float = 6.0) -> DataFrame:
    """Fillers a minute over the seconds around t, from `least` on; a segment's fillers count at its middle."""
    s = segments.withColumn("n", filler_count(F.col("text"))).where("n > 0").withColumn("mid", F.floor((F.col("start_ms") + F.col("end_ms")) / 2))
    # Every second within reach of a middle: at most 2 * reach_s + 1 rows a segment, no range join.
    first = F.greatest(F.lit(0), F.ceil((F.col("mid") - reach_s * 1000) / 1000))
    x = s.select(RUN, "n", F.explode(F.sequence(first.cast("int"), F.floor((F.col("mid") + reach_s * 1000) / 1000).cast("int"))).alias("t"))
    x = x.groupBy(RUN, "t").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    x = x.join(runs.select(RUN, F.ceil(F.col("duration_ms") / 1000).alias("_n")), RUN).where(F.col("t") < F.col("_n"))
    return x.select(RUN, "t", F.lit("filler_density").alias("feature"), clip(F.col("n") * (60 / (2 * reach_s)) / per_min).alias("value"))


def shots(boundaries: DataFrame, runs: DataFrame) -> DataFrame:
    """Contiguous shots between boundaries (run_id, at_ms, source): each ends at the next one or at the run's end.

    Several boundaries at one time are one (the least source); a shot tells what began and what ended it.
    """
    b = boundaries.groupBy(RUN, "at_ms").agg(F.min("source").alias("began_by")).join(runs.select(RUN, "duration_ms"), RUN).where(F.col("at_ms") < F.col("duration_ms"))
    w = Window.partitionBy(RUN).orderBy("at_ms")
    end = F.coalesce(F.lead("at_ms").over(w), F.col("duration_ms"))
    return b.select(RUN, (F.row_number().over(w) - 1).alias("shot"), F.col("at_ms").alias("start_ms"), end.alias("end_ms"), "began_by", F.lead("began_by").over(w).alias("ended_by"))


def static_shots(shots_: DataFrame, least_ms: int = 8000, times: float = 3.0, share: float = 0.25, least_shots: int = 4) -> DataFrame:
    """long_static_shot: seconds of a shot beyond max(least_ms, times * median shot), where its motion is at or under the run's
    nearest-rank `share` of known motions (at least least_shots of them). Ramps from 0.5 to 1 over one more limit."""
    w = Window.partitionBy(RUN)
    limit = shots_.where("end_ms > start_ms").groupBy(RUN).agg(F.greatest(F.lit(float(least_ms)), times * F.median(F.col("end_ms") - F.col("start_ms"))).alias("_limit"))
    known = shots_.where("motion is not null").select(RUN, F.col("motion").alias("_low"), (F.row_number().over(w.orderBy("motion")) - 1).alias("_i"), F.count("*").over(w).alias("_n"))
    low = known.where((F.col("_n") >= least_shots) & (F.col("_i") == F.bround(share * (F.col("_n") - 1), 0))).select(RUN, "_low")
    x = shots_.join(limit, RUN).join(low, RUN).where((F.col("end_ms") - F.col("start_ms") > F.col("_limit")) & (F.col("motion") <= F.col("_low")))
    first, last = F.ceil((F.col("start_ms") + F.col("_limit")) / 1000).cast("int"), F.ceil(F.col("end_ms") / 1000).cast("int") - 1
    x = x.where(last >= first).withColumn("t", F.explode(F.sequence(first, last)))
    value = clip(0.5 + 0.5 * (F.col("t") * 1000 - F.col("start_ms") - F.col("_limit")) / F.col("_limit"))
    return x.groupBy(RUN, "t").agg(F.max(value).alias("value")).select(RUN, "t", F.lit("long_static_shot").alias("feature"), "value")


def cut_distances(seconds: DataFrame, cuts: DataFrame) -> DataFrame:
    """seconds (run_id, t) with the seconds since the last cut and to the next one; cuts: run_id, at_ms."""
    both = seconds.select(RUN, (F.col("t") * 1000).cast("bigint").alias("at_ms"), F.col("t").alias("_t"), F.lit(1).alias("_side")).unionByName(cuts.select(RUN, "at_ms", F.lit(None).cast("int").alias("_t"), F.lit(0).alias("_side")))
    cut = F.when(F.col("_side") == 0, F.col("at_ms"))
    before = F.max(cut).over(Window.partitionBy(RUN).orderBy("at_ms").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(cut).over(Window.partitionBy(RUN).orderBy("at_ms").rangeBetween(1, Window.unboundedFollowing))
    x = both.withColumns({"since_s": (F.col("at_ms") - before) / 1000, "until_s": (after - F.col("at_ms")) / 1000})
    return x.where("_side = 1").select(RUN, F.col("_t").alias("t"), "since_s", "until_s")


def smoothed(series: DataFrame, value: str, order: str, reach: int = 2, out: str = "smooth") -> DataFrame:
    """Mean of the value over `reach` rows on both sides."""
    return series.withColumn(out, F.avg(value).over(Window.partitionBy(RUN).orderBy(order).rowsBetween(-reach, reach)))


def trailing_median(series: DataFrame, value: Column, order: str = "t", reach: int = 10, least: int = 5, out: str = "usual") -> DataFrame:
    """Median of the known values over the `reach` steps before each row; null where fewer than `least` are known."""
    w = Window.partitionBy(RUN).orderBy(order).rangeBetween(-reach, -1)
    x = series.withColumn("_v", value)
    # median() takes no frame; the frame holds `reach` values at most.
    x = x.withColumn("_v", F.array_sort(F.collect_list("_v").over(w))).withColumn("_n", F.size("_v"))
    at = lambda k: F.get("_v", F.floor(k).cast("int"))
    return x.withColumn(out, F.when(F.col("_n") >= least, (at((F.col("_n") - 1) / 2) + at(F.col("_n") / 2)) / 2)).drop("_v", "_n")


def adjacent_windows(windows: DataFrame, flag: Column, least: int = 2) -> DataFrame:
    """Stretches of at least `least` flagged windows, each of which starts where the one before ends."""
    w = Window.partitionBy(RUN).orderBy("start_ms")
    x = windows.where(flag).withColumn("_new", F.when(F.lag("end_ms").over(w) == F.col("start_ms"), 0).otherwise(1))
    x = x.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(RUN, "_k").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("windows")).where(F.col("windows") >= least).drop("_k")


def best_earlier(segments: DataFrame) -> DataFrame:
    """run_id, seg_idx, earlier, share: for each segment the earlier one of its run with the largest share of its runs of three content words (ties: the first).

    Segments with equal three-word runs are compared once: a repeated line has its first occurrence, or an earlier line that holds
    all of it. The equi-join on (run, three-word run) then meets distinct lines only.
    """
    g = segments.select(RUN, "seg_idx", F.array_sort(content_runs(F.col("text"))).alias("_g")).where(F.size("_g") > 0).withColumn("_line", F.md5(F.array_join("_g", "|")))
    lines = g.groupBy(RUN, "_line").agg(F.min_by("_g", "seg_idx").alias("_g"), F.min("seg_idx").alias("_first"))
    one = lines.select(RUN, "_first", F.size("_g").alias("_n"), F.explode("_g").alias("_g"))
    x = one.join(one.select(RUN, F.col("_first").alias("earlier"), "_g"), [RUN, "_g"]).where("earlier < _first")
    x = x.groupBy(RUN, "_first", "earlier").agg((F.count("*") / F.first("_n")).alias("share"))
    best = x.groupBy(RUN, "_first").agg(F.max(F.struct("share", (-F.col("earlier")).alias("e"))).alias("_b"))
    out = g.select(RUN, "seg_idx", "_line").join(lines.select(RUN, "_line", "_first"), [RUN, "_line"]).join(best, [RUN, "_first"], "left")
    again = F.col("seg_idx") > F.col("_first")
    held = again & F.coalesce(F.col("_b.share") < 1, F.lit(True))
    out = out.select(RUN, "seg_idx", F.when(held, F.col("_first")).otherwise(-F.col("_b.e")).alias("earlier"), F.when(again, 1.0).otherwise(F.col("_b.share")).alias("share"))
    return out.where("earlier is not null")
