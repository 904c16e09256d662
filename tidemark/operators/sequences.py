"""Order-dependent operators over a run's segments: first occurrence, greedy folds, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_runs, content_words, word_count
from tidemark.operators.passes import paragraphs  # noqa: F401 (part of this module's interface)

RUN = "run_id"


def first_use(df: DataFrame, items: Column, out: str = "item", order: str = "seg_idx") -> DataFrame:
    """A row per segment and distinct item, with `is_new`: the run has not had it in an earlier segment.

    Linear in the items, where a running set of all items seen so far would be quadratic.
    """
    x = df.select(RUN, order, F.explode(F.array_distinct(items)).alias(out))
    return x.withColumn("is_new", F.min(order).over(Window.partitionBy(RUN, out)) == F.col(order))


def novelty(segments: DataFrame, text: str = "text") -> DataFrame:
    """run_id, seg_idx, n_words, new_share of content words (1 without any), reused_share of runs of three, repeats.

    Words and runs go through one aggregate, told apart by a kind: of the items that a run has, each counts as new for the segment that has it
    first. Of a segment's other items only their number is asked for. run_id and seg_idx name a segment.
    """
    kinds = F.array(F.struct(F.lit(0).alias("kind"), content_words(F.col(text)).alias("items")), F.struct(F.lit(1).alias("kind"), content_runs(F.col(text)).alias("items")))
    x = segments.select(RUN, "seg_idx", F.inline(kinds)).select(RUN, "seg_idx", "kind", F.explode("items").alias("item"))
    x = x.groupBy(RUN, "kind", "item").agg(F.min("seg_idx").alias("seg_idx"))
    x = x.groupBy(RUN, "seg_idx").agg(F.count_if(F.col("kind") == 0).alias("_new"), F.count_if(F.col("kind") == 1).alias("_fresh"))
    n = {"n_words": word_count(F.col(text)), "_words": F.size(content_words(F.col(text))), "_runs": F.size(content_runs(F.col(text)))}
    out = segments.select(RUN, "seg_idx", *[F.coalesce(c, F.lit(0)).alias(k) for k, c in n.items() if k != "n_words"], n["n_words"].alias("n_words")).join(x, [RUN, "seg_idx"], "left").fillna(0, ["_new", "_fresh"])
    new = F.when(F.col("_words") > 0, F.col("_new") / F.col("_words")).otherwise(1.0)
    reused = F.when(F.col("_runs") > 0, (F.col("_runs") - F.col("_fresh")) / F.col("_runs")).otherwise(0.0)
    out = out.select(RUN, "seg_idx", "n_words", new.alias("new_share"), reused.alias("reused_share"))
    return out.withColumn("repeats", (F.col("reused_share") >= 0.5) & (F.col("new_share") < 0.25) & (F.col("n_words") >= 6))


def passages(segments: DataFrame, width: int = 3) -> DataFrame:
    """Overlapping passages of `width` segments, stride one; a run with fewer segments has one passage."""
    w = Window.partitionBy(RUN).orderBy("seg_idx")
    ahead = w.rowsBetween(0, width - 1)
    last = F.max("seg_idx").over(Window.partitionBy(RUN))
    out = segments.withColumn("_last", last).select(RUN, F.col("seg_idx").alias("passage"), "start_ms", F.max("end_ms").over(ahead).alias("end_ms"), F.array_join(F.collect_list("text").over(ahead), " ").alias("text"), "_last")
    return out.where((F.col("passage") + width - 1 <= F.col("_last")) | (F.col("passage") == 0)).drop("_last")


def fold(df: DataFrame, keys: list[str], item: Column, state: Column, merge, finish=None, out: str = "folded") -> DataFrame:
    """A greedy pass over each group's sorted items inside the JVM; for groups bounded by one run."""
    items = F.array_sort(F.collect_list(item))
    return df.groupBy(*keys).agg(items.alias("_items")).select(*keys, F.aggregate("_items", state, merge, finish or (lambda s: s)).alias(out))


def spaced_top(df: DataFrame, score: str, at: str, least_gap: int, most: int, keys: list[str]) -> DataFrame:
    """Best-scored rows at least least_gap apart (ties: the later), at most `most`, in time order."""
    item = F.struct((-F.col(score)).alias("s"), (-F.col(at)).alias("t"))
    start = F.array().cast("array<struct<s:double,t:bigint>>")
    keep = lambda s, x: F.when((F.size(s) < most) & ~F.exists(s, lambda y: F.abs(y.t - x.t) < least_gap), F.concat(s, F.array(F.struct(x.s.cast("double").alias("s"), x.t.cast("bigint").alias("t"))))).otherwise(s)
    out = fold(df, keys, item, start, keep).select(*keys, F.explode("folded").alias("p"))
    return out.select(*keys, (-F.col("p.t")).alias(at), (-F.col("p.s")).alias(score))


def switches(df: DataFrame, value: str, order: str) -> DataFrame:
    """Rows at which the value differs from the one before, nulls left out."""
    w = Window.partitionBy(RUN).orderBy(order)
    out = df.where(F.col(value).isNotNull()).withColumn("previous", F.lag(value).over(w))
    return out.where(F.col("previous") != F.col(value)).select(RUN, order, "previous", value)


def capped(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def evenly(df: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most `most` rows of each group at evenly spaced positions, first and last included."""
    w = Window.partitionBy(*keys)
    x = df.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    slot = F.bround(F.col("_i") * (most - 1) / F.greatest(F.col("_n") - 1, F.lit(1)), 0)
    at = F.bround(slot * (F.col("_n") - 1) / (most - 1), 0)
    return x.where((F.col("_n") <= most) | (at == F.col("_i"))).drop("_i", "_n")


def upper_median_of(df: DataFrame, keys: list[str], value: str, weight: str, out: str) -> DataFrame:
    """keys, out: the middle value of each group (of two the larger), from counted values: a window over distinct values, no arrays."""
    w = Window.partitionBy(*keys).orderBy(value)
    x = df.withColumns({"_upto": F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(weight).over(Window.partitionBy(*keys))})
    middle = F.floor(F.col("_all") / 2) + 1
    return x.where((F.col("_upto") >= middle) & (F.col("_upto") - F.col(weight) < middle)).select(*keys, F.col(value).alias(out))


def outliers_below(df: DataFrame, keys: list[str], value: str, factor: float = 2.5, floor: float = 0.005, least: int = 6) -> DataFrame:
    """df's rows under (upper median - factor * max(upper median deviation, floor)) of their group, with that limit.

    Equal values are counted before they are shuffled; a group is never collected.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    mid = upper_median_of(n, keys, value, "_n", "_mid")
    enough = n.groupBy(*keys).agg(F.sum("_n").alias("_rows")).where(F.col("_rows") >= least).select(*keys)
    away = n.join(mid, keys).groupBy(*keys, F.abs(F.col(value) - F.col("_mid")).alias("_away")).agg(F.sum("_n").alias("_n"))
    limit = mid.join(upper_median_of(away, keys, "_away", "_n", "_mad"), keys).join(enough, keys)
    return df.join(limit.select(*keys, (F.col("_mid") - factor * F.greatest(F.col("_mad"), F.lit(floor))).alias("limit")), keys).where(F.col(value) < F.col("limit"))
