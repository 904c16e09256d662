"""Passes over a run in order whose result at a row depends on what was chosen before, without a whole run in one task.

Greedy segmentation: where a group that begins at a row ends depends on that row alone, so every row gets a pointer to the next group's
first row, and pointer doubling marks those that the run's first row leads to, in as many rounds as the number of groups has binary digits.
Frames against the last one kept: cut where two neighbours are so far apart that the later one is kept whatever came before.
Windows by turns: one choice for every run a round, until no run has a candidate or `most` are chosen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import word_count
from tidemark.sources.working import written

RUN = "run_id"
#: Rows, or values of a running sum, that a window holds.
BLOCK = 4096


# -- greedy segmentation ----------------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, order: str, size: Column) -> DataFrame:
    """rows with i (dense place in the run, from 0), n, before and upto (running sum of n without and with the row), by blocks of `order`."""
    d = rows.withColumns({"n": F.coalesce(size.cast("bigint"), F.lit(0)), "block": F.floor(F.col(order) / BLOCK)})
    sums = d.groupBy(RUN, "block").agg(F.count("*").alias("rows"), F.sum("n").alias("sum"))
    earlier = Window.partitionBy(RUN).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(RUN, "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("rows", "sum")])
    inside = Window.partitionBy(RUN, "block").orderBy(order)
    d = d.withColumns({"i": F.row_number().over(inside) - 1, "upto": F.sum("n").over(inside)}).join(sums, [RUN, "block"])
    d = d.withColumns({"i": F.col("i") + F.col("rows_before"), "upto": F.col("upto") + F.col("sum_before")}).withColumn("before", F.col("upto") - F.col("n"))
    return d.drop("block", "rows_before", "sum_before")


def first_from(points: DataFrame, asked: DataFrame, marks: Sequence[str]) -> DataFrame:
    """asked (run_id, i, ask, v) with, for every mark m, first_m: the least i of points (run_id, i, v, marks as booleans) with that mark and at least v.

    Both meet in blocks of v; what is not in v's own block is the first of the next block that has one.
    """
    block = F.floor(F.col("v") / BLOCK).alias("block")
    p = points.select(RUN, F.lit(0).alias("kind"), "i", F.lit(None).cast("string").alias("ask"), "v", block, *[F.when(F.col(m), F.col("i")).alias(m) for m in marks])
    a = asked.select(RUN, F.lit(1).alias("kind"), "i", "ask", "v", block, *[F.lit(None).cast("bigint").alias(m) for m in marks])
    inside = Window.partitionBy(RUN, "block").orderBy(F.desc("v"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = p.unionByName(a)
    later = Window.partitionBy(RUN).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(RUN, "block").agg(*[F.min(m).alias(m) for m in marks]).select(RUN, "block", *[F.min(m).over(later).alias(f"next_{m}") for m in marks])
    out = both.withColumns({f"own_{m}": F.min(m).over(inside) for m in marks}).where("kind = 1").join(firsts, [RUN, "block"])
    return out.select(RUN, "i", "ask", *[F.coalesce(f"own_{m}", f"next_{m}").alias(f"first_{m}") for m in marks])


def chained(nexts: DataFrame) -> DataFrame:
    """run_id, i of the rows that each run's row 0 leads to along nexts (run_id, i, to; to null or greater than i), row 0 included."""
    jump = written(nexts.where("to is not null").select(RUN, "i", "to"), "jumps")
    found = written(nexts.where("i = 0").select(RUN, "i"), "starts")
    while True:
        new = written(found.join(jump, [RUN, "i"]).select(RUN, F.col("to").alias("i")), "starts")
        if new.isEmpty():
            return found
        found = found.unionByName(new)
        ahead = jump.select(RUN, F.col("i").alias("to"), F.col("to").alias("further"))
        jump = written(jump.join(ahead, [RUN, "to"]).select(RUN, "i", F.col("further").alias("to")), "jumps")


def numbered(rows: DataFrame, starts: DataFrame, out: str) -> DataFrame:
    """rows (with i) with `out`: how many starts are at or before the row."""
    d = rows.join(starts.withColumn("start", F.lit(1)), [RUN, "i"], "left").withColumns({"start": F.coalesce("start", F.lit(0)), "block": F.floor(F.col("i") / BLOCK)})
    sums = d.groupBy(RUN, "block").agg(F.sum("start").alias("sum"))
    earlier = Window.partitionBy(RUN).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(RUN, "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("sum"))
    own = F.sum("start").over(Window.partitionBy(RUN, "block").orderBy("i"))
    return d.withColumn(out, own).join(sums, [RUN, "block"]).withColumn(out, F.col(out) + F.col("sum")).drop("block", "sum", "start")


def paragraphs(segments: DataFrame, least: int = 100, most: int = 200) -> DataFrame:
    """run_id, paragraph, first, last, n_words: closed at a sentence end from `least` words on, or before exceeding `most` if it has half of `least`."""
    d = placed(segments.select(RUN, "seg_idx", "text"), "seg_idx", word_count(F.coalesce("text", F.lit(""))))
    d = written(d.withColumn("ends", F.coalesce(F.rtrim("text").rlike(r"[.?!।]$"), F.lit(False))).drop("text"), "placed")
    asks = F.array(*[F.struct(F.lit(k).alias("ask"), (F.col("before") + v).alias("v")) for k, v in (("full", least), ("half", least // 2), ("over", most + 1))])
    points = d.select(RUN, "i", F.col("upto").alias("v"), "ends", F.lit(True).alias("any"))
    found = first_from(points, d.select(RUN, "i", F.inline(asks)), ["ends", "any"])
    of = lambda ask, c: F.max(F.when(F.col("ask") == ask, F.col(c)))
    at = found.groupBy(RUN, "i").agg((of("full", "first_ends") + 1).alias("after"), (of("half", "first_any") + 1).alias("half"), of("over", "first_any").alias("over"))
    before = F.when(F.col("half").isNotNull() & F.col("over").isNotNull(), F.greatest("half", "over"))
    out = numbered(d, chained(at.select(RUN, "i", F.least("after", before).alias("to"))), "paragraph")
    return out.groupBy(RUN, F.col("paragraph").cast("int").alias("paragraph")).agg(F.min("seg_idx").alias("first"), F.max("seg_idx").alias("last"), F.sum("n").cast("int").alias("n_words"))


def batches(df: DataFrame, order: str, size: Column, most: int = 12, most_size: int = 40_000) -> DataFrame:
    """run_id, order, batch: consecutive rows under both limits; a row over most_size has a batch of its own."""
    d = written(placed(df.select(RUN, order, size.alias("_size")), order, F.col("_size")).drop("_size"), "placed")
    asked = d.select(RUN, "i", F.lit("over").alias("ask"), (F.col("before") + most_size + 1).alias("v"))
    found = first_from(d.select(RUN, "i", F.col("upto").alias("v"), F.lit(True).alias("any")), asked, ["any"])
    to = F.least(F.col("i") + most, F.when(F.col("first_any").isNotNull(), F.greatest(F.col("i") + 1, F.col("first_any"))))
    return numbered(d, chained(found.select(RUN, "i", to.alias("to"))), "batch").select(RUN, order, (F.col("batch") - 1).cast("int").alias("batch"))


# -- frames against the last one kept ---------------------------------------------------------------------------------------------


def difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of numbers of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.greatest(F.lit(1), F.size(a))


def reused(frames: DataFrame, limit: float = 0.6) -> DataFrame:
    """run_id, at_ms, reused_from: the last kept frame, if a frame (run_id, at_ms, signature: array of double) differs from it by less than `limit`; else
    null, and the frame is kept.

    A frame that was not kept is within `limit` of the last kept one; so one that is twice as far from its neighbour is kept anyway, and a new
    stretch begins. Null or other-sized signatures are kept and match nothing.
    """
    w = Window.partitionBy(RUN).orderBy("at_ms")
    d = frames.select(RUN, "at_ms", "signature").withColumn("last", F.lag("signature").over(w))
    same = (F.size("last") == F.size("signature")) & (difference(F.col("last"), F.col("signature")) < 2 * limit)
    d = d.withColumn("cut", F.when(same, 0).otherwise(1)).withColumn("stretch", F.sum("cut").over(w)).drop("last", "cut")
    kind = next(f.dataType.simpleString() for f in frames.schema if f.name == RUN)

    def follow(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = kept = kept_ms = None
        for batch in batches:
            out = []
            for run, stretch, at_ms, signature in zip(batch[RUN], batch["stretch"], batch["at_ms"], batch["signature"], strict=True):
                now = None if signature is None else np.asarray(signature, float)
                if (run, stretch) == where and now is not None and kept is not None and len(now) == len(kept) and np.abs(now - kept).sum() / max(1, len(now)) < limit:
                    out.append(kept_ms)
                else:
                    where, kept, kept_ms = (run, stretch), now, at_ms
                    out.append(None)
            yield pd.DataFrame({RUN: batch[RUN], "at_ms": batch["at_ms"], "reused_from": pd.array(out, "Int64")})

    return d.repartition(RUN, "stretch").sortWithinPartitions(RUN, "stretch", "at_ms").mapInPandas(follow, f"{RUN} {kind}, at_ms bigint, reused_from bigint")


# -- windows by turns -------------------------------------------------------------------------------------------------------------


def by_turns(candidates: DataFrame, reasons: Sequence[str], most: int = 8) -> DataFrame:
    """run_id, turn, reason, start_ms, end_ms, score: each reason in turn takes its best-scored window (ties: the earlier) that overlaps none
    taken so far; a reason without one is passed over. candidates: run_id, reason, start_ms, end_ms, score.

    A taken window removes what it overlaps, so every round needs the best of what is left alone; a run takes one window a round.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in reasons]), F.col("reason")) - 1
    left = written(candidates.select(RUN, rank.cast("int").alias("r"), "start_ms", "end_ms", "score").where("r >= 0 and end_ms > start_ms"), "candidates")
    last, taken = None, []
    for turn in range(most):
        best = left.groupBy(RUN, "r").agg(F.min(F.struct((-F.col("score")).alias("back"), "start_ms", "end_ms")).alias("b"))
        best = best.withColumn("after", F.lit(-1)) if last is None else best.join(last.select(RUN, F.col("r").alias("after")), RUN)
        wait = F.pmod(F.col("r") - F.col("after") - 1, F.lit(len(reasons)))
        last = written(best.groupBy(RUN).agg(F.min_by(F.struct("r", "b.start_ms", "b.end_ms", (-F.col("b.back")).alias("score")), wait).alias("x")).select(RUN, F.lit(turn).alias("turn"), "x.*"), "taken")
        if last.isEmpty():
            break
        taken.append(last)
        if turn + 1 < most:
            now = last.select(RUN, F.col("start_ms").alias("a"), F.col("end_ms").alias("z"))
            left = written(left.join(now, RUN).where((F.col("start_ms") >= F.col("z")) | (F.col("end_ms") <= F.col("a"))).drop("a", "z"), "candidates")
    out = taken[0] if taken else last
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select(RUN, "turn", F.element_at(F.array(*[F.lit(r) for r in reasons]), F.col("r") + 1).alias("reason"), "start_ms", "end_ms", "score")


def refinements(texts: DataFrame, cuts: DataFrame, motion: DataFrame, runs: DataFrame, height: int, most: int = 8) -> DataFrame:
    """Windows of ten seconds at most worth a closer look, by turns: small text, many cuts, much motion.

    texts: run_id, start_ms, y0, y1, confidence; cuts: run_id, at_ms; motion: run_id, at_ms, value; runs: run_id, end_ms.
    """
    share = (F.col("y1") - F.col("y0")) / height
    small = texts.where((share < 0.035) & (F.col("confidence") >= 0.5)).select(RUN, F.lit("small_text").alias("reason"), F.greatest(F.lit(0), F.col("start_ms") - 1000).alias("start_ms"), (1 - share / 0.035).alias("score"))
    # A cut is in the two windows of ten seconds, five apart, that hold it.
    step = F.floor(F.col("at_ms") / 5000)
    many = cuts.select(RUN, F.explode(F.array(step, step - 1)).alias("k")).where("k >= 0").groupBy(RUN, "k").agg(F.count("*").alias("n")).where("n >= 5")
    many = many.select(RUN, F.lit("fast_cuts").alias("reason"), (F.col("k") * 5000).alias("start_ms"), (F.col("n") / 10.0).alias("score"))
    # The value at the place 0.98 n of the sorted ones, from counted values.
    w = Window.partitionBy(RUN).orderBy("value")
    counted = motion.where("value is not null").groupBy(RUN, "value").agg(F.count("*").alias("k"))
    counted = counted.withColumns({"upto": F.sum("k").over(w), "n": F.sum("k").over(Window.partitionBy(RUN))})
    place = F.floor(0.98 * F.col("n"))
    limit = counted.where((F.col("n") > 20) & (F.col("upto") > place) & (F.col("upto") - F.col("k") <= place)).select(RUN, F.col("value").alias("limit"))
    fast = motion.join(limit, RUN).where((F.col("value") >= F.col("limit")) & (F.col("value") > 0.05))
    fast = fast.select(RUN, F.lit("fast_action").alias("reason"), F.greatest(F.lit(0), F.col("at_ms") - 3000).alias("start_ms"), F.col("value").alias("score"))
    every = small.unionByName(many).unionByName(fast).join(runs.select(RUN, F.col("end_ms").alias("_end")), RUN)
    every = every.withColumn("end_ms", F.least("_end", F.col("start_ms") + 10_000)).where("start_ms < _end and end_ms - start_ms >= 2000")
    return by_turns(every.drop("_end"), ["small_text", "fast_cuts", "fast_action"], most)


def tiered(frames: DataFrame, keys: list[str], tier: Column, order: str, most: int) -> DataFrame:
    """At most `most` rows of each group, tier after tier (0 first; null never); in the tier that has too many, evenly spaced from its first row on."""
    d = frames.withColumn("_tier", tier).where("_tier is not null")
    counts = d.groupBy(*keys, "_tier").agg(F.count("*").alias("_n"))
    room = most - F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_room", room).where("_room > 0")
    d = d.join(counts, [*keys, "_tier"]).withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_tier").orderBy(order)) - 1)
    step = F.col("_n") / F.col("_room")
    k = F.floor(F.col("_i") / step)
    hit = lambda j: (j < F.col("_room")) & (F.floor(j * step) == F.col("_i"))
    return d.where((F.col("_n") <= F.col("_room")) | hit(k) | hit(k + 1)).drop("_tier", "_n", "_room", "_i")


def frame_tier(role: str = "role", reasons: str = "reasons") -> Column:
    """Frames of the core before its context: those of the grid, after a cut, of the context's grid, the core's rest, the rest."""
    has = lambda r: F.array_contains(reasons, r)
    core = F.coalesce(F.col(role), F.lit("core")) == "core"
    return F.when(core & has("uniform_1fps"), 0).when(core & has("shot_boundary_after"), 1).when(~core & has("uniform_1fps"), 2).when(core, 3).otherwise(4)
