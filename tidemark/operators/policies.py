"""Rules that decide about single rows: edit warnings, statements that may not be made, observations from recorded answers, states and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clock, edges, hashed_id

RUN = "run_id"
# Openings that lead on, voices of a quoted clip, words that propose an edit, and what stills cannot show.
TRANSITION = r"(?i)^(and |so |now )?(it starts with|here'?s (how|what|why)|first(ly)?,? |next,? |let'?s (look|start|talk)|the (first|second|third|next|last) (step|thing|part|element)|which brings|that brings|this is where)"
QUOTED_VOICE = r"(?i)^(bro|dude|guys|oh my (god|gosh))\b"
PROPOSES_EDIT = r"(?i)\b(cut|remove|replace|omit|trim|tighten|delete|rewrite|shorten|drop)\b"
BANNED = {
    "audio_claim": r"(?i)\b(music|song|soundtrack|sound effects?|sfx|background audio|voice(?:-| )?over tone|tone of voice|loud|quiet|audio)\b",
    "emotion_or_mind": r"(?i)\b(bored|boring|excited|exciting|confident|nervous|anxious|happy|sad|angry|frustrated|enthusiastic|passionate|sincere|insecure|annoyed|engaging|engaged|interesting|captivating)\b",
    "prediction": r"(?i)(\d+\s*%|\bpercent\b|\bretention\b|\bviewers? (?:will|would|might|may) (?:leave|drop|stop|click)|\bdrop[- ]?off\b|\bengagement\b)",
}
CERTAINTY = {"clear": "supported", "likely": "provisional", "uncertain": "provisional"}
SEVERITIES = ("high", "medium", "low")


def edit_warnings(quotes: DataFrame, hooks: DataFrame, segments: DataFrame) -> DataFrame:
    """quotes (run_id, quote_id, text, start_ms, answer) that an answer proposing an edit should leave alone, with the first reason: question,
    hook (within three seconds of hooks: run_id, hook_ms), transition, quoted_voice (the segment that holds the quote's start)."""
    q = quotes.where(F.col("answer").rlike(edges(PROPOSES_EDIT))).join(hooks.select(RUN, "hook_ms"), RUN, "left")
    # The last segment that begins at or before the quote, with the quote's own rows: one sort per run.
    both = segments.select(RUN, F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.struct("end_ms", "text").alias("seg"), F.lit(None).cast("string").alias("quote_id"))
    both = both.unionByName(q.where("start_ms is not null").select(RUN, F.col("start_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(both.schema["seg"].dataType).alias("seg"), F.col("quote_id").cast("string").alias("quote_id")))
    over = F.last("seg", True).over(Window.partitionBy(RUN).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    within = both.withColumn("seg", over).where("kind = 1 and at <= seg.end_ms").select(RUN, F.col("quote_id").alias("_id"), F.col("seg.text").alias("said"))
    q = q.withColumn("_id", F.col("quote_id").cast("string")).join(within, [RUN, "_id"], "left")
    near = F.abs(F.col("start_ms") - F.col("hook_ms")) < 3000
    why = F.when(F.rtrim("text").endswith("?"), "question").when(near, "hook").when(F.col("text").rlike(TRANSITION), "transition").when(F.trim("said").rlike(edges(QUOTED_VOICE)), "quoted_voice")
    return q.withColumn("reason", why).where("reason is not null").select(RUN, "quote_id", "reason")


def banned_reason(text: Column) -> Column:
    """Why a statement from stills may not be made; null if it may."""
    out = None
    for name, pattern in BANNED.items():
        hit = F.coalesce(text, F.lit("")).rlike(edges(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def observations(answers: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observations, coverage, dropped) from recorded visual answers.

    answers: run_id, clip, status, start_ms, end_ms (the clip's core), items (array of statement, certainty, frames: labels). frames: run_id, clip, ref, at_ms.
    A statement lasts from its first core frame to a second after its last; without a core frame, or if stills cannot show it, it is dropped.
    A clip without a complete answer covers nothing.
    """
    cover = answers.select(RUN, "clip", "start_ms", "end_ms", F.when(F.col("status") == "complete", "observed").otherwise("unknown").alias("status"), F.when(F.col("status") != "complete", F.concat(F.lit("clip "), F.col("clip").cast("string"), F.lit(" "), F.col("status"))).alias("reason"))
    d = answers.where("status = 'complete'").select(RUN, "clip", "start_ms", "end_ms", F.posexplode("items").alias("n", "x")).withColumn("why", banned_reason(F.col("x.statement")))
    seen = d.where("why is null").select(RUN, "clip", "n", "start_ms", "end_ms", F.explode("x.frames").alias("ref")).join(frames, [RUN, "clip", "ref"]).where("at_ms >= start_ms and at_ms < end_ms")
    seen = seen.groupBy(RUN, "clip", "n").agg(F.min("at_ms").alias("a"), F.max("at_ms").alias("z"), F.array_sort(F.collect_set("ref")).alias("refs"))
    d = d.join(seen, [RUN, "clip", "n"], "left").withColumn("why", F.when(F.col("why").isNull() & F.col("a").isNull(), "no core frame").otherwise(F.col("why")))
    end = F.greatest(F.least("end_ms", F.col("z") + 1000), F.col("a") + 1)
    kept = F.create_map(*[F.lit(x) for kv in CERTAINTY.items() for x in kv])
    name = hashed_id("ob_", F.col(RUN).cast("string"), F.col("clip").cast("string"), F.col("n").cast("string"))
    made = d.where("why is null").select(RUN, name.alias("observation_id"), "clip", F.col("a").alias("start_ms"), end.alias("end_ms"), F.col("x.statement").alias("statement"), F.try_element_at(kept, F.col("x.certainty")).alias("status"), "refs")
    return made, cover, d.where("why is not null").select(RUN, "clip", "n", F.col("why").alias("reason"))


def project_states(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """project_id, state: ready with an analysis among its runs (project_id, package_kind), partial with other runs, else awaiting_analysis."""
    r = runs.groupBy("project_id").agg(F.bool_or(F.col("package_kind") == "analysis").alias("ready"))
    return projects.select("project_id").join(r, "project_id", "left").select("project_id", F.when(F.col("ready").isNull(), "awaiting_analysis").when(F.col("ready"), "ready").otherwise("partial").alias("state"))


def all_findings(model: DataFrame, issues: DataFrame) -> DataFrame:
    """run_id, place, source, id of a run's findings, the best first.

    model: run_id, finding_id, severity, strength, start_ms, rank (null: none). issues: run_id, issue_id, severity, evidence_status, review_status, start_ms;
    dismissed ones are left out, the others rank from 500 on in their order. Ranks count if the model gave any in the run; then severity, support, start.
    """
    w = Window.partitionBy(RUN).orderBy("issue_id")
    m = model.select(RUN, F.lit("model").alias("source"), F.col("finding_id").cast("string").alias("id"), "severity", (F.col("strength") == "supported").alias("firm"), "start_ms", F.coalesce("rank", F.lit(1000)).alias("rank"))
    i = issues.where("review_status != 'dismissed'").select(RUN, F.lit("issue").alias("source"), F.col("issue_id").cast("string").alias("id"), "severity", (F.col("evidence_status") == "supported").alias("firm"), "start_ms", (F.row_number().over(w) + 499).alias("rank"))
    d = m.unionByName(i).withColumn("_given", F.max(((F.col("source") == "model") & (F.col("rank") < 1000)).cast("int")).over(Window.partitionBy(RUN)))
    order = [F.when(F.col("_given") == 1, F.col("rank")).otherwise(0), F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")), F.when(F.col("firm"), 0).otherwise(1), "start_ms", "source", "id"]
    return d.select(RUN, F.row_number().over(Window.partitionBy(RUN).orderBy(*order)).alias("place"), "source", "id")


def headline(start_ms: Column, end_ms: Column, what: Column, why: Column) -> Column:
    """A sentence for a drop moment from its main cause; without one, what the scenario shows."""
    when = F.concat(clock(start_ms), F.lit("–"), clock(end_ms), F.lit(": "))
    return F.when(what.isNull(), F.concat(when, F.lit("scenario loss above the neutral video."))).otherwise(F.concat(when, what, F.lit("; "), why, F.lit(".")))


def script_signals(signals: DataFrame, source_kind: str) -> DataFrame:
    """A script's signals are text; what only speech has (fillers, language switches) is left out."""
    return signals if source_kind != "script" else signals.where(~F.col("name").isin("filler_rate", "language_switch")).withColumn("modality", F.lit("text"))
