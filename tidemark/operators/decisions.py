"""From recorded answers to tables: structure, promises, issues with their edits, and one table of signals that evidence keys resolve to.

chunks: run_id, chunk, start_ms, end_ms. segments: run_id, seg_idx, chunk, start_ms, end_ms, text. answers: run_id, answer: a struct of
hook (kind, chunk, quote), first_substance_chunk, obligations (array of obligation, title_quote), ledger (array of obligation, status,
setup, partial, fulfilled: arrays of chunks), chapters (array of label, role, first, last), spans (array of kind, chunk, quote).
Defined results: chunks that a run lacks are left out of what they are part of; an answer without hook, or a null one, has no hook.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import clock, hashed_id
from tidemark.operators.contracts import plain
from tidemark.operators.selects import inherited_causes

RUN = "run_id"
# Features of spans and of measured keys (feature, modality, name, unit).
SPAN_FEATURES = {"greeting": "F59", "cta": "F55", "sponsor": "F62", "recap": "F63", "outro": "F64", "viewer_question": "F53", "open_loop": "F54", "tangent_candidate": "F51", "cold_open": "F58"}
KEY_FEATURES = {
    "wpm": ("F40", "speech", "speech_rate", "words/min"), "clip": ("F42", "audio", "clipped_share", "fraction"), "pause": ("F39", "audio", "pause", "ms"),
    "black": ("F06", "visual", "black", "ms"), "static": ("F11", "visual", "low_motion_shot", "ms"),
}
# Measured spans (feature, modality, name) and series (feature, modality, unit).
SPAN_MEASURES = {"black": ("F06", "visual", "black"), "freeze": ("F07", "visual", "freeze"), "silence": ("F39", "audio", "waveform_silence")}
SERIES_MEASURES = {
    "motion_energy": ("F11", "visual", "mean abs frame diff (0-1)"), "luma_mean": ("F23", "visual", "0-1"), "saturation_mean": ("F24", "visual", "0-1"),
    "blur_laplacian_var": ("F26", "visual", "variance"), "short_term_loudness": ("F41", "audio", "LUFS"),
}
SIGNAL = [RUN, "signal_id", "feature_id", "start_ms", "end_ms", "modality", "name", "value", "unit", "validity"]


def looked_up(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


# -- structure --------------------------------------------------------------------------------------------------------------------


def located(refs: DataFrame, chunks: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """refs (run_id, key, chunk, quote) with start_ms, end_ms: the first segment of the chunk that says the quote, else the whole chunk."""
    said = refs.where(F.trim("quote") != "").select(RUN, key, "chunk", plain(F.col("quote")).alias("_q")).join(segments.select(RUN, "chunk", "seg_idx", "text", F.col("start_ms").alias("a"), F.col("end_ms").alias("z")), [RUN, "chunk"])
    said = said.where(F.contains(plain(F.col("text")), "_q")).groupBy(RUN, key).agg(F.min(F.struct("seg_idx", "a", "z")).alias("s"))
    d = refs.join(chunks.select(RUN, "chunk", "start_ms", "end_ms"), [RUN, "chunk"]).join(said, [RUN, key], "left")
    return d.withColumns({"start_ms": F.coalesce("s.a", "start_ms"), "end_ms": F.coalesce("s.z", "end_ms")}).drop("s")


def structure(answers: DataFrame, chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """run_id, hook_kind, hook_ms, hook_end_ms, first_substance_ms."""
    hooks = answers.where("answer.hook.kind != 'none'").select(RUN, F.lit(0).alias("k"), "answer.hook.chunk", F.coalesce("answer.hook.quote", F.lit("")).alias("quote"))
    hooks = located(hooks, chunks, segments, "k").select(RUN, F.col("start_ms").alias("hook_ms"), F.col("end_ms").alias("hook_end_ms"))
    first = chunks.select(RUN, F.col("chunk").alias("_first"), F.col("start_ms").alias("first_substance_ms"))
    d = answers.select(RUN, F.col("answer.hook.kind").alias("hook_kind"), F.col("answer.first_substance_chunk").alias("_first"))
    return d.join(hooks, RUN, "left").join(first, [RUN, "_first"], "left").drop("_first")


def chapters(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """run_id, chapter, label, role, start_ms, end_ms from the first chunk to the last; without both a chapter is left out."""
    d = answers.select(RUN, F.posexplode("answer.chapters").alias("chapter", "c")).select(RUN, "chapter", "c.label", "c.role", F.explode(F.array("c.first", "c.last")).alias("chunk"))
    d = d.join(chunks.select(RUN, "chunk", "start_ms", "end_ms"), [RUN, "chunk"])
    return d.groupBy(RUN, "chapter").agg(F.first("label").alias("label"), F.first("role").alias("role"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def spans(answers: DataFrame, chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """run_id, span, kind, quote, start_ms, end_ms."""
    d = answers.select(RUN, F.posexplode("answer.spans").alias("span", "s")).select(RUN, "span", "s.kind", "s.chunk", F.coalesce("s.quote", F.lit("")).alias("quote"))
    return located(d, chunks, segments, "span").select(RUN, "span", "kind", "quote", "start_ms", "end_ms")


def promises(answers: DataFrame, chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """run_id, promise, obligation, title_quote, status, setup_ms, first_fulfil_ms, delivery (start and end of partial and of whole fulfilment),
    evidence (segments).

    The first delivery is the earliest chunk that keeps the promise partly or wholly. A kept promise without any segment is uncertain.
    """
    made = answers.select(RUN, F.posexplode("answer.obligations").alias("promise", "o")).select(RUN, "promise", "o.obligation", "o.title_quote")
    led = answers.select(RUN, F.explode("answer.ledger").alias("l")).select(RUN, F.col("l.obligation").alias("promise"), "l.status", "l.setup", "l.partial", "l.fulfilled")
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("ids")) for r in ("setup", "partial", "fulfilled")])
    refs = led.select(RUN, "promise", "status", F.inline(roles)).select(RUN, "promise", "status", "role", F.posexplode("ids").alias("pos", "chunk")).join(chunks.select(RUN, "chunk", "start_ms", "end_ms"), [RUN, "chunk"])
    role = lambda r: F.col("role") == r
    first = lambda r, c: F.max(F.when(role(r) & (F.col("pos") == 0), F.col(c)))
    gives = F.col("role") != "setup"
    times = refs.groupBy(RUN, "promise").agg(
        first("setup", "start_ms").alias("setup_ms"), F.min(F.when(gives, F.struct("start_ms", "end_ms"))).alias("d"), first("fulfilled", "start_ms").alias("f0"), first("fulfilled", "end_ms").alias("f1"),
        F.min(F.when(role("partial"), F.col("start_ms"))).alias("p0"), F.max(F.when(role("partial"), F.col("end_ms"))).alias("p1"),
    )
    # Two segments of the first chunk that fulfils, and of the first that does so partly unless the promise is kept.
    heads = segments.withColumn("_n", F.row_number().over(Window.partitionBy(RUN, "chunk").orderBy("seg_idx"))).where("_n <= 2").select(RUN, "chunk", "seg_idx")
    proof = refs.where((F.col("pos") == 0) & (role("fulfilled") | (role("partial") & (F.col("status") != "fulfilled")))).join(heads, [RUN, "chunk"])
    proof = proof.groupBy(RUN, "promise").agg(F.array_sort(F.collect_set("seg_idx")).alias("evidence"))
    d = made.join(led.select(RUN, "promise", "status"), [RUN, "promise"], "left").join(times, [RUN, "promise"], "left").join(proof, [RUN, "promise"], "left")
    claimed = F.coalesce("status", F.lit("uncertain"))
    kept = claimed == "fulfilled"
    f0, f1 = F.coalesce("f0", "p0"), F.when(F.col("f0").isNotNull(), F.col("f1")).otherwise(F.col("p1"))
    shown = F.when(kept & F.col("evidence").isNull(), "uncertain").otherwise(claimed)
    begun = (shown == "fulfilled") & (F.col("d.start_ms") < f0)
    return d.select(
        RUN, "promise", "obligation", "title_quote", shown.alias("status"), "setup_ms", F.when(claimed.isin("fulfilled", "partial"), F.col("d.start_ms")).alias("first_fulfil_ms"),
        F.when(shown == "partial", F.col("p0")).when(begun, F.col("d.start_ms")).alias("partial_start_ms"), F.when(shown == "partial", F.col("p1")).when(begun, F.col("d.end_ms")).alias("partial_end_ms"),
        F.when(shown == "fulfilled", f0).alias("fulfilled_start_ms"), F.when(shown == "fulfilled", f1).alias("fulfilled_end_ms"), F.coalesce("evidence", F.array().cast("array<int>")).alias("evidence"),
    )


# -- issues -----------------------------------------------------------------------------------------------------------------------


def mechanism(operation: Column, start: Column, end: Column, destination: Column) -> Column:
    """What an edit does, in words; tenths of a second are rounded half up."""
    tenths = lambda ms: F.floor((ms + 50) / 100) / 10
    took, moved = tenths(end - start), start - destination
    where = F.concat(clock(start), F.lit("-"), clock(end))
    brings = F.concat(F.lit("Brings "), where, F.format_string(" %.1f s ", tenths(F.abs(moved))), F.when(moved > 0, "earlier.").otherwise("later."))
    return F.when(operation == "cut", F.concat(F.format_string("Removes %.1f s (", took), where, F.lit(")."))).when((operation == "move") & destination.isNotNull(), brings).otherwise("Effect on retention unknown until the edited video is reanalysed.")


def judged(candidates: DataFrame, decisions: DataFrame, book: DataFrame, source_kind: str = "video") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, suggestions, dismissed) of candidates with a decision.

    candidates: run_id, candidate, type, start_ms, end_ms, absence, options (array of id, operation, start_ms, end_ms, destination_ms), evidence (ids).
    decisions: run_id, candidate, verdict, severity, cited (places in evidence, from 1), option, proposed, explanation. book: run_id, evidence_id, kind, stage.
    """
    d = candidates.join(decisions, [RUN, "candidate"])
    dismissed = d.where("verdict = 'dismiss'").select(RUN, "candidate", "type", "start_ms", "end_ms", "explanation")
    d = d.where("verdict != 'dismiss'").withColumn("issue_id", hashed_id("is_", F.col(RUN).cast("string"), F.col("type"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string")))
    cites = d.select(RUN, "candidate", F.posexplode("cited").alias("n", "place"), "evidence").select(RUN, "candidate", "n", F.try_element_at("evidence", F.col("place")).alias("evidence_id")).where("evidence_id is not null")
    cites = cites.join(book.select(RUN, "evidence_id", "kind", "stage"), [RUN, "evidence_id"], "left")
    tag = F.when(F.col("kind") == "transcript", "speech").when(F.col("kind").isNotNull() & (F.col("stage") == "audio"), "audio").otherwise("visual")
    cites = cites.groupBy(RUN, "candidate").agg(
        F.array_sort(F.collect_set(tag)).alias("tags"), F.bool_or(F.coalesce(F.col("kind").isin("transcript", "signal"), F.lit(False))).alias("precise"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "evidence_id"))), lambda x: x.evidence_id).alias("evidence_ids"),
    )
    d = d.join(cites, [RUN, "candidate"], "left")
    weak = F.col("absence") | ~F.coalesce("precise", F.lit(False)) | F.lit(source_kind == "script")
    d = d.withColumns({"evidence_status": F.when(weak, "provisional").otherwise("supported"), "cause_group": F.concat(F.lit("cause-"), "issue_id")})
    option = F.get(F.filter("options", lambda o: o.id == F.col("option")), F.lit(0))
    d = d.withColumn("edit", option).withColumn("suggestion_id", F.when(F.col("edit").isNotNull(), hashed_id("su_", F.col("issue_id"), F.col("option"))))
    to = F.when(F.col("edit.operation") == "insert_visual", F.coalesce("edit.destination_ms", "edit.start_ms")).when(F.col("edit.operation") == "move", F.col("edit.destination_ms"))
    proposed = F.when(F.col("edit.operation").isin("rewrite", "insert_visual") & (F.trim("proposed") != ""), F.trim("proposed"))
    suggestions = d.where("edit is not null").select(
        RUN, "suggestion_id", "issue_id", "edit.operation", F.col("edit.start_ms").alias("start_ms"), F.col("edit.end_ms").alias("end_ms"), to.alias("destination_ms"), proposed.alias("proposed_text"),
        mechanism(F.col("edit.operation"), F.col("edit.start_ms"), F.col("edit.end_ms"), to).alias("rationale"), (F.col("edit.operation") != "cut").alias("requires_reanalysis"),
    )
    issues = d.select(RUN, "issue_id", "type", "start_ms", "end_ms", F.coalesce("tags", F.array(F.lit("speech"))).alias("tags"), "severity", "evidence_status", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), "suggestion_id", "cause_group")
    causes = inherited_causes(issues.select(RUN, "issue_id", "type", "start_ms", "end_ms", "cause_group")).select(RUN, "issue_id", "cause_group")
    return issues.drop("cause_group").join(causes, [RUN, "issue_id"]), suggestions, dismissed


# -- signals ----------------------------------------------------------------------------------------------------------------------


def signals(rows: DataFrame, feature: Column, name: Column, value: Column, modality: str = "speech", unit: str = "label", validity: str = "estimated") -> DataFrame:
    """SIGNAL columns of rows (run_id, start_ms, end_ms). Values of any type are JSON, so that one table holds them all."""
    d = rows.select(RUN, "start_ms", "end_ms", feature.alias("feature_id"), name.alias("name"), value.alias("value"))
    key = hashed_id("sg_", F.col(RUN).cast("string"), F.col("feature_id"), F.col("name"), F.col("start_ms").cast("string"), F.col("end_ms").cast("string"), F.coalesce(F.substring("value", 1, 40), F.lit("")))
    return d.withColumns({"signal_id": key, "modality": F.lit(modality), "unit": F.lit(unit), "validity": F.lit(validity)}).select(*SIGNAL)


def structure_signals(answered: DataFrame, parts: DataFrame, marked: DataFrame, rates: DataFrame) -> DataFrame:
    """Signals of structure, chapters, spans and speech rates (run_id, start_ms, end_ms, wpm, precision)."""
    js = lambda *c: F.to_json(F.struct(*c))
    hook = answered.where("hook_ms is not null").select(RUN, "hook_kind", F.col("hook_ms").alias("start_ms"), (F.col("hook_ms") + 1000).alias("end_ms"))
    lead = answered.where("first_substance_ms is not null").select(RUN, F.lit(0).cast("bigint").alias("start_ms"), F.greatest(F.lit(1), "first_substance_ms").alias("end_ms"), "first_substance_ms")
    exact = F.col("precision") == "word"
    out = signals(parts, F.lit("F61"), F.lit("chapter"), js("label", "role"))
    out = out.unionByName(signals(marked, looked_up(SPAN_FEATURES, F.col("kind")), F.col("kind"), js(F.substring("quote", 1, 300).alias("quote"))))
    out = out.unionByName(signals(hook, F.lit("F48"), F.lit("hook"), js(F.col("hook_kind").alias("kind"))))
    out = out.unionByName(signals(lead, F.lit("F59"), F.lit("time_to_substance"), F.col("first_substance_ms").cast("string"), unit="ms"))
    fast = signals(rates.where(exact), F.lit("F40"), F.lit("speech_rate"), F.col("wpm").cast("string"), unit="words/min", validity="measured")
    return out.unionByName(fast).unionByName(signals(rates.where(~exact), F.lit("F40"), F.lit("speech_rate"), F.col("wpm").cast("string"), unit="words/min"))


def key_signals(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signals, evidence): evidence (run_id, evidence_id, ref_key, start_ms, end_ms, text) that cites a measurement by a key like `wpm:12` gets a
    signal; its value is the interval in ms, the words a minute that its text begins with, or the share in per cent that it ends with."""
    key = F.split("ref_key", ":")[0]
    known = looked_up({k: "|".join(v) for k, v in KEY_FEATURES.items()}, key)
    d = evidence.withColumn("_f", F.split(known, r"\|")).where("_f is not null").withColumn("_key", key)
    digits = F.regexp_replace(F.regexp_extract("text", r"^\s*(\S+)", 1), "[^0-9]", "")
    percent = F.regexp_extract("text", r"(\S+)%$", 1).try_cast("double")
    value = F.when(F.col("_f")[3] == "ms", (F.col("end_ms") - F.col("start_ms")).cast("string")).when(F.col("_key") == "wpm", F.when(digits == "", "0").otherwise(digits.cast("bigint").cast("string"))).when(F.col("_key") == "clip", F.round(percent / 100, 6).cast("string"))
    d = d.withColumns({"value": value, "signal_id": hashed_id("sg_", F.col(RUN).cast("string"), F.col("ref_key"))})
    made = d.select(RUN, "signal_id", F.col("_f")[0].alias("feature_id"), "start_ms", "end_ms", F.col("_f")[1].alias("modality"), F.col("_f")[2].alias("name"), "value", F.col("_f")[3].alias("unit"), F.when(F.col("value").isNull(), "unknown").otherwise("measured").alias("validity"))
    return made.dropDuplicates([RUN, "signal_id"]), d.select(RUN, "evidence_id", F.col("signal_id").alias("ref_id"))


def selected(signals: DataFrame, features: list[str], names: list[str]) -> DataFrame:
    """Signals of the features, or with the names."""
    return signals.where(F.col("feature_id").isin(features) | F.col("name").isin(names))


def speech_signals(fillers: DataFrame, switches: DataFrame) -> DataFrame:
    """Signals of filler rates (run_id, start_ms, end_ms, count; those with any) and of language switches (run_id, at_ms, previous, language)."""
    per_min = F.round(F.col("count") * 60_000 / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")), 1)
    out = signals(fillers.where("count > 0"), F.lit("F52"), F.lit("filler_rate"), F.to_json(F.struct("count", per_min.alias("per_min"))), unit="fillers/min", validity="measured")
    at = switches.withColumns({"start_ms": F.col("at_ms"), "end_ms": F.col("at_ms") + 1})
    return out.unionByName(signals(at, F.lit("F47"), F.lit("language_switch"), F.to_json(F.struct(F.col("previous").alias("from"), F.col("language").alias("to")))))


def measured_signals(runs: DataFrame, cuts: DataFrame, spans: dict[str, DataFrame], series: dict[str, DataFrame], width: int = 10_000) -> DataFrame:
    """Signals of measurements: cuts (run_id, at_ms) in windows of `width`, zeros too; spans (black, freeze, silence: run_id, start_ms, end_ms) with their
    length; and series (name: run_id, t_ms, v) of a whole run as one value of two arrays. runs: run_id, end_ms."""
    grid = runs.where("end_ms > 0").select(RUN, "end_ms", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end_ms") - 1, F.lit(width).cast("bigint"))).alias("start_ms"))
    n = cuts.groupBy(RUN, (F.floor(F.col("at_ms") / width) * width).alias("start_ms")).agg(F.count("*").alias("n"))
    windows = grid.select(RUN, "start_ms", F.least("end_ms", F.col("start_ms") + width).alias("end_ms")).join(n, [RUN, "start_ms"], "left")
    out = signals(windows, F.lit("F01"), F.lit("cuts_per_10s"), F.coalesce("n", F.lit(0)).cast("string"), "visual", "count", "measured")
    for name, rows in spans.items():
        feature, modality, shown = SPAN_MEASURES[name]
        out = out.unionByName(signals(rows, F.lit(feature), F.lit(shown), (F.col("end_ms") - F.col("start_ms")).cast("string"), modality, "ms", "measured"))
    for name, rows in series.items():
        feature, modality, unit = SERIES_MEASURES[name]
        packed = rows.groupBy(RUN).agg(F.array_sort(F.collect_list(F.struct("t_ms", "v"))).alias("s")).join(runs, RUN).withColumn("start_ms", F.lit(0).cast("bigint"))
        value = F.to_json(F.struct(F.col("s.t_ms").alias("t_ms"), F.col("s.v").alias("v")))
        out = out.unionByName(signals(packed, F.lit(feature), F.lit(name), value, modality, unit, "measured"))
    return out
