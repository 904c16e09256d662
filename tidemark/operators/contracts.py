"""Checks between the tables of run packages and of recorded answers; violations are rows of (run_id, table, rule, row_key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import content_words, word_count
from tidemark.operators.intervals import RUN

# File types by limit (bytes), and the first bytes of those that have some.
TEXT_BYTES, IMAGE_BYTES, OTHER_BYTES, PATH_LENGTH = 100 << 20, 25 << 20, 2 << 30, 240
SUFFIXES = (".json", ".jsonl", ".jpg", ".mp4", ".txt", ".md", ".wav", ".zip", ".csv", ".srt", ".vtt")
MAGIC = {".jpg": (1, "FFD8FF"), ".mp4": (5, "66747970"), ".wav": (1, "52494646"), ".zip": (1, "504B0304")}
#: Least share of a passage's content words that a rewrite keeps, least confidence of a choice, words that a shortening must share.
RETENTION, CONFIDENCE, SHARED_WORDS = 0.4, 0.65, 4


def plain(text: Column) -> Column:
    """Lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def violation(df: DataFrame, table: str, rule: str, key: str) -> DataFrame:
    return df.select(RUN, F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("row_key"))


def cross_run(df: DataFrame, table: str, key: str, declared: str = "file_run") -> DataFrame:
    """Rows that belong to another run than their file."""
    return violation(df.where(~F.col(RUN).eqNullSafe(F.col(declared))), table, "same run", key)


def dangling(df: DataFrame, table: str, key: str, ids: Column, target: DataFrame, target_id: str, rule: str) -> DataFrame:
    """Rows with an id (of an array) that their run's target table lacks; one violation per row."""
    asked = df.select(RUN, key, F.explode(ids).alias("_id"))
    return violation(asked.join(target.select(RUN, F.col(target_id).alias("_id")), [RUN, "_id"], "left_anti").dropDuplicates([RUN, key]), table, rule, key)


def dangling_kinds(df: DataFrame, table: str, key: str, targets: DataFrame) -> DataFrame:
    """Rows whose (kind, ref_id) no table of that kind has; targets: run_id, kind, ref_id of all kinds."""
    return violation(df.join(targets.select(RUN, "kind", "ref_id"), [RUN, "kind", "ref_id"], "left_anti"), table, "reference exists", key)


def outside(df: DataFrame, table: str, key: str, runs: DataFrame, end: str = "end_ms") -> DataFrame:
    """Rows that end beyond their run."""
    return violation(df.join(runs.select(RUN, "duration_ms"), RUN).where(F.col(end) > F.col("duration_ms")), table, f"{end} inside the run", key)


def not_finite(df: DataFrame, table: str, key: str, values: Column) -> DataFrame:
    """Rows with a NaN or an infinite number in an array."""
    return violation(df.where(F.exists(values, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))), table, "finite numbers", key)


def undeclared(expected: DataFrame, present: DataFrame, declared: DataFrame) -> DataFrame:
    """Tables (run_id, table) that a run lacks without declaring them missing, and those declared without a reason."""
    lost = expected.join(present, [RUN, "table"], "left_anti").join(declared, [RUN, "table"], "left")
    return lost.select(RUN, "table", F.when(F.col("reason").isNull(), "declared missing").when(F.trim("reason") == "", "reason given").alias("rule"), F.col("table").alias("row_key")).where("rule is not null")


def identity_chain(manifests: DataFrame, assets: DataFrame) -> DataFrame:
    """Runs whose manifest names another asset, hash or project than their asset row; no row counts as another."""
    x = manifests.join(assets.select(RUN, F.col("asset_id").alias("_a"), F.col("sha256").alias("_h"), F.col("project_id").alias("_p")), RUN, "left")
    same = F.col("asset_id").eqNullSafe(F.col("_a")) & F.col("source_sha256").eqNullSafe(F.col("_h")) & F.col("project_id").eqNullSafe(F.col("_p"))
    return violation(x.where(~same), "manifest", "identity", "asset_id")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def listing_problems(files: DataFrame) -> DataFrame:
    """Files (run_id, path, bytes) that break a limit: unsafe or long paths, repeats but for case, types, sizes."""
    s = suffix(F.col("path"))
    text = s.isin(".json", ".jsonl", ".txt", ".md", ".csv", ".srt", ".vtt")
    limit = F.when(text, TEXT_BYTES).when(s == ".jpg", IMAGE_BYTES).otherwise(OTHER_BYTES)
    parts = F.split("path", "/")
    unsafe = F.col("path").startswith("/") | F.contains("path", F.lit("\\")) | F.contains(F.get(parts, F.lit(0)), F.lit(":")) | F.exists(parts, lambda p: p.isin("", ".", ".."))
    again = F.row_number().over(Window.partitionBy(RUN, F.lower("path")).orderBy("path")) > 1
    rules = {"unsafe path": unsafe, "path length": F.length("path") > PATH_LENGTH, "repeated path": F.col("_again"), "file type": ~s.isin(*SUFFIXES), "reports folder": s.isin(".csv", ".srt", ".vtt") & ~F.col("path").startswith("reports/"), "file size": F.col("bytes") > limit}
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return files.withColumn("_again", again).select(RUN, F.lit("files").alias("table"), F.explode(broken).alias("rule"), F.col("path").alias("row_key"))


def content_problems(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (run_id, path, content) whose hash, size or first bytes differ from their manifest row (sha256, bytes) or type."""
    x = files.join(manifest, [RUN, "path"])
    wrong = F.lit(False)
    for s, (at, magic) in MAGIC.items():
        wrong = F.when(suffix(F.col("path")) == s, F.hex(F.substring("content", at, len(magic) // 2)) != magic).otherwise(wrong)
    rules = {"hash": F.sha2("content", 256) != F.col("sha256"), "size": F.length("content") != F.col("bytes"), "type": wrong}
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return x.select(RUN, F.lit("files").alias("table"), F.explode(broken).alias("rule"), F.col("path").alias("row_key"))


def quote_problems(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Recorded answers (run_id, answer, passage, quote) whose passage is unknown or does not hold the quote; passages: run_id, passage, text."""
    x = answers.join(passages.select(RUN, "passage", F.col("text").alias("_t")), [RUN, "passage"], "left")
    rule = F.when(F.col("_t").isNull(), "passage exists").when((F.trim("quote") == "") | ~F.contains(plain(F.col("_t")), plain(F.col("quote"))), "quote in passage")
    return x.withColumn("_r", rule).where("_r is not null").select(RUN, F.lit("answers").alias("table"), F.col("_r").alias("rule"), F.col("answer").cast("string").alias("row_key"))


def decision_problems(decisions: DataFrame) -> DataFrame:
    """Decisions (run_id, candidate, verdict, evidence, allowed, option_kind, original, proposed, explanation) that break a rule."""
    kept = F.size(F.array_intersect(content_words(F.col("original")), content_words(F.col("proposed")))) / F.size(content_words(F.col("original")))
    accepted, rewrite, written = F.col("verdict") == "accept", F.col("option_kind") == "rewrite", F.trim("proposed") != ""
    rules = {
        "evidence listed": F.size(F.array_except("evidence", "allowed")) > 0, "evidence cited": F.size("evidence") == 0, "option known": F.col("option_kind").isNull(), "text given": accepted & rewrite & ~written,
        "content kept": accepted & rewrite & written & (F.size(content_words(F.col("original"))) >= 8) & (kept < RETENTION), "explained": accepted & (F.trim("explanation") == ""),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return decisions.select(RUN, F.lit("decisions").alias("table"), F.explode(broken).alias("rule"), F.col("candidate").cast("string").alias("row_key"))


def salvaged(decisions: DataFrame, problems: DataFrame) -> DataFrame:
    """Decisions that pass, and those that only lose too much content, whose edit is dropped (edit_dropped)."""
    p = problems.groupBy(RUN, F.col("row_key").alias("_k")).agg(F.collect_set("rule").alias("_r"))
    x = decisions.withColumn("_k", F.col("candidate").cast("string")).join(p, [RUN, "_k"], "left")
    only = F.size(F.array_except("_r", F.array(F.lit("content kept")))) == 0
    return x.where(F.col("_r").isNull() | only).withColumn("edit_dropped", F.col("_r").isNotNull()).drop("_k", "_r")


def without_broken(rows: DataFrame, problems: DataFrame, key: str) -> DataFrame:
    """Rows (spans, say) without a violation of their own; the others are dropped, not their run."""
    return rows.withColumn("row_key", F.col(key).cast("string")).join(problems.select(RUN, "row_key").distinct(), [RUN, "row_key"], "left_anti").drop("row_key")


def routed(choices: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """choices (run_id, choice, confidence) with those of low confidence sent to review."""
    return choices.withColumn("choice", F.when(F.coalesce("confidence", F.lit(0.0)) < least, "needs_review").otherwise(F.col("choice")))


def shortening_problems(drafts: DataFrame, passages: DataFrame, words: int = SHARED_WORDS) -> DataFrame:
    """Drafts (run_id, passage, start_ms, quote, draft, original) without an earlier passage that holds a quote of `words` words, or not shorter.

    A passage that holds a quote has the words inside the quote's first and last one as they are. Passages and quotes of a run meet on hashes of up to
    four of these; texts join the pairs of different texts once, to be compared whole. words is 4 at least.
    """
    gram = lambda toks, at, n: F.xxhash64(F.array_join(F.slice(toks, at, n), " "))
    texts = passages.select(RUN, F.col("start_ms").alias("_s"), plain(F.col("text")).alias("_t")).where("_t is not null").groupBy(RUN, F.unhex(F.sha2("_t", 256)).alias("_text")).agg(F.min("_s").alias("_s"), F.first("_t").alias("_t"))
    grams = lambda n: F.when(F.size("_w") >= n, F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), lambda i: gram(F.col("_w"), i, F.lit(n)))).otherwise(F.array().cast("array<bigint>"))
    said = texts.withColumn("_w", F.split("_t", " ")).select(RUN, "_text", "_s", F.explode(F.array_distinct(F.concat(*[grams(n) for n in (2, 3, 4)]))).alias("_gram"))
    rules = {"shorter": word_count(F.col("draft")) >= word_count(F.col("original")), "few": word_count(F.col("quote")) < words}
    d = drafts.select(RUN, "passage", "start_ms", *[c.alias(n) for n, c in rules.items()], F.when(~rules["few"], plain(F.col("quote"))).alias("_q")).withColumn("_quote", F.unhex(F.sha2("_q", 256)))
    quotes = d.where("_q is not null").groupBy(RUN, "_quote").agg(F.first("_q").alias("_q"), F.max("start_ms").alias("_last")).withColumn("_w", F.split("_q", " "))
    asked = quotes.select(RUN, "_quote", "_last", gram(F.col("_w"), F.lit(2), F.least(F.lit(4), F.size("_w") - 2)).alias("_gram"))
    # Sizes are guessed from packed files and shuffles, so what is small there is not sent to all tasks.
    pairs = asked.join(said.hint("merge"), [RUN, "_gram"]).where("_s < _last").select(RUN, "_quote", "_text", "_s")
    held = pairs.join(quotes.select(RUN, "_quote", "_q").hint("merge"), [RUN, "_quote"]).join(texts.select(RUN, "_text", "_t").hint("merge"), [RUN, "_text"]).where(F.contains("_t", F.col("_q"))).groupBy(RUN, "_quote").agg(F.min("_s").alias("_s"))
    x = d.drop("_q").join(held.hint("merge"), [RUN, "_quote"], "left")
    supported = ~F.col("few") & F.coalesce(F.col("_s") < F.col("start_ms"), F.lit(False))
    broken = F.array_compact(F.array(F.when(~supported, F.lit("earlier support")), F.when(F.col("shorter"), F.lit("shorter"))))
    return x.select(RUN, F.lit("drafts").alias("table"), F.explode(broken).alias("rule"), F.col("passage").cast("string").alias("row_key"))


def frame_problems(answers: DataFrame) -> DataFrame:
    """Visual answers (run_id, answer, frames, labels, quote, transcript) with unknown or unordered frame labels, or a quote nobody said."""
    at = F.transform("frames", lambda f: F.array_position("labels", f))
    rules = {"labels known": F.size(F.array_except("frames", "labels")) > 0, "labels in order": at != F.array_sort(at), "quote said": (F.col("quote") != "") & ~F.contains(plain(F.col("transcript")), plain(F.col("quote")))}
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return answers.select(RUN, F.lit("visual").alias("table"), F.explode(broken).alias("rule"), F.col("answer").cast("string").alias("row_key"))
