"""Quality rules with robust multivariate outliers, with DataFrame operations only.

Statistics of every whole text give fixed rules and a vector. Per language and source a minimum-covariance-determinant estimate gives
mean and covariance of the inner COVERAGE share of the vectors: concentration steps from each of three deterministic starts
(medians and deviations; correlations of squashed values; correlations of directions), of which the least determinant is taken.
Documents whose squared Mahalanobis distance has a chi-square tail probability under TAIL are rejected. Groups under
SMALL rows use the estimate of their language, which is made from all its rows of all sources; a language under SMALL rows uses that
of the whole corpus.

Defined results: null and empty texts have zero counts and fail the rules; null languages and sources form groups of their
own; a group that is constant in a statistic has the floor RIDGE as its deviation there; repeated rows are judged alike; of starts with
equal determinants the first is taken; very long texts are counted whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, WS, materialise

MIN_WORDS, MAX_REPEAT = 50, 50
COVERAGE, STEPS, STARTS, SMALL = 0.75, 4, 3, 100
#: Least standard deviation of each statistic.
RIDGE = (0.03, 0.1, 0.1, 0.3)
#: Tail probability (chi-square, four degrees) under which a text is an outlier. Symbols and repeated lines come in bursts, far from normal.
TAIL = 3e-12
MEDIAN_CHI2_4 = 3.3567
#: Most rows of estimates that are sent to all tasks, and the parts into which a group's rows are dealt beyond that.
BROADCAST_ROWS, PARTS = 50_000, 16
SYMBOLS = "#*$%&|<>"
VECTOR = ("v0", "v1", "v2", "v3")


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text.

    Repeated three-word windows: hashes of windows are sorted with their positions, so equal ones are neighbours.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select("doc_id", "lang", "source", t.alias("text"))
    d = d.withColumn("hashes", F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "lang", "source", "hashes", F.size("hashes").alias("n_words"),
                 F.length(F.translate("text", WS, "")).cast("long").alias("word_chars"),
                 (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), lines.alias("lines"))
    n = F.greatest(F.col("n_words") - 2, F.lit(0))
    three = F.zip_with(F.zip_with(F.slice("hashes", 1, n), F.slice("hashes", 2, n), lambda a, b: F.xxhash64(a, b)), F.slice("hashes", 3, n), lambda a, b: F.xxhash64(a, b))
    three = F.when(F.col("n_words") > 3, three).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("windows", three).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines", "hashes")
    d = d.withColumn("repeats", F.size("windows") > F.size(F.array_distinct("windows")))
    placed = F.when(F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("placed", placed).drop("windows")
    m = F.greatest(F.size("placed") - 1, F.lit(0))
    pairs = F.filter(F.zip_with(F.slice("placed", 1, m), F.slice("placed", 2, m), lambda a, b: F.when(a.h == b.h, F.array(a.i, a.i + 1, a.i + 2, b.i, b.i + 1, b.i + 2))), lambda x: x.isNotNull())
    d = d.withColumn("n_repeat_words", F.when(F.col("repeats"), F.size(F.array_distinct(F.flatten(pairs)))).otherwise(0).cast("long"))
    return d.select("doc_id", "lang", "source", F.col("n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed(min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def vector() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "v0": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "v1": F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "v2": F.sqrt(F.col("n_repeat_words") / words) * 2,
        "v3": F.log1p(F.col("n_dup_lines").cast("double")),
    }


def cutoff_of(tail: float = TAIL) -> float:
    """The squared distance with this chi-square tail probability, four degrees: exp(-x/2) * (1 + x/2), solved by bisection."""
    low, high = 0.0, 4000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2) > tail else (low, x)
    return high


PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
KEYS = ["group", "start"]


def cholesky(g: DataFrame) -> DataFrame:
    """Columns l<i><j> and log_det from the covariance columns c<i><j>."""
    for j in range(4):
        inner = sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        g = g.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(RIDGE[j] ** 2 / 100))))
        for i in range(j + 1, 4):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            g = g.withColumn(f"l{i}{j}", (F.col(f"c{j}{i}") - inner) / F.col(f"l{j}{j}"))
    log_det = sum((2 * F.log(f"l{i}{i}") for i in range(4)), F.lit(0.0))
    return g.select(*KEYS, *[f"m{i}" for i in range(4)], *[f"l{i}{j}" for i in range(4) for j in range(i + 1)], log_det.alias("log_det"))


def join_estimates(rows: DataFrame, g: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their group's values. Few groups go to all tasks; beyond that each group is dealt into parts, so a hot one is spread."""
    if g.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(g), keys)
    parts = g.withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(PARTS)])))
    return rows.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(PARTS)).cast("int")).join(parts, [*keys, "part"]).drop("part")


def distance(rows: DataFrame, g: DataFrame) -> DataFrame:
    """rows with d: the squared Mahalanobis distance by its group's estimate (forward substitution)."""
    j = join_estimates(rows, g, [k for k in KEYS if k in rows.columns])
    for i in range(4):
        done = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        j = j.withColumn(f"y{i}", (F.col(f"v{i}") - F.col(f"m{i}") - done) / F.col(f"l{i}{i}"))
    return j.select("row_id", *[k for k in KEYS if k in rows.columns], *VECTOR, sum((F.col(f"y{i}") ** 2 for i in range(4)), F.lit(0.0)).alias("d"))


def starts(rows: DataFrame) -> DataFrame:
    """group, start, m0..m3, c00..c33: medians, deviations by medians, and the correlations of three robust transforms.

    Start 0: none. Start 1: of the hyperbolic tangents of the standardised values. Start 2: of their directions (spatial signs).
    """
    median = lambda c: F.percentile_approx(c, 0.5, 10000)
    centre = materialise(rows.groupBy("group").agg(*[median(v).alias(f"m{i}") for i, v in enumerate(VECTOR)]), "quality-centre")
    at = join_estimates(rows, centre, ["group"])
    spread = at.groupBy("group").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(4)], *[F.sqrt(F.pow(1.4826 * median(F.abs(F.col(v) - F.col(f"m{i}"))), 2) + RIDGE[i] ** 2).alias(f"s{i}") for i, v in enumerate(VECTOR)])
    spread = materialise(spread, "quality-spread")
    z = join_estimates(rows, spread, ["group"]).withColumns({f"z{i}": (F.col(f"v{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(4)})
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(4)), F.lit(0.0))), F.lit(1e-9))
    z = z.withColumns({**{f"t{i}": F.tanh(f"z{i}") for i in range(4)}, **{f"u{i}": F.col(f"z{i}") / norm for i in range(4)}})
    r = z.groupBy("group").agg(*[F.try_divide(F.covar_pop(f"{x}{i}", f"{x}{j}"), F.stddev_pop(f"{x}{i}") * F.stddev_pop(f"{x}{j}")).alias(f"{x}{i}{j}") for x in "tu" for i, j in PAIRS if i < j])
    g = spread.join(r, "group").withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    # A constant statistic has no correlation.
    corr = lambda i, j: F.when(F.col("start") == 1, F.col(f"t{i}{j}")).when(F.col("start") == 2, F.col(f"u{i}{j}")).otherwise(0.0)
    known = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return g.select(*KEYS, *[f"m{i}" for i in range(4)], *[(F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else known(corr(i, j)))).alias(f"c{i}{j}") for i, j in PAIRS])


def robust_distances(rows: DataFrame, steps: int = STEPS, coverage: float = COVERAGE) -> DataFrame:
    """row_id, group, d for rows (row_id, group, v0..v3): squared distances, scaled so that a group's median is that of a chi-square."""
    median = lambda c: F.percentile_approx(c, 0.5, 10000)
    g = materialise(cholesky(starts(rows)), "quality-start")
    every = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    for _ in range(steps):
        x = distance(every, g)
        inner = materialise(x.groupBy(*KEYS).agg(F.percentile_approx("d", coverage, 10000).alias("limit")), "quality-limit")
        x = join_estimates(x, inner, KEYS).where("d <= limit")
        cov = [(F.coalesce(F.covar_pop(VECTOR[i], VECTOR[j]), F.lit(0.0)) + (RIDGE[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
        g = materialise(cholesky(x.groupBy(*KEYS).agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR)], *cov)), "quality-step")
    best = g.groupBy("group").agg(F.min_by(F.struct("*"), F.struct("log_det", "start")).alias("g")).select("g.*").drop("start")
    x = distance(rows, materialise(best, "quality-estimates"))
    scale = materialise(x.groupBy("group").agg(F.greatest(median("d") / MEDIAN_CHI2_4, F.lit(1.0)).alias("scale")), "quality-scale")
    return join_estimates(x, scale, ["group"]).select("row_id", "group", (F.col("d") / F.col("scale")).alias("d"))


def judge(docs: DataFrame, text_col: str = "text", tail: float = TAIL) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where the rules fail) and kept for every document."""
    stats = text_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumns(vector())
    stats = materialise(stats.withColumn("row_id", F.monotonically_increasing_id()), "quality-statistics")
    passed = stats.where(~F.col("base_failed"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    own, lang, every = F.concat_ws("\x00", "kl", "ks"), F.col("kl"), F.lit("")
    sizes = passed.groupBy(key("lang").alias("kl"), key("source").alias("ks")).agg(F.count("*").alias("n"))
    langs = sizes.groupBy("kl").agg(F.sum("n").alias("n_lang"), (F.min("n") < SMALL).alias("lends")).withColumn("lends", F.col("lends") & (F.col("n_lang") >= SMALL))
    borrows = F.coalesce(F.max(F.col("n_lang") < SMALL).over(Window.partitionBy()), F.lit(False))  # a row per language
    sizes = sizes.join(langs.withColumn("all", borrows), "kl")
    judged = F.when(F.col("n") >= SMALL, own).when(F.col("n_lang") >= SMALL, lang).otherwise(every)
    groups = F.array_compact(F.array(F.when(F.col("n") >= SMALL, own), F.when(F.col("lends"), lang), F.when(F.col("all"), every)))
    sizes = materialise(sizes.select("kl", "ks", judged.alias("judged"), groups.alias("groups")), "quality-groups")
    rows = join_estimates(passed.select("row_id", key("lang").alias("kl"), key("source").alias("ks"), *VECTOR), sizes, ["kl", "ks"])
    # A row for each estimate that the document is part of; it is judged by one of them.
    rows = materialise(rows.select("row_id", "judged", F.explode("groups").alias("group"), *VECTOR), "quality-rows")
    d = robust_distances(rows).join(rows.where("group = judged").select("row_id", "group"), ["row_id", "group"]).drop("group")
    out = stats.join(d, "row_id", "left")
    kept = ~F.col("base_failed") & (F.coalesce("d", F.lit(0.0)) <= cutoff_of(tail))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.round("d", 6).alias("distance"))
