"""Rules of sentences, signals, findings, links and what-if scores on small inputs with known answers."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.operators import candidates, contracts, findings, links, merges, retrieval, rules, selects, sentences, sequences, signals, whatif


def segs(spark, rows):
    """rows: (start_s, end_s, text)."""
    data = [("r", i, int(a * 1000), int(b * 1000), t) for i, (a, b, t) in enumerate(rows)]
    return spark.createDataFrame(data, "run_id string, seg_idx int, start_ms bigint, end_ms bigint, text string")


def run_of(spark, seconds):
    return spark.createDataFrame([("r", int(seconds * 1000))], "run_id string, duration_ms bigint")


def spans(spark, rows, extra=""):
    return spark.createDataFrame([("r", *r) for r in rows], "run_id string, start_ms bigint, end_ms bigint" + extra)


def values(df):
    return {(r.t, r.feature): round(r.value, 6) for r in df.collect()}


def test_sentences_are_split_timed_and_glued(spark):
    s = segs(spark, [(0, 4, "One two. Three four."), (4, 6, "Seventy percent, that's what"), (6, 8, "you need. Then more"), (8, 12, "lower case only")])
    out = [(r.start_ms, r.end_ms, r.text, r.punctuated) for r in sentences.sentences(s).orderBy("sent").collect()]
    assert out == [(0, 2000, "One two.", True), (2000, 4000, "Three four.", True), (4000, 7000, "Seventy percent, that's what you need.", True), (7000, 8000, "Then more", True), (8000, 12000, "lower case only", False)]


def test_unpunctuated_segments_stay_apart(spark):
    s = sentences.sentences(segs(spark, [(5 * i, 5 * i + 5, "the framework of an idea is a process concept") for i in range(20)]))
    assert s.count() == 20 and sentences.abstract_stretches(sentences.concreteness(s)).count() == 0
    told = sentences.sentences(segs(spark, [(5 * i, 5 * i + 5, "The framework of an idea is a process.") for i in range(20)]))
    assert [(r.start_ms, r.end_ms, r.sentences) for r in sentences.abstract_stretches(sentences.concreteness(told)).collect()] == [(0, 100_000, 20)]


def test_questions_and_their_answers(spark):
    s = segs(spark, [
        (60, 65, "How does the sampling algorithm choose keyframes?"), (66, 70, "Colours were brighter then."), (70, 75, "How does the sampling algorithm choose keyframes?"), (75, 80, "Nobody measured bananas."),
        (130, 135, "The algorithm picks keyframes by motion."), (200, 204, "Is the camera expensive today?"), (205, 207, "Yes, quite."), (300, 304, "Why would penguins dance tango?"), (330, 340, "Unrelated closing words here."),
    ])
    q = {r.start_ms: r for r in sentences.questions(sentences.sentences(s)).collect()}
    assert set(q) == {60_000, 200_000, 300_000}
    assert (q[60_000].gap_ms, q[60_000].kind, q[60_000].detection, q[60_000].shared) == (65_000, "open_loop", "lexical_overlap", ["algorithm", "keyframes"])
    assert (q[200_000].gap_ms, q[200_000].kind, q[200_000].detection) == (1_000, "immediate", "adjacent_answer_cue") and q[300_000].kind == "no_callback"
    found = {(r.rule, r.start_ms): r.severity for r in rules.relation_findings(run_of(spark, 340), s, spark.createDataFrame([], "run_id string, promise int, status string, first_fulfil_ms bigint")).collect()}
    assert found == {("delayed_question_callback", 60_000): "low", ("question_without_callback", 300_000): "medium"}


def test_terms_used_before_their_explanation(spark):
    s = segs(spark, [(5, 8, "Beware of input bias in surveys."), (30, 33, "Input biased people differ."), (60, 64, "This effect is called input bias, and it matters."), (70, 72, "It is called the the thing, really.")])
    got = [(r.term, r.used_ms, r.gap_ms) for r in sentences.term_dependencies(sentences.sentences(s)).collect()]
    assert got == [("input bias", 5_000, 55_000)]


def test_repeats_need_a_run_without_announcement(spark):
    lines = ["Quantum engines rotate slowly beside purple mountains today.", "Seven tired wizards paint enormous ceilings every winter.", "A wholly different remark about coffee beans follows."]
    again = segs(spark, [(10 * i, 10 * i + 8, t) for i, t in enumerate([*lines, *lines[:2]])])
    assert [(r.first, r.last, r.start_ms) for r in findings.repetition_runs(again).collect()] == [(3, 4, 30_000)]
    told = segs(spark, [(10 * i, 10 * i + 8, t) for i, t in enumerate([*lines[:2], "Let's watch that clip.", *lines[:2]])])
    assert findings.repetition_runs(told).count() == 0
    recap = segs(spark, [(10 * i, 10 * i + 8, t) for i, t in enumerate([*lines, "To recap: " + lines[0].lower(), "To recap: " + lines[1].lower()])])
    assert findings.repetition_runs(recap).count() == 0


def test_structure_features(spark):
    r, st = run_of(spark, 100), lambda *v: spark.createDataFrame([("r", *v)], "run_id string, hook_ms bigint, hook_end_ms bigint, first_substance_ms bigint")
    assert values(signals.setup(r, st(2_000, 6_000, 20_000))) == {} and min(values(signals.setup(r, st(2_000, 4_500, 20_000))).values()) == 0.5
    assert set(values(signals.no_hook(r, st(None, None, None)))) == {(t, "no_hook_yet") for t in range(30)}
    p = spark.createDataFrame([("r", 0, "fulfilled", 50_000), ("r", 1, "partial", 44_000)], "run_id string, promise int, status string, first_fulfil_ms bigint")
    v = values(signals.payoff_pending(r, p))
    assert min(v)[0] == 15 and max(v)[0] == 49 and v[45, "payoff_pending"] == 0.5
    s = spans(spark, [(10_000, 12_000, "cta"), (90_000, 92_000, "sponsor"), (20_000, 21_000, "recap")], ", kind string")
    assert {f for _, f in values(signals.interruptions(r, s))} == {"cta_or_sponsor", "outro"} and (91, "outro") in values(signals.interruptions(r, s))


def test_pauses_must_be_quiet(spark):
    r, speech = run_of(spark, 60), spans(spark, [(0, 10_000), (20_000, 30_000), (40_000, 60_000)])
    loud = [(t, -20.0 if t < 30_000 else -70.0) for t in range(0, 60_000, 500)]
    rms = spark.createDataFrame([("r", t, v) for t, v in loud], "run_id string, t_ms bigint, dbfs double")
    none = spans(spark, [])
    assert [(p.start_ms, p.end_ms) for p in signals.pauses(r, speech, none, rms).collect()] == [(30_000, 40_000)]
    assert {(p.start_ms, p.end_ms) for p in signals.pauses(r, speech, none, rms.limit(0)).collect()} == {(10_000, 20_000), (30_000, 40_000)}
    both = signals.pauses(r, speech, spans(spark, [(38_000, 42_000)]), rms).collect()
    assert [(p.start_ms, p.end_ms, p.source) for p in both] == [(30_000, 42_000, "no speech, quiet + silence")]


def test_sound_features(spark):
    r, speech = run_of(spark, 120), spans(spark, [(0, 120_000)])
    lufs = lambda t: -30.0 if 50 <= t < 55 else -10.0 if 80 <= t < 84 else -16.0
    level = signals.levels(r, spark.createDataFrame([("r", t * 1000, lufs(t)) for t in range(120)], "run_id string, t_ms bigint, lufs double"), speech)
    none = spark.createDataFrame([], "run_id string, t int")
    assert sorted(t for t, _ in values(signals.loudness_drop(level, none))) == [50, 51, 52, 53, 54]
    assert sorted(t for t, _ in values(signals.energy_lift(level))) == [80, 81, 82, 83] and level.first().usual == -16.0
    assert values(signals.loudness_drop(level, spark.createDataFrame([("r", 52)], "run_id string, t int"))) == {}


def test_pace_and_text_on_screen(spark):
    words = [("r", 400 * i, 400 * i + 350) for i in range(150)] + [("r", 60_000 + 200 * i, 60_000 + 200 * i + 150) for i in range(100)]
    local = signals.local_pace(run_of(spark, 80), spark.createDataFrame(words, "run_id string, start_ms bigint, end_ms bigint"))
    fast = {t for t, f in values(signals.pace(local)) if f == "fast_pace"}
    assert {65, 70, 75} <= fast and 30 not in fast
    tracks = spark.createDataFrame([("r", 0, 90_000, "w " * 17, 0.9), ("r", 20_000, 21_000, "Title card", 0.9), ("r", 22_000, 23_000, "TITLE card", 0.9), ("r", 30_000, 31_000, "unsure", 0.2)], "run_id string, start_ms bigint, end_ms bigint, text string, confidence double")
    v = values(signals.new_onscreen_text(run_of(spark, 80), tracks))
    assert v == {(20, "new_onscreen_text"): 1.0, (21, "new_onscreen_text"): round(2 / 3, 6), (22, "new_onscreen_text"): round(1 / 3, 6)}
    assert values(signals.dense_text(tracks, local))[70, "dense_text_fast_speech"] == round(17 / 24, 6)


def test_text_risk_counts_the_strongest_of_a_group(spark):
    f = spark.createDataFrame([("r", "a", "delivery", "high", "supported", 0, 5000), ("r", "b", "delivery", "medium", "supported", 0, 5000), ("r", "c", "progress", "high", "provisional", 0, 2500)], "run_id string, finding_id string, cause_group string, severity string, evidence_strength string, start_ms bigint, end_ms bigint")
    b = rules.text_risk(f, run_of(spark, 10.25)).orderBy("bin").collect()
    assert [(x.start_ms, x.end_ms) for x in b] == [(0, 5000), (5000, 10_000), (10_000, 10_250)]
    assert b[0].risk == round(100 * (0.13 + 0.18 * 0.25), 3) and b[0].top_finding == "a" and b[0].findings == ["a", "b", "c"] and b[1].risk == 0


def test_duplicates_point_to_what_they_repeat(spark):
    f = spark.createDataFrame([("r", "s", "progress", "high", "supported", True, 0, 10_000), ("r", "d", "progress", "low", "provisional", False, 2_000, 9_000), ("r", "o", "delivery", "low", "provisional", False, 2_000, 9_000)], "run_id string, finding_id string, cause_group string, severity string, evidence_strength string, safe_edit boolean, start_ms bigint, end_ms bigint")
    assert [(r.finding_id, r.duplicate_of) for r in merges.rank_findings(f).orderBy("priority_rank").collect()] == [("s", None), ("o", None), ("d", "s")]


def test_structure_findings(spark):
    T, s = run_of(spark, 200), segs(spark, [(0, 100, "Plain words about nothing."), (100, 200, "And that brings us back to the point.")])
    st = spark.createDataFrame([("r", 1000, 2000, 30_000)], "run_id string, hook_ms bigint, hook_end_ms bigint, first_substance_ms bigint")
    p = spark.createDataFrame([("r", 0, "fulfilled", 95_000)], "run_id string, promise int, status string, first_fulfil_ms bigint")
    sp = spans(spark, [(10_000, 12_000, "cta"), (120_000, 130_000, "sponsor"), (150_000, 152_000, "outro"), (20_000, 30_000, "tangent_candidate"), (90_000, 95_000, "tangent_candidate")], ", kind string")
    got = {(r.rule, r.start_ms, r.severity) for r in rules.structure_findings(T, s, st, p, sp).collect()}
    assert got == {("delayed_title_payoff", 15_000, "high"), ("cta_before_payoff", 10_000, "medium"), ("mid_video_interruption", 120_000, "medium"), ("extended_outro", 150_000, "medium"), ("topic_drift", 20_000, "medium")}


def test_cut_plan_scores_both_sides(spark):
    r = run_of(spark, 120)
    i = spark.createDataFrame([("r", 1, "narrative", "high", "supported", "c", 12_000, 18_000), ("r", 2, "pacing", "low", "supported", "d", 60_000, 70_000)], "run_id string, issue_id bigint, track string, severity string, evidence_status string, cause_group string, start_ms bigint, end_ms bigint")
    cover = spark.createDataFrame([("r", t, 0, 120_000) for t in ("narrative", "visual", "pacing", "text", "technical")], "run_id string, track string, start_ms bigint, end_ms bigint")
    out = {x.side: x for x in whatif.compare_cuts(r, i, cover, spans(spark, [(10_000, 20_000)])).collect()}
    assert out["before"].seconds == 120 and out["after"].seconds == 110 and out["before"].complete and out["after"].complete
    assert out["after"].least_viewed_pct > out["before"].least_viewed_pct
    assert whatif.compare_cuts(r, i, cover, spans(spark, [(0, 70_000)])).where("side = 'after'").count() == 0


def test_quotes_are_found_like_by_brute_force(spark):
    text = "the quick brown fox jumps over the lazy dog and then it sleeps under an old oak tree"
    for quote, want in (("Quick, brown fox jumped over the lazy dog", "quick brown fox jumps over the lazy dog"), ("an utterly different remark", None), ("sleeps under an old oak", "sleeps under an old oak")):
        found, ratio = links.best_window(quote, text)
        words, q = text.split(), "".join(c if c.isalnum() else " " for c in quote.lower()).split()
        windows = [words[i : i + n] for n in range(max(1, len(q) - 2), len(q) + 3) for i in range(len(words) - n + 1)]
        best = max(__import__("difflib").SequenceMatcher(None, w, q, autojunk=False).ratio() for w in windows)
        assert (found is not None) == (best >= 0.85) and (want is None or (ratio == pytest.approx(best) and set(want.split()) & set(found.split())))
    p = spark.createDataFrame([("r", 0, "nothing here"), ("r", 1, text), ("r", 9, "an old oak tree stands")], "run_id string, passage bigint, text string")
    q = spark.createDataFrame([("r", 1, 0, "quick brown fox jumps"), ("r", 2, 77, "lazy dog and then it"), ("r", 3, 9, "quick brown fox jumps"), ("r", 4, 1, "an old oak tree")], "run_id string, quote_id int, passage bigint, quote string")
    assert {r.quote_id: r.at_passage for r in links.located_quotes(q, p).collect()} == {1: 1, 2: 1, 3: None, 4: 1}


def test_spans_snap_to_sentences(spark):
    words = [(300, 400, "Then"), (420, 600, "it"), (650, 800, "was"), (820, 1090, "done."), (1200, 1400, "Next")]
    w = spark.createDataFrame([("r", a, b, t) for a, b, t in words], "run_id string, start_ms bigint, end_ms bigint, text string")
    s = spark.createDataFrame([("r", 1, 700, 950)], "run_id string, span int, start_ms bigint, end_ms bigint")
    assert [(r.start_ms, r.end_ms) for r in selects.snapped(s, w).collect()] == [(300, 1090)]


def test_too_fast_segments_are_dropped(spark):
    s = segs(spark, [(0, 2, "one two three"), (2, 2.3, "a b c d e f g"), (3, 9, "a b c d e f g"), (9, 9.1, "short")])
    assert [r.seg_idx for r in selects.plausible(s)[1].collect()] == [1]


def test_search_terms(spark):
    d = spark.createDataFrame([("Mr. Beast's seven   Thumbnails and the इंट्रो walking",)], "text string")
    assert d.select(retrieval.terms(F.col("text")).alias("t")).first().t == ["mrbeast'", "7", "thumbnail", "इंट्रो", "walk"]
    assert d.select(retrieval.query_terms(F.lit("intro pacing")).alias("t")).first().t == ["intro", "pacing", "hook", "open", "beginn", "pace", "energy", "cycle"]


def test_outliers_match_sorted_lists(spark):
    rows = [("g", float(v)) for v in (5, 5, 5, 6, 6, 7, 1, 5, 6, 5)] + [("h", 1.0)] * 5
    got = sorted(r.v for r in sequences.outliers_below(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect())
    v = sorted(x for k, x in rows if k == "g")
    mid = v[len(v) // 2]
    mad = sorted(abs(x - mid) for x in v)[len(v) // 2]
    assert got == [x for x in v if x < mid - 2.5 * max(mad, 0.005)]


def test_greedy_passages_by_stretches_match_a_loop(spark):
    rows = [("r", 0, p, p * 10, p * 10 + 25, float((p * 37) % 11)) for p in range(40) if p % 9]
    got = [r.passage for r in findings.top_passages(spark.createDataFrame(rows, "run_id string, query_id int, passage bigint, start_ms bigint, end_ms bigint, score double"), 5).orderBy("passage").collect()]
    want = []
    for r in sorted(rows, key=lambda r: (-r[5], -r[2])):
        if len(want) < 5 and all(r[3] >= w[4] or r[4] <= w[3] for w in want):
            want.append(r)
    assert got == sorted(r[2] for r in want)


def test_answers_that_fail_only_by_content_keep_their_finding(spark):
    long = "alpha bravo charlie delta echoes foxtrot golfing hotels"
    row = lambda i, proposed, ev: ("r", i, "accept", ev, ["E1"], "rewrite", long, proposed, "why")
    d = spark.createDataFrame([row(1, long, ["E1"]), row(2, "alpha only", ["E1"]), row(3, "alpha only", ["E2"])], "run_id string, candidate int, verdict string, evidence array<string>, allowed array<string>, option_kind string, original string, proposed string, explanation string")
    assert {(r.candidate, r.edit_dropped) for r in contracts.salvaged(d, contracts.decision_problems(d)).collect()} == {(1, False), (2, True)}


def test_sampling_plan_prefers_cuts(spark):
    frames = spark.createDataFrame([("r", t) for t in range(0, 5000, 300)], "run_id string, at_ms bigint")
    out = selects.sampling_plan(run_of(spark, 5), frames, spark.createDataFrame([("r", 1000)], "run_id string, at_ms bigint"), 3).collect()
    assert {(r.at_ms, tuple(r.reasons)) for r in out} == {(900, ("before cut", "grid")), (1200, ("after cut",)), (0, ("grid",))}


def test_stacked_questions(spark):
    q = [("r", i, s * 1000, s * 1000 + 4000, k, a) for i, (s, k, a) in enumerate([(70, "no_callback", None), (150, "open_loop", 400_000), (170, "no_callback", None), (180, "short", 200_000), (400, "no_callback", None)])]
    d = spark.createDataFrame(q, "run_id string, sent bigint, start_ms bigint, end_ms bigint, kind string, answer_ms bigint")
    assert [(r.start_ms, r.end_ms, r.n) for r in rules.stacked_questions(d).collect()] == [(150_000, 184_000, 3)]


def test_word_set_operators_and_boxes(spark):
    d = spark.createDataFrame([([1.0, 2.0], [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]])], "x array<double>, a array<array<double>>, b array<array<double>>")
    boxes = d.select(selects.box_of(F.col("a")).alias("a"), selects.box_of(F.col("b")).alias("b"))
    assert boxes.select(selects.box_overlap(F.col("a"), F.col("b")).alias("v")).first().v == pytest.approx(1 / 7)
    assert list(itertools.chain(*boxes.select("a.x0", "a.y1").collect())) == [0.0, 2.0]


def test_repetition_candidates(spark):
    lines = ["Quantum engines rotate slowly beside purple mountains today.", "Seven tired wizards paint enormous ceilings every winter.", "Coffee beans follow no particular rule at noon.", "Nobody counted the green bicycles near our river."]
    data = segs(spark, [(10 * i, 10 * i + 8, t) for i, t in enumerate([*lines, lines[0], lines[1], lines[3], "Wholly new closing remarks end this lovely talk."])]).withColumn("paragraph", F.floor(F.col("seg_idx") / 4))
    pairs = spark.createDataFrame([("r", 0, 1)], "run_id string, earlier bigint, later bigint")
    none = spark.createDataFrame([], "run_id string, start_ms bigint, end_ms bigint, text string")
    assert [(r.start_ms, r.end_ms, r.operation) for r in candidates.repetitions(pairs, data, none).collect()] == [(40_000, 68_000, "cut")]
    told = data.withColumn("text", F.when(F.col("seg_idx") == 3, "Let's watch that again.").otherwise(F.col("text")))
    assert candidates.repetitions(pairs, told, none).count() == 0
