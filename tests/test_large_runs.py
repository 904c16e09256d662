"""Findings of round 3: results and rows on runs that the small tables lack."""

import re

from pyspark.sql import functions as F

from tests import oracle
from tidemark.operators import contracts, findings, links, scoring, selects, sequences, signals, whatif, wording
from tidemark.operators import sentences as st
from tidemark.operators.intervals import dealt
from tidemark.plans.catalogue import QUERIES, SQL
from tidemark.sources.working import written


def over(spark, tmp_path, name, **tables):
    """(rows of the query, rows of its SQL) over tables of rows (lists of dicts)."""
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{tmp_path}/{t}.parquet", index=False)
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    return oracle.rows(QUERIES[name](spark, str(tmp_path)).toPandas()), oracle.rows(con.execute(SQL[name]).df())


def test_concreteness_rounds_in_doubles(spark):
    text = " ".join(f"{k} zz" for k in range(9)) + " zz" * 62
    x = st.concreteness(spark.createDataFrame([(1, 0, 0, 1000, text, False)], "run_id long, sent long, start_ms long, end_ms long, text string, punctuated boolean"))
    assert x.select("markers", F.col("score").cast("string")).collect() == [(9, "0.68")]


def test_summary_rounds_in_doubles(spark):
    kind = "run_id long, bin long, end_ms long, lower_end double, upper_end double, central_end double, lower_watched double, upper_watched double"
    x = whatif.scenario_summary(spark.createDataFrame([(1, 60, 610_000, 0.2, 0.3, None, 261.715, 295.65)], kind)).collect()[0]
    assert (x.least_watched_s, x.most_watched_s, x.complete) == (261.71, 295.65, False)


def long_documents():
    return [{"doc_id": i, "text": "\n".join(["Line of words."] * 500), "lang": "en", "source": "a", "n_chars": 1} for i in range(1, 5)]


def test_promises_of_long_runs(spark, tmp_path):
    got, want = over(spark, tmp_path, "k13_promises", documents=long_documents())
    assert got == want


def test_structure_signals_of_long_runs(spark, tmp_path):
    got, want = over(spark, tmp_path, "k14_structure_signals", documents=long_documents())
    assert got == want


def test_chapters_of_long_runs(spark, tmp_path):
    got, want = over(spark, tmp_path, "k11_chapters", documents=long_documents())
    assert got == want


def spread(df) -> list[str]:
    """What the explode steps of a plan put out: the names of the columns that each of their rows carries."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate" and "explode" in node.generator().toString():
            found += [node.output().apply(i).name() for i in range(node.output().size())]
    return found


def test_quotes_spread_no_texts(spark):
    q = spark.createDataFrame([(1, 0, "said a lot here"), (1, 1, "lot he"), (1, 2, "x"), (1, 3, "end and then"), (1, 4, " "), (2, 0, "lot")], "run_id int, quote_id int, quote string")
    s = spark.createDataFrame([(1, 0, "We said  a LOT here"), (1, 1, "the end"), (1, 2, "and then x"), (1, 3, None)], "run_id int, seg_idx int, text string")
    spoken = links.spoken_quotes(q, s)
    assert {(r.run_id, r.quote_id): (r.seg_idx, r.across) for r in spoken.collect()} == {(1, 0): (0, False), (1, 1): (0, False), (1, 2): (2, False), (1, 3): (1, True), (1, 4): (None, False), (2, 0): (None, False)}
    assert not {"_t", "_two", "text"} & set(spread(spoken) + spread(links.exact_quotes(q, s)))


def test_located_quotes_spread_no_texts(spark):
    q = spark.createDataFrame([(1, 0, 5, "seven words were spoken about the river"), (1, 1, 1, "seven words were spoken about the river"), (1, 2, 9, "river boats")], "run_id int, quote_id int, passage int, quote string")
    p = spark.createDataFrame([(1, 0, "seven words were spoken about the river"), (1, 1, "other things"), (1, 2, "river"), (1, 3, "the river boats")], "run_id int, passage int, text string")
    x = links.located_quotes(q, p)
    assert {r.quote_id: (r.at_passage, r.ratio) for r in x.collect()} == {0: (0, 1.0), 1: (0, 1.0), 2: (3, 1.0)}
    assert "text" not in spread(x)


def test_terms_spread_no_texts(spark):
    x = st.term_dependencies(spark.createDataFrame([(1, 0, 0, 1, "A neural net helps", True), (1, 1, 1, 2, "This is a neural net, you see.", True)], "run_id int, sent int, start_ms int, end_ms int, text string, punctuated boolean"))
    assert [(r.term, r.explained, r.used) for r in x.collect()] == [("neural net", 1, 0)]
    assert not {"_low", "text"} & set(spread(x))


def test_novelty_lists_no_words_per_stretch(spark):
    runs = spark.createDataFrame([(1, 60_000), (2, 60_000)], "run_id int, duration_ms long")
    lines = ["alpha beta gamma", "beta delta gamma", "alpha epsilon", "zeta beta", "alpha alpha eta"]
    # The second run has a long segment that outlasts the one after it: its stretches skip numbers.
    rows = [(1, i, i * 4000, i * 4000 + 4000, x) for i, x in enumerate(lines)] + [(2, i, i * 4000, 40_000 if i == 1 else i * 4000 + 4000, x) for i, x in enumerate(lines)]
    x = signals.window_novelty(runs, spark.createDataFrame(rows, "run_id int, seg_idx int, start_ms long, end_ms long, text string"), 1)
    words = {(r, i): set(x.split()) for r, i, _, _, x in rows}
    want = {}
    for r, t in ((r, t) for r in (1, 2) for t in range(60)):
        segs = [i for q, i, a, b, _ in rows if q == r and b > t * 1000 - 10_000 and a < t * 1000 + 10_000]
        said = set().union(*[words[r, i] for i in segs])
        if said:
            want[r, t] = round(len(said - set().union(*[words[r, i] for i in range(segs[0])])) / len(said), 9)
    assert {(r.run_id, r.t): round(r.novelty, 9) for r in x.collect()} == want
    # Stretches are spread as ranges of segments.
    assert "lo" in spread(x)


def test_endings_are_laid_out_once(spark):
    runs = spark.createDataFrame([(1, 100_000)], "run_id int, duration_ms long")
    s = spark.createDataFrame([(1, "outro", k * 1000 + 500, k * 1000 + 900) for k in range(90)] + [(1, "cta", 2000, 3000), (1, "sponsor", 90_000, 91_000)], "run_id int, kind string, start_ms long, end_ms long")
    got = {(r.feature, r.t): r.value for r in signals.interruptions(runs, s).collect()}
    assert got == {("cta_or_sponsor", 2): 1.0} | {("outro", t): 0.5 if t == 0 else 1.0 for t in range(100)}
    ends = signals.interruptions(runs, s)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(start_ms" in ends


def test_curve_is_dealt_out(spark):
    """Adaptive execution joins small parts to one, but not those dealt by number."""
    runs = spark.createDataFrame([(k, 60_000) for k in range(50)], "run_id int, duration_ms long")
    f = spark.createDataFrame([(k, 5, "dead_air", 1.0) for k in range(50)], "run_id int, t int, feature string, value double")
    x = scoring.curve(runs, f)
    assert x.count() == 3000 and x._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 4


def frames_to_the_end(df):
    """Window frames that reach to the partition's end from each row on: Spark scans these anew for each row."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"(?:currentrow\$\(\)|RangeFrame, \d+|RowFrame, \d+), unboundedfollowing", plan))


def test_sampling_plan_goes_once_over_a_run(spark):
    runs = spark.createDataFrame([(1, 6000)], "run_id int, duration_ms long")
    frames, cuts = [0, 700, 1400, 2000, 2800, 5600], [2000, 2100, 5900]
    at = lambda v: spark.createDataFrame([(1, t) for t in v], "run_id int, at_ms long")
    x = selects.sampling_plan(runs, at(frames), at(cuts), 2**31 - 1)
    want = {}
    for t in range(6):
        want.setdefault(max(f for f in frames if f <= t * 1000), set()).add("grid")
    for c in cuts:
        want.setdefault(max(f for f in frames if f < c), set()).add("before cut")
        want.setdefault(min((f for f in frames if f >= c), default=None), set()).add("after cut")
    want.pop(None)
    assert {r.at_ms: r.reasons for r in x.collect()} == {k: sorted(v) for k, v in want.items()}
    assert frames_to_the_end(x) == 0 and "collect_set" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_snapping_goes_once_over_a_run(spark):
    words = [(i * 300, i * 300 + 250, "end." if i % 7 == 3 else "word") for i in range(60)]
    w = spark.createDataFrame([(1, a, b, t) for a, b, t in words], "run_id int, start_ms long, end_ms long, text string")
    spans = [(k, k * 450, k * 450 + 1700) for k in range(30)] + [(90, 17_900, 30_000)]
    x = selects.snapped(spark.createDataFrame([(1, *s) for s in spans], "run_id int, span int, start_ms long, end_ms long"), w)
    want = {}
    for k, a, b in spans:
        before, after = [i for i in range(60) if words[i][0] < a], [i for i in range(60) if words[i][0] >= a]
        y0 = a
        if before and words[before[-1]][2] == "word":
            y0 = words[max([i + 1 for i in before if words[i][2] == "end."], default=0)][0]
        elif after:
            y0 = words[after[0]][0]
        last, stops = [v for v in words if v[0] < b][-1:], [v[1] for v in words if v[0] >= b and v[2] == "end."]
        inside = last and last[0][0] >= y0
        want[k] = (y0, last[0][1] if inside and last[0][2] == "end." else stops[0] if inside and stops and stops[0] - b <= 15_000 else b)
    assert {r.span: (r.start_ms, r.end_ms) for r in x.collect()} == want
    assert frames_to_the_end(x) == 0


def test_shortenings_spread_no_texts(spark, tmp_path):
    """Quotes that end within their fourth word count as held, too."""
    long = "abcdefghijklmnopqrstuvw bcdefghijklmnopqrstuvwx cdefghij defghijkl"
    say = [long, "short", long, "one two three four five six", "nothing of that kind is here", "one two three four five six", None]
    got, want = over(spark, tmp_path, "d23_shortenings", conversations=[{"conv_id": 1, "turn": i, "role": "user", "text": x} for i, x in enumerate(say)])
    assert got == want
    d = spark.createDataFrame([(1, 2, 20, "a b c d e", "x", "x y")], "run_id int, passage int, start_ms int, quote string, draft string, original string")
    x = contracts.shortening_problems(d, spark.createDataFrame([(1, 0, "so a b c d e f"), (1, 30, "a b c d e")], "run_id int, start_ms int, text string"))
    assert x.count() == 0 and not {"_t", "text"} & set(spread(x))


def test_tables_of_seconds_are_not_broadcast(spark):
    """Packed they look small; written features are planned by their files' sizes."""
    data = lambda rows, cols: written(spark.createDataFrame(rows, cols), "test")
    runs = data([(1, 60_000)], "run_id int, duration_ms long")
    loud = data([(1, t * 1000, -20.0 - 15 * (t >= 40)) for t in range(60)], "run_id int, t_ms long, lufs double")
    level = signals.levels(runs, loud, data([(1, 0, 60_000)], "run_id int, start_ms long, end_ms long"))
    x = signals.loudness_drop(level, data([(1, 41)], "run_id int, t int"))
    assert sorted(r.t for r in x.collect()) == [42, 43, 44] and "Broadcast" not in x._jdf.queryExecution().executedPlan().toString()
    local = data([(1, t, 150.0, 140.0) for t in range(60)], "run_id int, t int, wpm double, usual double")
    y = signals.micro_variation(runs, local, loud, data([(1, 5000), (1, 30_000)], "run_id int, at_ms long"))
    assert y.count() > 0 and frames_to_the_end(y) == 0


def test_spans_go_once_over_a_run(spark):
    script = [(1, k, "ok" if k not in (3, 5, 9) else "sub", k, k, f"r{k}", k * 10, f"h{k}", k * 10) for k in range(12)]
    d = spark.createDataFrame(script, "run_id int, k int, op string, i int, j int, ref_word string, ref_ms int, hyp_word string, hyp_ms int")
    x = wording.spans(d.withColumn("t_ms", F.col("ref_ms")))
    assert sorted((r.t_ms, r.reference, r.ours) for r in x.collect()) == [(30, "r3 r4 r5", "h3 h4 h5"), (90, "r9", "h9")]
    assert frames_to_the_end(x) == 0


def moved(df) -> list[str]:
    """By what the rows of a plan are dealt out."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0])


def by_run(spark, rows, schema):
    return dealt(spark.createDataFrame(rows, schema), "run_id")


def lines(spark):
    say = ["alpha beta gamma delta", "epsilon zeta eta theta", "alpha beta gamma delta", "alpha beta gamma delta iota", "", "the of"]
    return by_run(spark, [(r, i, i * 4000, i * 4000 + 4000, x) for r in (1, 2) for i, x in enumerate(say[r - 1 :])], "run_id int, seg_idx int, start_ms bigint, end_ms bigint, text string")


def test_documents_are_dealt_out_once(spark):
    from tests.oracle import DATA
    from tidemark.plans import inputs

    for x in (inputs.talk(spark, DATA, True), inputs.segments(spark, DATA, True)):
        assert len(moved(x)) == 1 and "REPARTITION_BY_NUM" in x._jdf.queryExecution().executedPlan().toString()


def test_pace_joins_no_seconds(spark):
    """Words before the run's start, and beyond its end, and long silences."""
    words = [(1, 20_000 + 300 * i, 20_250 + 300 * i) for i in range(60)] + [(1, 70_000 + 400 * i, 70_350 + 400 * i) for i in range(40)] + [(2, 100 * i, 100 * i + 50) for i in range(49)]
    w = by_run(spark, words, "run_id int, start_ms bigint, end_ms bigint")
    x = signals.local_pace(by_run(spark, [(1, 80_000), (2, 80_000)], "run_id int, duration_ms bigint"), w)
    want, own = {}, sorted((a, b) for r, a, b in words if r == 1)
    for t in range(80):
        near = [(a, b, max(0, min(500, own[i + 1][0] - b)) if i + 1 < len(own) else 0) for i, (a, b) in enumerate(own) if (t - 10) * 1000 <= a < (t + 10) * 1000]
        speak = sum(b - a + g for a, b, g in near) - (near[-1][2] if near else 0)
        if speak > 4000 and len(near) >= 8:
            want[t] = round(60_000 * len(near) / speak, 6)
    assert {r.t: round(r.wpm, 6) for r in x.collect()} == want and 40 < len(want) < 80
    assert all(k.startswith("run_id") and "," not in k for k in moved(x))


def test_new_words_are_counted_without_windows(spark):
    x = sequences.novelty(lines(spark))
    assert {(r.run_id, r.seg_idx): (r.n_words, round(r.new_share, 6), r.reused_share) for r in x.collect() if r.run_id == 1} == {(1, 0): (4, 1.0, 0.0), (1, 1): (4, 1.0, 0.0), (1, 2): (4, 0.0, 1.0), (1, 3): (5, 0.2, round(2 / 3, 17)), (1, 4): (0, 1.0, 0.0), (1, 5): (2, 1.0, 0.0)}
    assert "Window" not in x._jdf.queryExecution().optimizedPlan().toString() and not [k for k in moved(x) if "item" in k]
    assert "text" not in findings.repetition_runs(lines(spark))._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]


def test_repeated_runs_move_no_word_runs(spark):
    sg = lines(spark).withColumn("paragraph", F.floor(F.col("seg_idx") / 2))
    x = selects.repeated_runs(spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1)], "run_id int, earlier int, later int"), sg)
    assert [tuple(r) for r in x.collect()] == [(1, 0, 1, 2, 3)]
    assert not [k for k in moved(x) if re.search(r"\bg#", k)]


def test_dense_text_joins_no_seconds(spark):
    local = by_run(spark, [(1, t, 200.0 if t > 5 else 100.0, 150.0) for t in range(10)], "run_id int, t int, wpm double, usual double")
    tracks = spark.createDataFrame([(1, 0, 8000, "w " * 18, 0.9), (1, 6000, 7000, "two words", 0.9)], "run_id int, start_ms bigint, end_ms bigint, text string, confidence double")
    x = signals.dense_text(tracks, local)
    assert {r.t: r.value for r in x.collect()} == {6: 20 / 24, 7: 18 / 24}
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
