from tidemark.operators import features, merges, sentences
from tidemark.operators.features import RUN


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df):
    return {r.t: r.value for r in df.collect()}


def test_long_sentence_counts_by_its_share_of_the_second(spark):
    runs = frame(spark, [("r", 10_250)], "run_id string, duration_ms bigint")
    seg = frame(spark, [("r", 250, 9000, " ".join(["w"] * 36) + ".")], "run_id string, start_ms bigint, end_ms bigint, text string")
    got = values(features.long_sentences(runs, seg))
    assert round(got[0], 9) == round(0.3 * 0.75, 9) and round(got[5], 9) == 0.3 and 9 not in got


def test_last_second_is_a_short_one(spark):
    runs = frame(spark, [("r", 10_250)], "run_id string, duration_ms bigint")
    seg = frame(spark, [("r", 10_000, 11_000, "3 of them"), ("r", 0, 1000, "none"), ("r", 5000, 5500, None)], "run_id string, start_ms bigint, end_ms bigint, text string")
    assert values(features.concrete(runs, seg)) == {10: 1.0}


def test_static_shot_ramps_after_its_limit(spark):
    rows = [("r", k * 4000, (k + 1) * 4000, 0.9) for k in range(10)] + [("r", 40_000, 80_000, 0.1)] + [("r", 80_000 + k * 4000, 84_000 + k * 4000, 0.5) for k in range(5)]
    got = values(features.static_shots(frame(spark, rows, "run_id string, start_ms bigint, end_ms bigint, motion double")))
    assert sorted(got) == list(range(52, 80)) and got[52] == 0.5 and got[64] == 1.0


def test_pulse_fades_and_ends_with_the_run(spark):
    runs = frame(spark, [("r", 21_500)], "run_id string, duration_ms bigint")
    got = values(features.pulse(runs, frame(spark, [("r", 5000), ("r", 6100), ("r", 20_900)], "run_id string, at_ms bigint"), "x"))
    assert {t: round(v, 6) for t, v in got.items()} == {5: 1.0, 6: 1.0, 7: 0.666667, 8: 0.333333, 20: 1.0, 21: 0.666667}


def test_fillers_match_a_loop(spark):
    runs = frame(spark, [("r", 60_000)], "run_id string, duration_ms bigint")
    rows = [("r", 0, 4000, "Um, you know, basically it"), ("r", 30_000, 34_000, "uh"), ("r", 38_000, 42_000, "kind of, umbrella; um um"), ("r", 50_000, 51_000, None)]
    got = values(features.filler_density(runs, frame(spark, rows, "run_id string, start_ms bigint, end_ms bigint, text string")))
    at = [2000] * 3 + [32_000] + [40_000] * 3
    want = {t: min(1.0, n * 3 / 6) for t in range(60) if (n := sum(abs(x - t * 1000) <= 10_000 for x in at)) >= 2}
    assert got == want


def test_ranked_findings_match_a_loop(spark):
    rows = [("r", k, "a" if k % 3 else "comprehension", ("low", "medium", "high")[k % 3], ("supported", "provisional")[k % 2], k % 4 == 0, k * 3000, k * 3000 + 4000 + 1500 * (k % 5)) for k in range(20)]
    rows += [("r", 20, "a", "high", "supported", True, 3000, 9000), ("r", 21, "a", "high", "supported", True, 3000, 9000), ("q", 1, None, None, None, None, 0, 0)]
    schema = "run_id string, finding_id bigint, cause_group string, severity string, evidence_strength string, safe_edit boolean, start_ms bigint, end_ms bigint"
    got = {(r.run_id, r.finding_id): (r.priority_score, r.duplicate_of, r.priority_rank) for r in merges.rank_findings(frame(spark, rows, schema)).collect()}

    def raw(f):
        _, _, group, severity, evidence, safe, a, b = f
        parts = (0.3 * {"supported": 1.0}.get(evidence, 0.5), 0.25 * {"medium": 2 / 3, "high": 1.0}.get(severity, 1 / 3), 0.15 * bool(safe), 0.1 * min(1.0, (b - a) / 30_000), 0.1 * (group == "comprehension"))
        return sum(parts)

    want = {}
    for run in ("r", "q"):
        kept, out = [], []
        for f in sorted((f for f in rows if f[0] == run), key=lambda f: (-round(raw(f), 12), f[6], f[1])):
            twin = next((k for k in kept if k[2] == f[2] and max(0, min(k[7], f[7]) - max(k[6], f[6])) / max(1, min(k[7] - k[6], f[7] - f[6])) >= 0.5), None)
            if twin is None:
                kept.append(f)
            out.append((round(100 * raw(f) * (0.5 if twin else 1), 2), f, twin and twin[1]))
        for rank, (score, f, of) in enumerate(sorted(out, key=lambda x: (-x[0], x[1][6], x[1][1])), 1):
            want[run, f[1]] = (score, of, rank)
    assert got == want


def test_first_source_wins_and_nulls_form_a_group(spark):
    a, b = frame(spark, [("k", 1), (None, 2)], "key string, v int"), frame(spark, [("k", 3), ("m", 4), (None, 5)], "key string, v int")
    assert sorted((str(r.key), r.v, r.source) for r in merges.first_wins([("a", a), ("b", b)], ["key"]).collect()) == [("None", 2, "a"), ("k", 1, "a"), ("m", 4, "b")]


def test_empty_runs_give_no_rows(spark):
    runs = frame(spark, [], "run_id string, duration_ms bigint")
    seg = frame(spark, [], "run_id string, seg_idx int, start_ms bigint, end_ms bigint, text string")
    for df in (features.concrete(runs, seg), features.long_sentences(runs, seg), features.filler_density(runs, seg), sentences.cognitive_load(sentences.sentences(seg)), sentences.rhythm(sentences.sentences(seg)), sentences.questions(sentences.sentences(seg)), features.best_earlier(seg)):
        assert RUN in df.columns and df.count() == 0
