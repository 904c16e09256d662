"""Numbers that the rules must give on tiny inputs."""

import math

from tidemark.operators import intervals, risk, scoring
from tidemark.sources.text import subtitle_cues

ISSUE = "run_id string, issue_id string, track string, severity string, evidence_status string, cause_group string, start_ms bigint, end_ms bigint"
SPAN = "run_id string, track string, start_ms bigint, end_ms bigint"


def bins(spark, duration, issues, tracks=("narrative", "visual", "pacing", "text", "technical")):
    r = spark.createDataFrame([("r", duration)], "run_id string, duration_ms bigint")
    s = spark.createDataFrame([("r", t, 0, duration) for t in tracks], SPAN)
    return risk.risk_bins(r, spark.createDataFrame(issues, ISSUE), s)


def test_half_overlap_and_no_stacking(spark):
    i = [("r", "a", "narrative", "high", "supported", "g", 0, 2500), ("r", "b", "narrative", "high", "supported", "g", 0, 2500)]
    first = bins(spark, 600_000, i).where("bin = 0").first()
    assert first.point == 0.15 and first.dominant_cause == "g" and first.issue_ids == ["a", "b"]


def test_unknown_track_widens_the_bounds(spark):
    b = bins(spark, 601_000, [], ("narrative", "pacing", "text", "technical")).orderBy("bin").collect()
    assert len(b) == 121 and b[-1].end_ms - b[-1].start_ms == 1000
    assert all(math.isclose(x.upper - x.lower, 0.25, abs_tol=1e-6) and x.point is None for x in b)


def test_survival_meets_both_anchors(spark):
    s = {r.bin: r.survival_end for r in risk.survival(bins(spark, 600_000, []), "point").collect()}
    assert abs(s[5] - 0.80) < 1e-6 and abs(s[119] - 0.45) < 1e-6


def test_fractional_last_second(spark):
    r = spark.createDataFrame([("r", 10_250)], "run_id string, duration_ms bigint")
    c = scoring.curve(r, spark.createDataFrame([], "run_id string, t int, feature string, value double")).orderBy("t").collect()
    assert len(c) == 11 and abs(c[-1].retention - 0.45) < 1e-6


def test_only_one_protective_feature_counts(spark):
    r = spark.createDataFrame([("r", 20_000)], "run_id string, duration_ms bigint")
    f = spark.createDataFrame([("r", 3, n, 1.0) for n in scoring.PROTECTIVE], "run_id string, t int, feature string, value double")
    x = scoring.curve(r, f).where("t = 3").first()
    assert abs(x.hazard / x.baseline_hazard - math.exp(-0.1)) < 1e-5


def test_time_remap_through_cuts(spark):
    p = spark.createDataFrame([("r", t) for t in (15_000, 30_000, 50_000, 5_000)], "run_id string, at_ms bigint")
    c = spark.createDataFrame([("r", 10_000, 20_000), ("r", 40_000, 45_000)], "run_id string, start_ms bigint, end_ms bigint")
    assert {(r.at_ms, r.new_ms) for r in intervals.remap(p, c).collect()} == {(15_000, 10_000), (30_000, 20_000), (50_000, 35_000), (5_000, 5_000)}


def test_subtitle_cues(spark):
    text = "1\n00:00:01,500 --> 00:00:03,000\n<i>Hello</i>\nyou\n\n2\n00:00:05.000 --> 00:00:04.000\nbad\n\n01:02.5 --> 01:04\nlast"
    good, bad = subtitle_cues(spark.createDataFrame([("f", text)], "path string, value string"))
    assert [(r.start_ms, r.end_ms, r.text) for r in good.orderBy("seg_idx").collect()] == [(1500, 3000, "Hello you"), (62_500, 64_000, "last")]
    assert bad.count() == 1


def test_journal_stream_keeps_the_latest_status(spark, tmp_path):
    from tidemark.streaming import jobs

    rows = [("r", "a", "2024-01-01 00:00:00", "start", "running", 1, None), ("r", "a", "2024-01-01 00:00:05", "finish", "ok", 1, 5.0)]
    spark.createDataFrame(rows, "run_id string, stage string, at string, event string, status string, attempt int, elapsed_s double").selectExpr("run_id", "stage", "to_timestamp(at) as at", "event", "status", "attempt", "elapsed_s").write.json(str(tmp_path / "in"))
    got = []
    s = spark.readStream.schema("run_id string, stage string, at timestamp, event string, status string, attempt int, elapsed_s double").json(str(tmp_path / "in"))
    jobs.start(jobs.stage_status(s), str(tmp_path / "cp"), lambda df, n: got.extend(df.collect())).awaitTermination(60)
    assert [(r.status, r.attempts, r.elapsed_s) for r in got] == [("ok", 1, 5.0)]
