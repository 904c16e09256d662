from pyspark.sql import functions as F

from tidemark.operators import findings

SPAN = "run_id string, issue_id bigint, start_ms bigint, end_ms bigint"


def test_cut_plan_removes_what_it_covers(spark):
    runs = spark.createDataFrame([("r", 120_000), ("q", 5000)], "run_id string, duration_ms bigint")
    spans = spark.createDataFrame([("r", 1, 12_000, 18_000), ("r", 2, 5000, 25_000), ("r", 3, 20_000, 21_000)], SPAN)
    out = {r.run_id: tuple(r)[1:] for r in findings.cut_plan(runs, spans, spark.createDataFrame([("r", 10_000, 20_000)], "run_id string, start_ms bigint, end_ms bigint")).collect()}
    assert out == {"r": (120_000, 10_000, 110_000, 3, 1), "q": (5000, 0, 5000, 0, 0)}


def test_short_tail_joins_the_clip_before(spark):
    runs = spark.createDataFrame([("a", 41_000), ("b", 42_000), ("c", 1000), ("d", 0)], "run_id string, duration_ms bigint")
    out = {}
    for r in findings.clips(runs).orderBy("run_id", "clip").collect():
        out.setdefault(r.run_id, []).append((r.start_ms, r.end_ms, r.context_start, r.context_end))
    assert out == {"a": [(0, 20_000, 0, 22_000), (20_000, 41_000, 18_000, 41_000)], "b": [(0, 20_000, 0, 22_000), (20_000, 40_000, 18_000, 42_000), (40_000, 42_000, 38_000, 42_000)], "c": [(0, 1000, 0, 1000)]}


def test_batches_match_a_loop(spark):
    sizes = [5, 40, 30, 31, 1, 1, 1, 1, 200, 2, 99, 1, 1, 60]
    got = [r.batch for r in findings.batches(spark.createDataFrame([("r", i, n) for i, n in enumerate(sizes)], "run_id string, seg_idx int, n int"), "seg_idx", F.col("n"), 4, 100).orderBy("seg_idx").collect()]
    want, batch, k, total = [], -1, 0, 0
    for n in sizes:
        if batch < 0 or k >= 4 or total + n > 100:
            batch, k, total = batch + 1, 0, 0
        k, total = k + 1, total + n
        want.append(batch)
    assert got == want


def test_top_passages_match_a_loop(spark):
    rows = [("r", 1, p, p * 10, p * 10 + 25, float((p * 7) % 5)) for p in range(12)]
    got = [(r.passage, r.score) for r in findings.top_passages(spark.createDataFrame(rows, "run_id string, query_id int, passage bigint, start_ms bigint, end_ms bigint, score double"), 3).orderBy("passage").collect()]
    want = []
    for _, _, p, a, b, s in sorted(rows, key=lambda x: (-x[5], -x[2])):
        if len(want) < 3 and all(not (a < q * 10 + 25 and b > q * 10) for q, _ in want):
            want.append((p, s))
    assert got == sorted(want)
