"""Ordered passes against loops, with small blocks."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, same
from tidemark.operators import passes
from tidemark.plans import screens
from tidemark.plans.catalogue import QUERIES, SQL


def runs_of(seed, longest=60):
    rng = random.Random(seed)
    return {r: [(rng.choice((0, 1, 5, 20, 49, 50, 51, 99, 100, 120, 230)), rng.random() < 0.5) for _ in range(rng.randrange(1, longest))] for r in range(12)}


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(passes, "BLOCK", 64)


def test_paragraphs_equal_a_loop(spark):
    runs = runs_of(1)
    rows = [(r, 3 * i, " ".join(["w"] * n) + ("." if ends else "")) for r, segs in runs.items() for i, (n, ends) in enumerate(segs)]
    # A full stop alone is a word.
    want = set()
    for r, segs in runs.items():
        cur, n, number = [], 0, 0
        for i, (k, ends) in enumerate(segs):
            k = k or int(ends)
            if cur and n + k > 200 and n >= 50:
                number += 1
                want.add((r, number, cur[0], cur[-1], n))
                cur, n = [], 0
            cur.append(3 * i)
            n += k
            if n >= 100 and ends:
                number += 1
                want.add((r, number, cur[0], cur[-1], n))
                cur, n = [], 0
        if cur:
            want.add((r, number + 1, cur[0], cur[-1], n))
    d = spark.createDataFrame(rows, "run_id int, seg_idx int, text string")
    assert {tuple(x) for x in passes.paragraphs(d).collect()} == want
    assert passes.paragraphs(d.limit(0)).collect() == []


def test_batches_equal_a_loop(spark):
    runs, want = runs_of(2), {}
    for r, segs in runs.items():
        k = size = batch = 0
        for i, (n, _) in enumerate(segs):
            if k and (k >= 4 or size + n > 200):
                batch, k, size = batch + 1, 0, 0
            k, size = k + 1, size + n
            want[r, i] = batch
    d = spark.createDataFrame([(r, i, n) for r, segs in runs.items() for i, (n, _) in enumerate(segs)], "run_id int, i0 int, n int")
    assert {(x.run_id, x.i0): x.batch for x in passes.batches(d, "i0", F.col("n"), 4, 200).collect()} == want


def test_pointer_doubling_over_a_long_run(spark):
    nexts = spark.range(3000).select(F.lit("r").alias("run_id"), F.col("id").alias("i"), F.when(F.col("id") < 2995, F.col("id") + 1 + F.col("id") % 7).alias("to"))
    want, i = [0], 0
    while i < 2995:
        i += 1 + i % 7
        want.append(i)
    assert sorted(r.i for r in passes.chained(nexts).collect()) == want


def test_kept_frames_equal_a_loop(spark):
    runs = {}
    for r in screens.signatures(spark, DATA).orderBy("at_ms").collect():
        runs.setdefault(r.run_id, []).append((r.at_ms, list(r.signature)))
    runs[10**6] = [(0, None), (1, [1.0]), (2, [1.2]), (3, [1.0, 1.0]), (4, [1.0]), (5, None), (6, [])]
    rows = [(r, *f) for r, frames in runs.items() for f in frames]
    got = {(x.run_id, x.at_ms): x.reused_from for x in passes.reused(spark.createDataFrame(rows, "run_id bigint, at_ms bigint, signature array<double>")).collect()}
    reused = 0
    for r, frames in runs.items():
        kept = None
        for at, s in frames:
            near = kept and kept[1] is not None and s is not None and len(s) == len(kept[1]) > 0 and sum(abs(a - b) for a, b in zip(s, kept[1], strict=True)) / len(s) < 0.6
            assert got[r, at] == (kept[0] if near else None)
            reused += bool(near)
            kept = kept if near else (at, s)
    assert len(rows) * 0.2 < reused < len(rows) * 0.9


def turns(candidates, reasons, most):
    pools = {r: sorted((c for c in candidates if c[0] == r), key=lambda c: (-c[3], c[1])) for r in reasons}
    taken = []
    while len(taken) < most and any(pools.values()):
        for r in reasons:
            while pools[r] and len(taken) < most:
                c = pools[r].pop(0)
                if all(c[1] >= t[2] or c[2] <= t[1] for t in taken):
                    taken.append(c)
                    break
    return taken


def test_turns_equal_a_loop(spark):
    rng, reasons = random.Random(4), ["a", "b", "c"]
    runs = {r: [(rng.choice("aabc"[: 1 + r % 4]), s := rng.randrange(60), s + rng.randrange(1, 12), rng.randrange(5) / 4) for _ in range(rng.randrange(1, 40))] for r in range(10)}
    runs = {r: list({(c[0], c[1]): c for c in cs}.values()) for r, cs in runs.items()}
    d = spark.createDataFrame([(r, *c) for r, cs in runs.items() for c in cs], "run_id int, reason string, start_ms bigint, end_ms bigint, score double")
    got = {}
    for x in passes.by_turns(d, reasons, 5).orderBy("run_id", "turn").collect():
        got.setdefault(x.run_id, []).append(tuple(x)[2:])
    assert got == {r: turns(cs, reasons, 5) for r, cs in runs.items()}
    assert passes.by_turns(d.limit(0), reasons).collect() == []


def test_refinement_windows_equal_a_loop(spark):
    texts, cuts, motion, runs = (x.where("run_id < 60") for x in screens.looks(spark, DATA))
    t, c, m = {}, {}, {}
    for r in texts.collect():
        t.setdefault(r.run_id, []).append(r)
    for r in cuts.collect():
        c.setdefault(r.run_id, []).append(r.at_ms)
    for r in motion.orderBy("at_ms").collect():
        m.setdefault(r.run_id, []).append((r.at_ms, r.value))
    want = {}
    for r in runs.collect():
        found = []
        for x in t.get(r.run_id, []):
            share = (x.y1 - x.y0) / 1080
            if share < 0.035 and x.confidence >= 0.5:
                found.append(("small_text", max(0, x.start_ms - 1000), 1 - share / 0.035))
        for s in range(0, r.end_ms, 5000):
            n = sum(s <= x < s + 10_000 for x in c.get(r.run_id, []))
            if n >= 5:
                found.append(("fast_cuts", s, n / 10))
        values = sorted(v for _, v in m[r.run_id])
        if len(values) > 20:
            limit = values[int(0.98 * len(values))]
            found += [("fast_action", max(0, at - 3000), v) for at, v in m[r.run_id] if v >= limit and v > 0.05]
        windows = [(k, s, min(r.end_ms, s + 10_000), v) for k, s, v in found]
        want[r.run_id] = [w[:3] for w in turns([w for w in windows if w[2] - w[1] >= 2000], ["small_text", "fast_cuts", "fast_action"], 8)]
    got = {r: [] for r in want}
    for x in passes.refinements(texts, cuts, motion, runs, 1080).orderBy("run_id", "turn").collect():
        got[x.run_id].append((x.reason, x.start_ms, x.end_ms))
    assert got == want and sum(len(w) == 8 for w in want.values()) > 5


def test_tiers_match_sql_and_a_loop(spark):
    same(spark, QUERIES["t09_tiered_frames"], SQL["t09_tiered_frames"])
    rng = random.Random(6)
    groups = {g: [rng.choice((0, 0, 1, 2, 4, None)) for _ in range(rng.randrange(1, 60))] for g in range(20)}
    d = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g int, i int, t int")
    want = set()
    for g, ts in groups.items():
        chosen = 0
        for t in range(5):
            own, room = [i for i, x in enumerate(ts) if x == t], 13 - chosen
            if room > 0:
                own = [own[int(k * (len(own) / room))] for k in range(room)] if len(own) > room else own
                chosen += len(own)
                want |= {(g, i) for i in own}
    assert {(r.g, r.i) for r in passes.tiered(d, ["g"], F.col("t"), "i", 13).collect()} == want
