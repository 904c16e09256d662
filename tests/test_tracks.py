"""Text tracks: batch against a loop, stream against batch."""

import difflib
import json
import random

import pytest

from tidemark.operators import tracks

BOX = "struct<x0:double,y0:double,x1:double,y1:double,text:string,score:double>"
FRAME = f"run_id bigint, at_ms bigint, boxes array<{BOX}>"


def frames_of(seed, n=60):
    """Captions that move, change a letter, vanish and compete, a lasting label, and empty samples."""
    rng, out, words = random.Random(seed), [], ["hello there friend", "hello there fiend", "another caption", "Straße und Weg"]
    shown = []
    for t in range(n):
        shown = [s for s in shown if rng.random() > 0.15]
        while rng.random() < 0.5 and len(shown) < 5:
            shown.append([rng.choice((0.0, 4.0, 8.0, 300.0)), rng.choice((0.0, 3.0, 200.0)), rng.choice(words)])
        boxes = []
        for x, y, text in shown:
            if rng.random() < 0.8:
                k = rng.randrange(len(text))
                boxes.append((x, y, x + 60.0, y + 20.0, text if rng.random() < 0.6 else text[:k] + "x" + text[k + 1 :], rng.choice((0.4, 0.5, 0.9, 0.9, 0.95))))
        if rng.random() < 0.9:
            boxes.append((0.0, 500.0, 50.0, 520.0, "LOGO", 0.8))
        if rng.random() < 0.1:
            boxes = []
        out.append((t * 1000, boxes))
    return out


def loop(frames, end):
    """The rules, one frame after the other."""

    def shared(a, b):
        w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
        return w * h / both if both > 0 else 0.0

    running, closed = [], []
    for i, (at, boxes) in enumerate(frames):
        free = {j: b for j, b in enumerate(boxes) if b[5] >= 0.5 and tracks.plain(b[4])}
        for t in running:
            weights = {}
            for j, b in free.items():
                o, r = shared(t[-1][2], b), difflib.SequenceMatcher(None, tracks.plain(t[-1][2][4]), tracks.plain(b[4])).ratio()
                if o >= 0.5 and r >= 0.8:
                    weights[j] = o + r
            if weights:
                j = min(weights, key=lambda j: (-weights[j], j))
                t.append((i, j, free.pop(j)))
        closed += [t for t in running if t[-1][0] < i - 1]
        running = [t for t in running if t[-1][0] >= i - 1] + [[(i, j, b)] for j, b in free.items()]
    out = set()
    for t in closed + running:
        start, last = frames[t[0][0]][0], t[-1][0]
        stop = frames[last + 1][0] if last + 1 < len(frames) else end
        stop = min(end, start + 1) if stop <= start else stop
        readings = {}
        for _, _, b in t:
            readings.setdefault(tracks.plain(b[4]), []).append(b)
        said = max(readings.values(), key=lambda bs: (len(bs), max(b[5] for b in bs)))
        if stop > start:
            out.add((t[0][0], t[0][1], start, stop, max(said, key=lambda b: b[5])[4], len(t), round(sum(b[5] for _, _, b in t) / len(t), 4), frames[last][0] - start))
    return out


def same(got, want):
    """Equal tracks; the mean score may be rounded another way."""
    key = lambda t: (*t[:6], t[7])
    for r in want:
        assert {key(t): None for t in got[r]} == {key(t): None for t in want[r]}
        assert all(abs(a[6] - b[6]) < 1.1e-4 for a, b in zip(sorted(got[r]), sorted(want[r]), strict=True))


@pytest.fixture(scope="module")
def runs():
    return {r: frames_of(r) for r in range(6)} | {6: [], 7: [(0, [(0.0, 0.0, 1.0, 1.0, "once", 0.9)])], 8: [(0, []), (5, [(0.0, 0.0, 9.0, 9.0, "x", 0.5), (0.0, 0.0, 9.0, 9.0, "x", 0.5)]), (10, [(0.0, 0.0, 9.0, 9.0, "x", 0.5)] * 3)]}


def test_batch_equals_loop(spark, runs):
    d = spark.createDataFrame([(r, at, boxes) for r, frames in runs.items() for at, boxes in frames], FRAME)
    ends = spark.createDataFrame([(r, len(f) * 1000) for r, f in runs.items()], "run_id bigint, end_ms bigint")
    got = {r: set() for r in runs}
    for row in tracks.build_tracks(d, ends).collect():
        got[row.run_id].add(tuple(row)[1:])
    same(got, {r: loop(f, len(f) * 1000) for r, f in runs.items()})


def test_nothing_to_follow(spark):
    ends = spark.createDataFrame([], "run_id bigint, end_ms bigint")
    assert tracks.build_tracks(spark.createDataFrame([], FRAME), ends).collect() == []
    bad = [(1, 0, None), (1, 5, [(0.0, 0.0, 1.0, 1.0, None, 0.9), (0.0, 0.0, 1.0, 1.0, "a", None), (0.0, 0.0, 0.0, 0.0, "a", 0.9)]), (1, 9, [(0.0, 0.0, 0.0, 0.0, "a", 0.9)])]
    # Boxes without area follow nothing; the last sample is the end of a run that has none.
    assert [tuple(r)[1:5] for r in tracks.build_tracks(spark.createDataFrame(bad, FRAME), ends).collect()] == [(1, 2, 5, 9)]


def test_stretches_keep_followers_together(spark, runs):
    d = spark.createDataFrame([(r, at, boxes) for r, frames in runs.items() for at, boxes in frames], FRAME)
    read = tracks.boxes(tracks.samples(d)).cache()
    pairs = tracks.followers(read).cache()
    place = {(r.run_id, r.i, r.j): (r.lane, r.stretch) for r in tracks.stretches(read, pairs).collect()}
    assert len(place) == read.count() and len(set(place.values())) > 10
    assert all(place[p.run_id, p.i, p.j] == place[p.run_id, p.from_i, p.from_j] for p in pairs.collect())


def test_stream_equals_batch(spark, runs, tmp_path):
    from tidemark.streaming.tracks import live_tracks

    folder, rng = tmp_path / "in", random.Random(9)
    folder.mkdir()
    names = ("x0", "y0", "x1", "y1", "text", "score")
    rows = [{"run_id": r, "at_ms": at, "boxes": [dict(zip(names, b, strict=True)) for b in boxes]} for r, frames in runs.items() for at, boxes in frames]
    # Frames come up to four seconds late, in many files; end marks come last, but for one run that stops without.
    rows.sort(key=lambda x: x["at_ms"] + rng.randrange(4000))
    n = 7
    files = [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)]
    files.append([{"run_id": r, "at_ms": 60_000, "end_ms": len(f) * 1000} for r, f in runs.items() if r != 5])
    files.append([{"run_id": 99, "at_ms": 10_000_000, "boxes": []}])
    for k, part in enumerate(files):
        path = folder / f"{k:03d}.json"
        path.write_text("\n".join(map(json.dumps, part)))
        import os

        os.utime(path, (k + 1, k + 1))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        s = spark.readStream.schema(f"{FRAME}, end_ms bigint").option("maxFilesPerTrigger", 1).json(str(folder))
        q = live_tracks(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(300)
        assert q.exception() is None
    finally:
        spark.conf.set(key, before)
    got = {r: set() for r in runs}
    for row in spark.read.parquet(str(tmp_path / "out")).collect():
        got[row.run_id].add(tuple(row)[1:])
    same(got, {r: loop(f, len(f) * 1000 if r != 5 else f[-1][0]) for r, f in runs.items()})
