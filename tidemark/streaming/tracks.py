"""Text tracks on a stream of frames: the batch rules with the open tracks of each run as keyed state.

Frames wait until the watermark has passed them, so they are followed in time order however they arrive; what comes later than that is
left out. State holds the waiting frames and the open tracks only: a track goes out when it is closed, and a run's state is removed at its
end mark, or once it has sent nothing for `idle` milliseconds of event time. Needs the RocksDB state store provider.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.tracks import LIKENESS, MISSES, OVERLAP, RUN, SCORE, choose, likeness, plain

#: Event time of a run's start: rows at the epoch would be late before any watermark.
ORIGIN = 86_400_000
OUT = "run_id bigint, first_i int, first_j int, start_ms bigint, end_ms bigint, text string, n_samples bigint, confidence double, observed_ms bigint"


def _shared(a: list[float], b: list[float]) -> float:
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


class OpenTracks:
    """The tracks of one run that may go on; plain values only, so that it can be kept as JSON."""

    def __init__(self, state: dict | None = None):
        self.state = state or {"samples": 0, "last_ms": None, "tracks": [], "waiting": []}

    def add(self, at_ms: int, boxes: list[dict]) -> Iterator[tuple]:
        """Follow the open tracks into the next sample; the tracks that it closes."""
        s, i = self.state, self.state["samples"]
        read = [(j, [b["x0"], b["y0"], b["x1"], b["y1"]], b["text"], b["score"], plain(b["text"])) for j, b in enumerate(boxes or []) if b["score"] is not None and b["score"] >= SCORE and plain(b["text"])]
        found = []
        for j, box, _, _, text in read:
            given = []
            for k, t in enumerate(s["tracks"]):
                shared = _shared(t["box"], box)
                alike = likeness(t["plain"], text) if shared >= OVERLAP else 0.0
                if alike >= LIKENESS:
                    given.append((k, shared + alike))
            found.append((j, given))
        taken = choose(list(range(len(s["tracks"]))), found)
        for t in s["tracks"]:
            if t["next_ms"] is None:
                t["next_ms"] = at_ms
        for j, box, text, score, key in read:
            if j in taken:
                t = s["tracks"][taken[j]]
            else:
                t = {"first": [i, j], "start_ms": at_ms, "n": 0, "sum": 0.0, "readings": {}}
                s["tracks"].append(t)
            t.update(box=box, plain=key, last=i, last_ms=at_ms, next_ms=None, n=t["n"] + 1, sum=t["sum"] + score)
            n, best, first, shown = t["readings"].get(key, (0, -1.0, at_ms, text))
            t["readings"][key] = (n + 1, max(best, score), first, text if score > best else shown)
        closed = [t for t in s["tracks"] if t["last"] < i - MISSES]
        s["tracks"] = [t for t in s["tracks"] if t["last"] >= i - MISSES]
        s["samples"], s["last_ms"] = i + 1, at_ms
        yield from (row for t in closed if (row := self.row(t, None)))

    def finish(self, end_ms: int | None) -> Iterator[tuple]:
        yield from (row for t in self.state["tracks"] if (row := self.row(t, end_ms)))
        self.state["tracks"] = []

    @staticmethod
    def row(t: dict, end_ms: int | None) -> tuple | None:
        run_end = t["last_ms"] if end_ms is None else end_ms
        end = t["next_ms"] if t["next_ms"] is not None else run_end
        if end <= t["start_ms"]:
            end = min(run_end, t["start_ms"] + 1)
        if end <= t["start_ms"]:
            return None
        text = max(t["readings"].values(), key=lambda r: (r[0], r[1], -r[2]))[3]
        return (*t["first"], t["start_ms"], end, text, t["n"], round(t["sum"] / t["n"], 4), t["last_ms"] - t["start_ms"])


class _Processor(StatefulProcessor):
    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("run", "state string")

    def _load(self) -> OpenTracks:
        return OpenTracks(json.loads(self.kept.get()[0]) if self.kept.exists() else None)

    def _due(self, run: OpenTracks, upto: int) -> Iterator[tuple]:
        s = run.state
        due = sorted((f for f in s["waiting"] if f[0] <= upto), key=lambda f: f[0])
        s["waiting"] = [f for f in s["waiting"] if f[0] > upto]
        for at_ms, found in due:
            if s["last_ms"] is None or at_ms > s["last_ms"]:
                yield from run.add(at_ms, found)

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, out, end = self._load(), [], None
        for batch in rows:
            for at_ms, boxes, end_ms in zip(batch["at_ms"], batch["boxes"], batch["end_ms"], strict=True):
                if not pd.isna(end_ms):
                    end = int(end_ms)
                else:
                    run.state["waiting"].append((int(at_ms), [dict(b) for b in ([] if boxes is None else boxes)]))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if end is not None:
            out += self._due(run, 1 << 62)
            out += run.finish(end)
            self.kept.clear()
        else:
            out += self._due(run, timerValues.getCurrentWatermarkInMs() - ORIGIN)
            self.kept.update((json.dumps(run.state),))
            waiting = [f[0] for f in run.state["waiting"]]
            self.handle.registerTimer(ORIGIN + (max(waiting) if waiting else (run.state["last_ms"] or 0) + self.idle))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, now = self._load(), timerValues.getCurrentWatermarkInMs() - ORIGIN
        out = list(self._due(run, now))
        if (run.state["last_ms"] or 0) + self.idle <= now:
            out += run.finish(None)
            self.kept.clear()
        else:
            self.kept.update((json.dumps(run.state),))
            self.handle.registerTimer(ORIGIN + (run.state["last_ms"] or 0) + self.idle)
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def live_tracks(frames: DataFrame, late: str = "10 seconds", idle: int = 60_000) -> DataFrame:
    """Closed tracks of a stream of frames (run_id bigint, at_ms, boxes) and end marks (end_ms, no boxes); at_ms is event time."""
    d = frames.select(RUN, "at_ms", "boxes", "end_ms", F.timestamp_millis(F.col("at_ms") + ORIGIN).alias("ts")).withWatermark("ts", late)
    return d.groupBy(RUN).transformWithStateInPandas(_Processor(idle), OUT, outputMode="Append", timeMode="eventTime")
