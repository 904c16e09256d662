"""License scans: fuzzy search of short notices in whole texts.

Texts and notices are reduced to lower-case words with one space between them. A notice that may hold k errors is split into k + 1
pieces; a match with at most k errors holds one piece unchanged (pigeonhole), so one Aho-Corasick pass over all
pieces finds all candidates. Each candidate window is then matched by itself with bounded errors by the regex library.

Defined results: null and empty texts have no words and no labels; of overlapping matches the one with the least share of errors counts, of
equal ones the longest, then the first; repeated rows are scanned alike; very long texts are scanned whole; an empty table gives no rows; an
existing column of the output's name is replaced.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that count where they stand word for word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Short notices, their labels and the errors (inserted, dropped or changed characters) they may hold.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under the gnu general public license", "gpl", 4),
    ("licensed under the gnu lesser general public license", "lgpl", 4),
    ("subject to the terms of the mozilla public license", "mpl", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by sa 4 0", "cc-by-sa", 2),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("released into the public domain", "public-domain", 2),
    ("eclipse public license", "epl", 2),
    ("all rights reserved", "reserved", 1),
)

RESULT = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,spans:array<struct<label:string,start:int,end:int,errors:int>>>"

_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


@dataclass
class Scanner:
    notices: tuple = NOTICES
    phrases: dict = field(default_factory=lambda: dict(PHRASES))

    def __post_init__(self) -> None:
        self.seeds = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        self.patterns = []
        for i, (notice, _, k) in enumerate(self.notices):
            cuts = [round(j * len(notice) / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                where.setdefault(notice[a:b], []).append((i, a))
            self.patterns.append(regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}"))
        for piece, at in where.items():
            self.seeds.add_word(piece, (len(piece), at))
        self.seeds.make_automaton()

    def search(self, text: str, i: int, a: int, b: int) -> tuple | None:
        """The best match of a notice in text[a:b], as matches() orders them: share of errors, -length, start, notice, end, errors, a, b."""
        notice, _, k = self.notices[i]
        if b - a < len(notice) - k or not (m := self.patterns[i].search(text, a, b)):
            return None
        errors = sum(m.fuzzy_counts)
        # Of equally good alignments the tightest, which takes nothing from a neighbour.
        for left, right in ((0, 1), (1, 0)):
            while errors and (x := self.patterns[i].search(text, m.start() + left, m.end() - right)) and sum(x.fuzzy_counts) == errors:
                m = x
        return errors / len(notice), m.start() - m.end(), m.start(), i, m.end(), errors, a, b

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors), characters of a text of words with single spaces."""
        # A window holds the whole match that its piece is part of; equal windows are searched once.
        windows: set[tuple[int, int, int]] = set()
        for last, (size, at) in self.seeds.iter(text):
            for i, offset in at:
                notice, _, k = self.notices[i]
                windows.add((i, max(0, last + 1 - size - offset - k), min(len(text), last + 1 - size - offset + len(notice) + k)))
        found = [m for w in windows if (m := self.search(text, *w))]
        heapq.heapify(found)
        # Of overlapping matches the one with the least share of errors stays; what is left of the others' windows is searched again.
        best: list[tuple[int, int, int, int]] = []
        starts: list[int] = []
        while found:
            _, _, start, i, end, errors, a, b = heapq.heappop(found)
            at = bisect.bisect_left(starts, end)
            if not at or best[at - 1][2] <= start:
                starts.insert(at, start)
                best.insert(at, (i, start, end, errors))
                continue
            _, left, right, _ = best[at - 1]
            for x, y in {(a, min(b, left)), (max(a, right), b)}:
                if m := self.search(text, i, x, y):
                    heapq.heappush(found, m)
        return best

    def scan(self, text: str | None) -> dict:
        ws = words_of(text)
        joined = b" " + b" ".join(ws) + b" "
        places, base, spans = [], set(), []
        # Where words begin, once: counting from the start for every place is quadratic in a text of phrases.
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        for phrase, label in self.phrases.items():
            needle, at = f" {phrase} ".encode(), -1
            while (at := joined.find(needle, at + 1)) >= 0:
                first = int(np.searchsorted(breaks, at))
                places.append(first)
                base.add(label)
                spans.append({"label": label, "start": first, "end": first + phrase.count(" ") + 1, "errors": 0})
        labels, score, line = set(base), 1.0 if base else 0.0, joined.decode("utf-8", "replace")
        gaps = None
        for i, a, b, errors in self.matches(line):
            if gaps is None:
                gaps = [k for k, c in enumerate(line) if c == " "]
            notice, label, _ = self.notices[i]
            labels.add(label)
            score = max(score, 1 - errors / len(notice))
            start = bisect.bisect_left(gaps, a + (line[a] == " ")) - 1
            spans.append({"label": label, "start": max(0, start), "end": bisect.bisect_left(gaps, b - (line[b - 1] == " ")), "errors": errors})
        return {"n_words": len(ws), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score, "spans": spans}


def scan(docs: DataFrame, text_col: str = "text", out: str = "license", notices: tuple = NOTICES) -> DataFrame:
    """docs with a struct: counts of words and exact phrases, labels, score and spans (first word, end word, errors)."""

    @F.pandas_udf(RESULT)
    def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for batch in texts:
            rows = pd.DataFrame([scanner.scan(t) for t in batch], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
            yield rows.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn(out, scanned(F.col(text_col)))
