"""Language identification of mixed texts: word scores per language, a Viterbi path with a switching penalty, spans.

Each word's script narrows its candidate languages (those whose training text uses the script); character n-grams score it
under each candidate. The best path of languages over the words, in which each switch costs PENALTY, gives spans; the text's
language is the one that holds most letters.

Defined results: a null text or one without a letter is `und` with score 0; words without a letter take the language of the path;
without training rows, as with an empty table, everything is `und`; ties go to the language first in order; repeated rows are labelled
alike; texts of any length are labelled whole; words of a script that no language was learned in say nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, held_out, materialise

#: Bound on the rows that are learned from (a sample by hash). All their n-grams are kept.
SAMPLE = 8_000
#: Cost of a switch, and the most that one word's n-grams can say for or against a language.
PENALTY, MOST = 12.0, 4.0
#: Cost of a word in a language that is no candidate for its script: more than two switches and two words' scores can make up for.
OUTSIDE = 2 * PENALTY + 4 * MOST
#: Share of a language's letters that must be in a script for it to be a candidate there.
SCRIPT_SHARE = 0.01

# First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


@lru_cache(maxsize=None)
def script_of_letter(c: str) -> str:
    return next((s for s, r in SCRIPTS.items() if any(a <= ord(c) <= b for a, b in r)), "other")


def script_of(word: str) -> str:
    """The script of the first letter of a word of letters."""
    return script_of_letter(word[0])


def grams(word: str) -> list[str]:
    """Character trigrams with the word's borders."""
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha()) + "…“”‘’«»¿¡–—"


def plain(token: str) -> str:
    """The token's letters, lower-cased."""
    w = token.strip(_EDGE).lower()
    return w if w.isalpha() else "".join(filter(str.isalpha, w))


@dataclass
class Model:
    langs: list[str]
    known: dict[str, int]
    scores: np.ndarray  # n-grams by languages, the last row for unknown ones: log-probability less the mean over languages
    scripts: dict[str, np.ndarray]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Words by languages: the mean n-gram score, times the root of their number; other scripts' languages far below."""
        if not words:
            return np.zeros((0, len(self.langs)))
        get, last = self.known.get, len(self.scores) - 1
        flat = np.array([get(w[i : i + 3], last) for w in (f"^{w}$" for w in words) for i in range(len(w) - 2)], dtype=np.int64)
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = np.clip(np.add.reduceat(self.scores[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None], -MOST, MOST)
        for i, w in enumerate(words):
            if (s := self.scripts.get(script_of(w))) is not None:
                out[i] += s
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from rows with a language that are not held out, a sample by hash of about `sample` rows."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    share = min(1.0, sample / max(1, known.select(id_col).count()))
    train = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(share * (1 << 20))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                words: Counter = Counter()
                for t in part["text"]:
                    words.update(t.split())
                out: Counter = Counter()
                for token, n in words.items():
                    if w := plain(token):
                        out[f"\x00{script_of(w)}"] += n * len(w)
                        for g in grams(w):
                            out[g] += n
                if out:
                    yield pd.DataFrame({"lang": [lang] * len(out), "gram": list(out), "n": list(out.values())}, columns=["lang", "gram", "n"])

    counts = materialise(train.mapInPandas(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-counts")
    totals = {r.lang: r.n for r in counts.where(~F.col("gram").startswith("\x00")).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], {}, np.zeros((1, 0)), {})
    # Bounded by the sample of rows.
    rows = counts.where(~F.col("gram").startswith("\x00")).groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by")).collect()
    ids, table = {}, np.zeros((len(rows) + 1, len(langs)))
    at = {lang: i for i, lang in enumerate(langs)}
    for k, r in enumerate(sorted(rows, key=lambda r: r.gram)):
        ids[r.gram] = k
        for x in r["by"]:
            table[k, at[x.lang]] = x.n
    size = np.array([totals[x] for x in langs], dtype=float)
    logs = np.log((table + 0.5) / (size + 0.5 * len(table)))
    logs -= logs.mean(axis=1, keepdims=True)
    logs[-1] = 0.0
    letters: dict[str, np.ndarray] = {}
    for r in counts.where(F.col("gram").startswith("\x00")).collect():
        letters.setdefault(r.gram[1:], np.zeros(len(langs)))[at[r.lang]] = r.n
    total = sum(letters.values(), np.zeros(len(langs)))
    scripts = {s: np.where(v >= SCRIPT_SHARE * np.maximum(total, 1), 0.0, -OUTSIDE) for s, v in letters.items()}
    scripts = {s: v for s, v in scripts.items() if (v == 0).any()}
    return Model(langs, ids, logs, scripts)


def viterbi(e: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best path over words (rows) of languages (columns).

    One language throughout, the best of its kind, is tried first. A path that keeps to it in part has a switch for each stretch in
    another language, so no such path is better if no stretch gains more than the penalty. A path that never keeps to it and is not
    constant has a switch at least, so none is better if the other languages' best scores of all words together gain no more than that.
    """
    n, k = e.shape
    main = int(np.argmax(e.sum(axis=0)))
    if k < 2:
        return np.full(n, main, dtype=np.int64)
    gain = np.cumsum(e - e[:, [main]], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain]), axis=0)[:-1]
    others = np.delete(e, main, axis=1).max(axis=1).sum() - e[:, main].sum() if k > 2 else 0.0
    if float((gain - low).max()) <= penalty and others <= penalty:
        return np.full(n, main, dtype=np.int64)
    back = np.zeros((n, k), dtype=np.int32)
    score = e[0].copy()
    own = np.arange(k)
    for i in range(1, n):
        top = int(score.argmax())
        switch = score[top] - penalty > score
        back[i] = np.where(switch, top, own)
        score = np.where(switch, score[top] - penalty, score) + e[i]
    path = np.empty(n, dtype=np.int64)
    path[-1] = int(score.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class Labeller:
    """Spans and language of texts; word scores are kept, up to a bound."""

    def __init__(self, model: Model, most: int = 200_000) -> None:
        self.model, self.most = model, most
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs)), dtype=np.float32)
        self.size = np.zeros(0, dtype=np.int64)

    def prepare(self, texts: list[str]) -> list[list[int]]:
        split = [t.split() for t in texts]
        new = list({w for ws in split for w in ws} - self.row.keys())
        if len(self.row) + len(new) > self.most:
            self.row, self.table, self.size = {}, self.table[:0], self.size[:0]
            new = list({w for ws in split for w in ws})
        words = [plain(w) for w in new]
        made = np.zeros((len(new), len(self.model.langs)), dtype=np.float32)
        some = [i for i, w in enumerate(words) if w]
        made[some] = self.model.word_scores([words[i] for i in some])
        base = len(self.row)
        self.row.update(zip(new, range(base, base + len(new)), strict=True))
        self.table = np.concatenate([self.table, made])
        self.size = np.concatenate([self.size, np.fromiter(map(len, words), dtype=np.int64, count=len(words))])
        return [[self.row[w] for w in ws] for ws in split]

    def label(self, ids: list[int]) -> tuple[str, float, list[tuple[str, int, int]]]:
        """(language, share of letters it holds, spans of (language, first word, end))."""
        if not ids or not self.model.langs:
            return "und", 0.0, []
        at = np.array(ids)
        size = self.size[at]
        if not size.sum():
            return "und", 0.0, []
        e = self.table[at].astype(np.float64)
        path = viterbi(e)
        held = np.bincount(path, weights=size, minlength=len(self.model.langs))
        best = int(held.argmax())
        edges = np.flatnonzero(np.diff(path)) + 1
        starts = [0, *edges.tolist()]
        spans = [(self.model.langs[path[a]], a, b) for a, b in zip(starts, [*starts[1:], len(path)], strict=True)]
        margin = float(np.sort(e.sum(axis=0))[::-1][:2] @ np.array([1, -1])) if e.shape[1] > 1 else 10.0
        sure = 1 / (1 + math.exp(-min(50.0, abs(margin))))
        return self.model.langs[best], float(held[best] / held.sum() * sure), spans


SPANS = "array<struct<lang:string,start:int,end:int>>"

_LABELLERS: dict[str, Labeller] = {}


def labeller(key: str, model: Model) -> Labeller:
    """One per worker process: word scores are kept from task to task."""
    if key not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[key] = Labeller(model)
    return _LABELLERS[key]


def label_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, lang_score and lang_spans (array of language, first word, end word); columns of these names are replaced."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("struct<lang_pred:string,score:double,spans:string>")
    def labelled(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = labeller(key, shared.value)
        for batch in texts:
            out = []
            for k in range(0, len(batch), 500):
                for ids in own.prepare([t or "" for t in batch.iloc[k : k + 500]]):
                    lang, share, spans = own.label(ids)
                    out.append((lang, share, json.dumps([{"lang": x, "start": a, "end": b} for x, a, b in spans])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "spans"])

    made = free_name(docs, "labelled")
    x = docs.withColumn(made, labelled(F.col(text_col)))
    return x.withColumns({"lang_pred": F.col(f"{made}.lang_pred"), "lang_score": F.col(f"{made}.score"), "lang_spans": F.from_json(f"{made}.spans", SPANS)}).drop(made)
