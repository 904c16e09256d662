"""Toxicity of disguised text: a noisy-channel decoder restores words, then learned word evidence scores them.

Decoder: each suspicious token (leetspeak, symbols within it, repeated letters, letters set apart) is a lattice of readings per
character; Viterbi finds the best one under a character trigram model of the whole corpus plus channel costs.
Scorer: words and word beginnings that are significantly more frequent in toxic labelled documents each carry a
probability; a document's score is the noisy-or of its distinct restored words.

Defined results: null and empty texts, and those without evidence, get the score of no evidence; repeated rows score alike; texts of any
length are scored whole; without toxic labels every score is that of no evidence; an empty table gives no rows; readings of equal cost
go to the one found first; an existing column of the output's name is replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyarrow import parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, held_out, materialise, new_folder

#: Bound on labelled rows that are learned from (a sample by hash). All their features are tested, and all that pass are kept.
SAMPLE = 16_000
#: Most entries of a table of character counts that is sent to the tasks (16 bytes each). The rarer ones beyond it are written to the shared
#: folder in buckets of about BUCKET entries, of which a process holds BUCKETS at a time.
ENTRIES, BUCKET, BUCKETS = 4_000_000, 250_000, 16
THRESHOLD = 0.3
#: Least share of toxic documents among those with a word, or a beginning of words, for it to be evidence.
PRECISION, PRECISION_PART = 0.7, 0.9

# Characters that stand for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
VOWELS = "aeiou"
#: Channel costs in nats: reading a sign as a letter, dropping such a sign, dropping another sign, reading * as a vowel,
#: dropping the second or a later letter of a run, a word break between letters set apart.
READ, DROP_LEET, DROP, STAR, DROP_SECOND, DROP_LATER, BREAK = 0.7, 7.0, 0.3, 1.2, 3.0, 0.2, 1.0


_BITS = 21  # of a code point


def _find(table: tuple[np.ndarray, np.ndarray], key: int) -> int:
    keys, n = table
    at = int(keys.searchsorted(key))
    return int(n[at]) if at < len(keys) and keys[at] == key else 0


@dataclass
class Rest:
    """The entries of a table that are not sent to the tasks: a folder by bucket, read as they are asked for. total: of their counts."""

    folder: str
    buckets: int
    total: int
    held: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def count(self, key: int) -> int:
        b = key % self.buckets
        if (table := self.held.pop(b, None)) is None:
            store, root = arrow_fs.FileSystem.from_uri(f"{self.folder}/bucket={b}")
            t = parquet.read_table(root, filesystem=store, columns=["key", "n"], partitioning=None) if store.get_file_info(root).type == arrow_fs.FileType.Directory else None
            table = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if t is None else _sorted(t)
            while len(self.held) >= BUCKETS:
                del self.held[next(iter(self.held))]
        self.held[b] = table  # the last one asked stands last
        return _find(table, key)


@dataclass
class CharModel:
    """Interpolated character trigrams; 0 is the border of a word. tables: sorted keys and their counts, for trigrams (three), their first two
    (two) and last two characters (pairs), the middle one (heads) and the last one (one); rest: what a table is too large to hold."""

    tables: dict[str, tuple[np.ndarray, np.ndarray]]
    rest: dict[str, Rest] = field(default_factory=dict)
    seen: dict[tuple[str, str, str], float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.total = int(self.tables["one"][1].sum()) + (self.rest["one"].total if "one" in self.rest else 0)

    def __getstate__(self) -> dict:
        return {"tables": self.tables, "rest": self.rest, "total": self.total, "seen": {}}

    def count(self, table: str, key: int) -> int:
        n = _find(self.tables[table], key)
        if n or table not in self.rest:
            return n
        if table == "three" and not (self.count("two", key >> _BITS) and self.count("pairs", key & ((1 << 2 * _BITS) - 1))):
            return 0  # no trigram without its parts: most of those asked for are found out here
        return self.rest[table].count(key)

    def log(self, a: str, b: str, c: str) -> float:
        g = (a, b, c)
        if (x := self.seen.get(g)) is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            i, j, k = (0 if x in "^$" else ord(x) for x in g)
            p1 = (self.count("one", k) + 1) / (self.total + 100)
            p2 = (self.count("pairs", j << _BITS | k) + 5 * p1) / (self.count("heads", j) + 5)
            x = self.seen[g] = math.log((self.count("three", (i << _BITS | j) << _BITS | k) + 5 * p2) / (self.count("two", i << _BITS | j) + 5))
        return x


def readings(token: str) -> list[list[tuple[str, float]]]:
    """For each character its readings and their costs."""
    out, run = [], 0
    for i, c in enumerate(token):
        run = run + 1 if i and c == token[i - 1] else 1
        if c in LEET:
            if run > 1 and not c.isdigit():
                out.append([("", DROP), *((x, READ + 1) for x in LEET[c])])
            else:
                out.append([(x, READ) for x in LEET[c]] + [("", DROP_LEET)])
        elif c == "*":
            out.append([("", DROP)] + [(v, STAR) for v in VOWELS] * (run == 1))
        elif c.isalpha():
            out.append([(c, 0.0)] + [("", DROP_SECOND if run == 2 else DROP_LATER)] * (run > 1))
        else:
            out.append([("", DROP)])
    return out


def viterbi(model: CharModel, token: str, breaks: bool = False, whole: bool = False) -> str:
    """The best reading of the lattice; with breaks, words may end between any two characters (joined by a space); with whole, no sign that can be a letter is dropped."""
    # A text is the pair of the text before and its last letter.
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {("^", "^"): (0.0, None)}
    for char, options in zip(token, readings(token)):
        if whole and char in LEET:
            options = [(x, READ) for x in LEET[char]]
        new: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in states.items():
            for c, cost in options:
                if not c:
                    key, s, t = (a, b), score - cost, text
                else:
                    key, s, t = (b, c), score - cost + model.log(a, b, c), (text, c)
                if key not in new or s > new[key][0]:
                    new[key] = (s, t)
                if breaks and c and text and b != "^":
                    s = score - cost - BREAK + model.log(a, b, "$") + model.log("^", "^", c)
                    if ("^", c) not in new or s > new["^", c][0]:
                        new["^", c] = (s, (text, f" {c}"))
        states = new
    _, text = max(((s + model.log(a, b, "$"), t) for (a, b), (s, t) in states.items()), key=lambda x: x[0], default=(0.0, None))
    out = []
    while text:
        text, c = text
        out.append(c)
    return "".join(reversed(out))


_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "…“”‘’«»¿¡–—"
_EDGE_NO_LEET = "".join(c for c in _EDGE if c not in LEET)
_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")


def restore(model: CharModel, token: str) -> tuple[str, ...]:
    """The plain word, and for suspicious tokens also the decoded ones."""
    low = token.lower()
    tail = low.rstrip(_EDGE)
    plain = tail.lstrip(_EDGE)
    odd = _DOUBLE.search(plain) is not None
    if plain.isalpha() and not odd and low[0] == plain[0]:
        return (plain,)
    if not any(c.isalpha() for c in low):
        # Written wholly in signs and digits: with the signs at its ends, and also with none dropped. Numbers are left alone.
        core = low.strip(_EDGE_NO_LEET)
        if len(core) < 2 or len(set(core)) < 2 or not any(c in LEET and not c.isdigit() for c in core):
            return ()
        cores = dict.fromkeys((core, core.lstrip("(¡").rstrip("!")))  # these may be punctuation as well
        return tuple(dict.fromkeys(w for c in cores for w in (viterbi(model, c), viterbi(model, c, whole=True)) if w))
    # A single sign that can be a letter may begin the word; a run of them is decoration.
    core = tail.lstrip(_EDGE_NO_LEET)
    lead = core[:1] in LEET and not core[:1].isdigit() and not core.startswith(core[0] * 2)
    core = core if lead else plain
    if plain.isalpha() and not odd and not lead:
        return (plain,)
    words = [plain, viterbi(model, core)]
    last = low[len(tail) : len(tail) + 2]
    if last[:1] in LEET and last != last[:1] * 2:
        words.append(viterbi(model, core + last[0]))
    return tuple(dict.fromkeys(w for w in words if w))


class Reader:
    """Restored words of texts, and their evidence; what a token gives is kept, up to a bound."""

    def __init__(self, model: CharModel, weight: dict[str, float] | None = None, most: int = 50_000) -> None:
        self.model, self.most = model, most
        self.weight = weight or {}
        # The first four letters of every word that can have evidence, and these with their runs of a letter as one.
        self.heads = {h for f in self.weight for h in ({f[1:5], f[:4]} if f.startswith("=") else {f[:4]})}
        self.squeezed = {_RUN.sub(r"\1", h) for h in self.heads}
        self.known: dict[str, tuple[str, ...]] = {}
        self.seen: set[str] = set()
        self.telling: dict[str, tuple[tuple[str, ...], float]] = {}

    def restored(self, token: str) -> tuple[str, ...]:
        if (w := self.known.get(token)) is None:
            if len(self.known) > self.most:
                self.known.clear()
            w = self.known[token] = restore(self.model, token)
        return w

    def spelled(self, raw: list[str]) -> set[tuple[str, ...]]:
        """Words from letters set apart: three or more tokens in a row of one letter each."""
        out: set[tuple[str, ...]] = set()
        if len(raw) < 3:
            return out
        single = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) <= 2
        three = np.flatnonzero(single[:-2] & single[1:-1] & single[2:])
        if len(three):
            for run in np.split(three, np.flatnonzero(np.diff(three) > 1) + 1):
                letters = [t.strip(".-_*,").lower() for t in raw[run[0] : run[-1] + 3]]
                for joined in "".join(x if len(x) == 1 else "\x00" for x in letters).split("\x00"):
                    if len(joined) > 2 and len(set(joined)) > 1:
                        out.update((x,) for x in viterbi(self.model, joined, True).split())
        return out

    def tokens(self, text: str | None) -> set[tuple[str, ...]]:
        raw = (text or "").split()
        return {self.restored(t) for t in set(raw)} | self.spelled(raw)

    def best(self, words: tuple[str, ...]) -> float:
        return max((self.weight.get(f, 0.0) for f in features(words)), default=0.0)

    def silent(self, token: str) -> bool:
        """Whether a token of letters, whose readings differ in the lengths of their runs only, has no evidence: none begins like a word that has."""
        low = token.lower()
        word = low.rstrip(_EDGE)
        if not word.isalpha():
            return False
        if _DOUBLE.search(word) is None:
            return word[:4] not in self.heads
        if low[len(word) : len(word) + 1] in LEET:
            return False
        short = _RUN.sub(r"\1", word)
        return not any(short[:k] in self.squeezed for k in range(1, 5))

    def evidence(self, text: str | None) -> dict[tuple[str, ...], float]:
        """The text's distinct restored words with evidence, and how strong it is."""
        raw = (text or "").split()
        if len(self.seen) > self.most:
            self.seen.clear()
            self.telling.clear()
        own = set(raw)
        for t in own - self.seen:
            if self.silent(t):
                continue
            words = restore(self.model, t)
            if x := self.best(words):
                self.telling[t] = (words, x)
        self.seen |= own
        out = dict(self.telling[t] for t in own & self.telling.keys())
        out.update((w, x) for w in self.spelled(raw) if (x := self.best(w)))
        return out


def features(words: tuple[str, ...]) -> list[str]:
    """The words and their beginnings of four to six letters."""
    return [f for w in words for f in (f"={w}", *(f"{w[:k]}" for k in (4, 5, 6) if len(w) > k))]


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() and not 0xD800 <= c < 0xE000 for c in range(0x110000)])


def _sorted(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = t["key"].to_numpy(), t["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def least_count(counts: DataFrame, most: int) -> int:
    """The least count from which no more than `most` of (key, n) are left."""
    # Counts from 1,000 on are told apart by powers of two: a limit is found for any corpus.
    power = F.floor(F.log2(F.col("n") / 1000))
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise((1000 * F.pow(F.lit(2.0), power)).cast("bigint"))
    by_n = {r.n: r.k for r in counts.groupBy(step.alias("n")).agg(F.count("*").alias("k")).collect()}
    least, left = 1, sum(by_n.values())
    for n in sorted(by_n):
        if left <= most:
            break
        left -= by_n[n]
        least = n + 1 if n < 1000 else 2 * n
    return least


def entries(counts: DataFrame, most: int = ENTRIES, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and counts of (key, n): all, or beyond `most` those from the least count on that leaves no more."""
    least = least_count(counts, most) if least is None else least
    return _sorted(counts.where(F.col("n") >= least).select("key", "n").toArrow())


def rest(counts: DataFrame, least: int) -> Rest | None:
    """The entries under `least`, written by bucket."""
    few = counts.where(F.col("n") < least).select("key", "n")
    rows, total = few.agg(F.count("*"), F.sum("n")).first() if least > 1 else (0, 0)
    if not rows:
        return None
    buckets = 2 * (rows // (2 * BUCKET)) + 1  # odd, so that all characters of a key tell
    folder = new_folder(counts.sparkSession, "toxic-rest")
    few.withColumn("bucket", F.col("key") % buckets).repartition("bucket").write.partitionBy("bucket").parquet(folder)
    return Rest(folder, buckets, total)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The tables that are held whole by char_model()."""
    return char_model(docs, text_col).tables


def char_model(docs: DataFrame, text_col: str = "text", most: int = ENTRIES) -> CharModel:
    """Counts of the character trigrams of all words of letters in all documents, and of the shorter contexts; at most `most` of a table in memory."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letter = letters()
        for batch in batches:
            texts, keys, counts = batch["text"].tolist(), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for k in range(0, len(texts), 500):
                codes = np.frombuffer(" ".join(["", "", *(t or "" for t in texts[k : k + 500]), ""]).lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
                codes[~letter[codes]] = 0  # 0: outside a word
                a, b, c = codes[:-2], codes[1:-1], codes[2:]
                used = (b > 0) | (c > 0)
                key, n = np.unique(((np.where(b > 0, a, 0) << 2 * _BITS) | (b << _BITS) | c)[used], return_counts=True)
                keys, counts = np.concatenate([keys, key]), np.concatenate([counts, n])
            keys, at = np.unique(keys, return_inverse=True)
            if len(keys):
                yield pd.DataFrame({"key": keys, "n": np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)}, columns=["key", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(grams, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rows = materialise(rows, "toxic-trigrams")
    low = lambda bits: F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    contexts = {"two": F.shiftright("key", _BITS), "pairs": low(2 * _BITS), "heads": F.shiftright(low(2 * _BITS), _BITS), "one": low(_BITS)}
    tables, others = {}, {}
    for name, c in {"three": F.col("key"), **contexts}.items():
        counts = rows if name == "three" else rows.groupBy(c.alias("key")).agg(F.sum("n").alias("n"))
        least = least_count(counts, most)
        tables[name] = entries(counts, most, least)
        if (x := rest(counts, least)) is not None:
            others[name] = x
    return CharModel(tables, others)


@dataclass
class Evidence:
    chars: CharModel
    weight: dict[str, float]
    none: float


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Evidence:
    """Learn from labelled rows that are not held out; several labels of one document count as toxic if one does."""
    spark = docs.sparkSession
    chars = char_model(docs, text_col)
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("toxic"))
    n = known.count()
    if not n:
        return Evidence(chars, {}, 0.02)
    share = min(1.0, sample / n)
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # Bounded: about `sample` rows of two numbers.
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("text", "toxic")
    shared = spark.sparkContext.broadcast(chars)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(shared.value)
        for batch in batches:
            every, bad = Counter({"": len(batch)}), Counter({"": int(batch["toxic"].sum())})
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                found = {f for words in reader.tokens(text) for f in features(words)}
                every.update(found)
                if toxic:
                    bad.update(found)
            yield pd.DataFrame({"feature": list(every), "n": list(every.values()), "bad": [bad[f] for f in every]}, columns=["feature", "n", "bad"])

    counts = train.mapInPandas(count, "feature string, n bigint, bad bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    counts = materialise(counts, "toxic-features")
    whole = counts.where("feature = ''").first()
    if whole is None or not whole.bad:
        return Evidence(chars, {}, 0.02)
    base = whole.bad / whole.n
    tests = max(1, counts.count())
    p = F.col("bad") / F.col("n")
    gain = 2 * (F.col("bad") * F.log(p / base) + F.when(F.col("bad") < F.col("n"), (F.col("n") - F.col("bad")) * F.log((1 - p) / (1 - base))).otherwise(0.0))
    best = counts.where((F.col("feature") != "") & (F.col("bad") > 0) & ((F.col("bad") + 2 * base) / (F.col("n") + 2) >= F.when(F.col("feature").startswith("="), PRECISION).otherwise(PRECISION_PART))).withColumn("gain", gain).where(F.col("gain") > 2 * math.log(tests) + 2)
    rows = best.collect()  # bounded by the sample's words
    return Evidence(chars, {r.feature: (r.bad + 2 * base) / (r.n + 2) for r in rows}, min(0.05, base / 5))


_READERS: dict[str, Reader] = {}


def reader(key: str, evidence: Evidence) -> Reader:
    """One per worker process: what tokens give is kept from task to task."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(evidence.chars, evidence.weight)
    return _READERS[key]


def score_text(reader: Reader, none: float, text: str | None) -> float:
    return 1 - (1 - none) * math.prod(1 - x for x in reader.evidence(text).values())


def score(docs: DataFrame, evidence: Evidence, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text."""
    shared, key = docs.sparkSession.sparkContext.broadcast(evidence), uuid.uuid4().hex

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = reader(key, shared.value)
        for batch in texts:
            yield pd.Series([score_text(own, shared.value.none, t) for t in batch], dtype="float64")

    return docs.withColumn(out, scored(F.col(text_col)))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents under the threshold, with their own columns."""
    name = free_name(docs, "toxicity")
    return score(docs, learn(docs, labels, **options), out=name).where(F.col(name) < threshold).drop(name)
